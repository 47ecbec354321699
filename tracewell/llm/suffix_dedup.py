"""Removal of every byte covered by a 200-byte string that starts anywhere else.

A suffix array restricted to its first `LENGTH` bytes decides which strings repeat: equal strings become
neighbours.  Sorting every suffix of a corpus is what a difference cover avoids.  Positions whose number
modulo `PERIOD` lies in `COVER` are sampled; of any two positions some shift below `PERIOD` leads
both to sampled ones.  So two equal strings of `LENGTH` bytes hold equal sampled strings of
`NAMED` = LENGTH - PERIOD + 1 bytes at one shift.  Three sorts follow, each distributed over ranges of the names:

1. the sampled strings of `NAMED` bytes are sorted and named; strings found once are final and leave;
2. the remaining sample is sorted by name and by a second name of the context that any string of `LENGTH` bytes
   around it can reach; a name whose neighbours all have one context is settled: its context repeats as a whole;
3. the remaining suffixes, those with an unsettled sample in reach, are merged in: named by their
   `LENGTH` bytes and compared with their neighbours.

Names are 64-bit hashes of the strings, so the order is that of the hashes; equality of neighbours is all
that is asked of it, and no level of ranks has to be carried back to the text.  Every exchange
moves sorted names out and one bit for each name back, keyed by block of documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import pack_plain, pack_sorted, range_slices, stage, unpack_plain, unpack_sorted
from tracewell.llm.text import _CODE, mix, text_buffer

LENGTH = 200
PERIOD = 133
# A perfect difference set modulo 133 (fixed values): every remainder but 0 is the difference of one pair.
COVER = np.array([1, 2, 4, 13, 21, 35, 39, 82, 89, 95, 105, 110])
NAMED = LENGTH - PERIOD + 1
#: Mean bytes of a block of documents, the unit that one task holds. Their number grows with the corpus.
BLOCK_BYTES = 2 << 20

_SEGMENT = 1 << 19
_STEP = 0x9FB21C651E98DF25
_REACH = LENGTH + PERIOD
_POWER = np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(_SEGMENT + _REACH, _STEP, np.uint64)])
_BACK = np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(_SEGMENT + _REACH, pow(_STEP, -1, 1 << 64), np.uint64)])

_NAMES = "r long, block long, level int, keys binary, contexts binary"
_BITS = "block long, level int, r long, bits binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_ends array<long>"


def string_names(data: np.ndarray, at: np.ndarray, length) -> np.ndarray:
    """Hashes of `length` bytes (a number, or one for each) from the ascending positions `at`."""
    out = np.empty(len(at), np.uint64)
    length = np.broadcast_to(np.asarray(length, np.int64), at.shape)
    home = at // _SEGMENT
    cut = np.r_[0, np.flatnonzero(np.diff(home)) + 1, len(at)]
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        if i == j:
            continue
        base = int(home[i]) * _SEGMENT
        part = data[base : base + _SEGMENT + _REACH]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODE[part] * _POWER[: len(part)], out=sums[1:])
        p = at[i:j] - base
        out[i:j] = mix((sums[p + length[i:j]] - sums[p]) * _BACK[p])
    return out


class Block:
    """A block's documents in one buffer, and its names at each level."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.data, off = text_buffer(self.table.column("text"))
        self.data, self.off = self.data[off[0] : off[-1]], off - off[0]
        size = np.diff(self.off)
        self.doc_end = np.repeat(self.off[1:], size)
        self.doc_start = np.repeat(self.off[:-1], size)
        inner = (np.arange(len(self.data)) - self.doc_start) % PERIOD
        sampled = np.zeros(PERIOD, bool)
        sampled[COVER] = True
        at = np.flatnonzero(sampled[inner])
        self.sample = at[at + NAMED <= self.doc_end[at]]

    def reach(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of what a string of `LENGTH` bytes can reach around a sampled string that it holds."""
        return np.maximum(at - PERIOD + 1, self.doc_start[at]), np.minimum(at + LENGTH, self.doc_end[at])

    def contexts(self, at: np.ndarray) -> np.ndarray:
        lo, hi = self.reach(at)
        return mix(string_names(self.data, lo, hi - lo) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - at).astype(np.uint64))

    def remaining(self, unsettled: np.ndarray) -> np.ndarray:
        """Starts of `LENGTH` bytes that hold an unsettled sampled string."""
        near = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(near, np.maximum(unsettled - PERIOD + 1, self.doc_start[unsettled]), 1)
        np.add.at(near, unsettled + 1, -1)
        at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        return at[at + LENGTH <= self.doc_end[at]]

    def names(self, bits: dict[int, dict[int, bytes]], ranges: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Names of the first level without an answer, in sorted order, with the contexts at level 1."""
        keys = string_names(self.data, self.sample, NAMED)
        if 0 not in bits:
            return np.sort(keys), None
        hit = _answer(keys, bits[0], ranges)
        self.repeated, keys = self.sample[hit], keys[hit]
        if 1 not in bits:
            order = np.argsort(keys, kind="stable")
            return keys[order], self.contexts(self.repeated)[order]
        self.settled = _answer(keys, bits[1], ranges)
        self.left = self.remaining(self.repeated[~self.settled])
        return np.sort(string_names(self.data, self.left, LENGTH)), None

    def covered(self, bits: dict[int, dict[int, bytes]], ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs of bytes to remove, by start and end; they may touch across documents."""
        self.names(bits, ranges)
        lo, hi = self.reach(self.repeated[self.settled])
        whole = hi - lo >= LENGTH
        hit = self.left[_answer(string_names(self.data, self.left, LENGTH), bits[2], ranges)]
        depth = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(depth, np.r_[lo[whole], hit], 1)
        np.add.at(depth, np.r_[hi[whole], hit + LENGTH], -1)
        edge = np.diff((np.cumsum(depth[:-1]) > 0).astype(np.int8), prepend=0, append=0)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _answer(keys: np.ndarray, bits: dict[int, bytes], ranges: int) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    r, cut = range_slices(keys[order], ranges)
    out = np.zeros(len(keys), bool)
    for x, i, j in zip(r, cut[:-1], cut[1:], strict=False):
        if int(x) in bits:  # a range without repeats sends nothing back
            out[order[i:j]] = np.unpackbits(np.frombuffer(bits[int(x)], np.uint8), count=j - i).astype(bool)
    return out


def _bits_of(table: pa.Table, level: int) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {k: {} for k in range(level)}
    for row in table.to_pylist():
        out[row["level"]][row["r"]] = row["bits"]
    return out


def _emit(docs: pa.Table, bits: pa.Table, level: int, ranges: int) -> pa.Table:
    names = [c.split()[0] for c in _NAMES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    rows = []
    if docs.num_rows:
        block = docs.column("block")[0].as_py()
        keys, contexts = Block(docs).names(_bits_of(bits, level), ranges)
        if len(keys):
            r, cut = range_slices(keys, ranges)
            rows = [(int(x), block, level, pack_sorted(keys[i:j]), None if contexts is None else pack_plain(contexts[i:j])) for x, i, j in zip(r, cut[:-1], cut[1:], strict=True)]
    cols = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _compare(table: pa.Table) -> pa.Table:
    """Sort the names of a range; a bit for each that equals a neighbour, or at level 1 for each with one context only."""
    each = [unpack_sorted(x.as_py()) for x in table.column("keys")]
    keys = np.concatenate(each)
    if table.column("contexts")[0].as_py() is None:
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        same = np.r_[False, s[1:] == s[:-1]]
        same[:-1] |= same[1:]
    else:
        contexts = np.concatenate([unpack_plain(x.as_py(), np.uint64) for x in table.column("contexts")])
        order = np.lexsort((contexts, keys))
        s, c = keys[order], contexts[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        last = np.r_[first[1:], len(s)] - 1
        same = np.repeat(c[first] == c[last], last - first + 1)
    flag = np.empty(len(keys), bool)
    flag[order] = same
    ends = np.cumsum([len(x) for x in each])
    parts = [flag[e - len(x) : e] for x, e in zip(each, ends, strict=True)]
    hit = [k for k, p in enumerate(parts) if p.any()]
    take = table.select(["block", "level", "r"]).take(pa.array(hit, pa.int64()))
    return take.append_column("bits", pa.array([np.packbits(parts[k]).tobytes() for k in hit], pa.binary()))


def _finish(docs: pa.Table, bits: pa.Table, ranges: int) -> pa.Table:
    names = [c.split()[0] for c in _RESULT.split(", ")]
    rows = []
    if docs.num_rows:
        b = Block(docs)
        lo, hi = b.covered(_bits_of(bits, 3), ranges)
        # runs that touch across a document's end stay two
        first = np.searchsorted(b.off, lo, side="right") - 1
        gone = [[] for _ in range(len(b.off) - 1)]
        for d, s, e in zip(first.tolist(), lo.tolist(), hi.tolist(), strict=True):
            while s < e:
                cut = min(e, int(b.off[d + 1]))
                if cut > s:
                    gone[d].append((s - int(b.off[d]), cut - int(b.off[d])))
                s, d = cut, d + 1
        for doc, spans, a, z in zip(b.table.column("doc_id").to_pylist(), gone, b.off[:-1].tolist(), b.off[1:].tolist(), strict=True):
            sha, at = hashlib.sha256(), 0
            for s, e in spans:
                sha.update(b.data[a + at : a + s])
                at = e
            sha.update(b.data[a + at : z])
            rows.append((doc, z - a, sum(e - s for s, e in spans), len(spans), sha.hexdigest(), [s for s, _ in spans], [e for _, e in spans]))
    types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    cols = zip(*rows, strict=True) if rows else [[]] * 7
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """For each row of `docs` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, span_starts, span_ends (bytes).

    A null text is an empty one; texts shorter than `LENGTH` bytes keep all.  Rows that repeat a doc_id are texts of
    their own, so that a repeated row of `LENGTH` bytes or more loses all its bytes, as do both of two copies.
    A null doc_id is kept.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    table = f"llm_blocks_{uuid.uuid4().hex}"
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    dealt.repartition(ranges, "block").write.bucketBy(ranges, "block").option("compression", "zstd").saveAsTable(table)
    texts = spark.table(table)
    bits = spark.createDataFrame([], _BITS)
    for level in range(3):
        names = _apply(texts, bits, _emitter(level, ranges), _NAMES)
        bits = bits.union(stage(names.groupBy("r").applyInArrow(_compare, _BITS), f"repeats-{level}"))
    return _apply(texts, bits, lambda d, b: _finish(d, b, ranges), _RESULT)


def _emitter(level: int, ranges: int):
    return lambda d, b: _emit(d, b, level, ranges)


def _apply(texts: DataFrame, bits: DataFrame, fn, schema: str) -> DataFrame:
    return texts.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(fn, schema)
