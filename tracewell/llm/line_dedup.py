"""Line dedup across documents by probing a sharded minimal perfect hash.

A line's key is the line without white space at its ends, A-Z folded; its hash has 128 bits, of which 64
place it and 32 are its fingerprint.  The distinct hashes are dealt over shards by their leading bits.  Each
shard is one row of the index: a minimal perfect hash (levels of bits, each key the only one in its slot
of some level; its number is the rank of that bit) and three arrays by that number: fingerprint, documents
(up to two are told apart) and the smallest document.  Documents send their line hashes to the shards and
probe the arrays there; neither lines nor texts are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import key_ranges, pack_plain, stage, unpack_plain
from tracewell.llm.text import mix

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: Slots for each key in a level of the perfect hash.
GAMMA = 2.0
_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def line_key(line: str) -> str:
    return line.strip(BLANKS).translate(_FOLD)


class PerfectHash:
    """Minimal perfect hash of distinct uint64 keys; keys outside the set get some number or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = [np.cumsum(x, dtype=np.int64) for x in levels]
        self.base = np.cumsum([0, *(int(o[-1]) for o in ones)])
        self.rank = [o - x for o, x in zip(ones, levels, strict=True)]

    @staticmethod
    def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            size = max(8, int(GAMMA * len(keys)))
            s = cls.slots(keys, len(levels), size)
            alone = np.bincount(s, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            keys = keys[~alone[s]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            s = self.slots(keys[left], k, len(bits))
            hit = bits[s] == 1
            out[left[hit]] = self.base[k] + self.rank[k][s[hit]]
            left = left[~hit]
        return out

    def __len__(self) -> int:
        return int(self.base[-1])

    def dump(self) -> tuple[bytes, bytes]:
        return np.array([len(x) for x in self.levels], "<i8").tobytes(), b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        at, raw, levels = 0, np.frombuffer(bits, np.uint8), []
        for n in np.frombuffer(sizes, "<i8"):
            k = -(-int(n) // 8)
            levels.append(np.unpackbits(raw[at : at + k], count=int(n)))
            at += k
        return cls(levels)


_SENT = "r long, doc binary, text binary, line binary, place binary, print binary"
_INDEX = "r long, sizes binary, bits binary, prints binary, docs binary, owner binary"


def _send(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Long enough lines of a batch, by hash range: document, hash of its text, line number, place and fingerprint."""
    for batch in batches:
        doc, mark, line, place, prints = [], [], [], [], []
        for d, m, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for k, raw in enumerate((text or "").split("\n")):
                key = line_key(raw)
                if len(key) >= MIN_CHARS:
                    h = xxhash.xxh3_128_intdigest(key.encode())
                    doc.append(d)
                    mark.append(m)
                    line.append(k)
                    place.append(h & 0xFFFFFFFFFFFFFFFF)
                    prints.append(h >> 96)
        if not doc:
            continue
        p = np.array(place, np.uint64)
        r = (((p >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(r, kind="stable")
        cut = np.r_[0, np.flatnonzero(np.diff(r[order])) + 1, len(r)]
        cols = [np.array(x, t)[order] for x, t in ((doc, np.int64), (mark, np.int64), (line, np.uint32), (place, np.uint64), (prints, np.uint32))]
        rows = [(int(r[order[i]]), *(pack_plain(c[i:j]) for c in cols)) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=[c.split()[0] for c in _SENT.split(", ")])


def _column(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.concatenate([unpack_plain(x.as_py(), dtype) for x in table.column(name)])


def _build(table: pa.Table) -> pa.Table:
    """One index row for a hash range."""
    doc, place, prints = (_column(table, c, t) for c, t in (("doc", np.int64), ("place", np.uint64), ("print", np.uint32)))
    keys, first = np.unique(place, return_index=True)
    mph = PerfectHash.build(keys)
    at = mph(place)
    owner = np.full(len(mph), np.iinfo(np.int64).max)
    np.minimum.at(owner, at, doc)
    docs = np.ones(len(mph), np.uint8)
    docs[at[doc != owner[at]]] = 2
    mark = np.empty(len(mph), np.uint32)
    mark[mph(keys)] = prints[first]
    sizes, bits = mph.dump()
    row = [table.column("r")[0].as_py(), sizes, bits, pack_plain(mark), pack_plain(docs), pack_plain(owner)]
    return pa.table([pa.array([x]) for x in row], names=[c.split()[0] for c in _INDEX.split(", ")])


def _probe(sent: pa.Table, index: pa.Table) -> pa.Table:
    """Lines to drop: found in two documents or more, and this is not the smallest."""
    s = index.slice(0, 1).to_pylist()[0]
    mph = PerfectHash.load(s["sizes"], s["bits"])
    mark, docs, owner = unpack_plain(s["prints"], np.uint32), unpack_plain(s["docs"], np.uint8), unpack_plain(s["owner"], np.int64)
    doc, place, prints = (_column(sent, c, t) for c, t in (("doc", np.int64), ("place", np.uint64), ("print", np.uint32)))
    at = mph(place)
    drop = (mark[at] == prints) & (docs[at] > 1) & (owner[at] != doc)
    out = pd.DataFrame({"doc_id": doc[drop], "mark": _column(sent, "text", np.int64)[drop], "line": _column(sent, "line", np.uint32)[drop].astype(np.int64)})
    grouped = out.groupby(["doc_id", "mark"], sort=False)["line"].agg(list).reset_index()
    return pa.table([pa.array(grouped["doc_id"], pa.int64()), pa.array(grouped["mark"], pa.int64()), pa.array(grouped["line"].tolist(), pa.list_(pa.int64()))], names=["doc_id", "mark", "lines"])


def _without(lines, drop):
    """`lines` without the numbers in the sorted array `drop`: the slices between them, in one walk."""
    bounds = F.concat(F.array(F.lit(-1).cast("long")), drop, F.array(F.size(lines).cast("long")))
    gaps = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda k: F.slice(lines, (F.get(bounds, k - 1) + 2).cast("int"), (F.get(bounds, k) - F.get(bounds, k - 1) - 1).cast("int")))
    return F.flatten(gaps)


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """Every row of `docs` with its columns, and n_lines, n_dropped and kept_text.

    Lines whose key has `MIN_CHARS` code points or more and stands in two documents or more stay only in the smallest
    doc_id that holds it (there all of them).  A null or empty text is one empty line, its kept_text is empty.
    Rows that share a doc_id are one document.  A row without doc_id loses and claims no line.  Columns of `docs` named
    like the three new ones are replaced.
    """
    spark = docs.sparkSession
    ranges = key_ranges(spark)
    mark = F.xxhash64("text")
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), "text")
    sent = stage(rows.mapInArrow(lambda it: _send(it, ranges), _SENT), "lines")
    index = stage(sent.groupBy("r").applyInArrow(_build, _INDEX), "line-index")
    hits = sent.groupBy("r").cogroup(index.groupBy("r")).applyInArrow(_probe, "doc_id long, mark long, lines array<long>")
    hits = hits.groupBy(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("_drop"))
    plain = docs.drop("n_lines", "n_dropped", "kept_text").withColumn("_at", F.col("doc_id").cast("long")).withColumn("_of", mark)
    out = plain.join(hits, (F.col("_at") == F.col("_doc")) & (F.col("_of") == F.col("_mark")), "left")
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    kept = F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(_without(lines, F.col("_drop")), "\n"))
    return out.select(*docs.drop("n_lines", "n_dropped", "kept_text").columns, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
