"""Lexical retrieval packing: BM25 neighbours of each seed document fill its window.

Documents are cut into units of at most `UNIT` ids, the units dealt by hash over shards of about
`SHARD_TOKENS` ids; retrieval never leaves a shard.  Each shard holds an inverted index over its whole units (terms are token ids; document
frequencies and the mean length are those of the whole corpus).  Whole windows of a unit are
sequences of their own.  What is left of the units is packed: a seed's unused neighbours are
taken in order of BM25 score and placed until the window is full; the last one is cut there, and what is
left of it is the next seed.  The last window of a shard is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import stage
from tracewell.llm.tokens import default_path, encoder

WINDOW = 2048
UNIT = 64 * WINDOW
#: Mean ids of a shard. A shard is one task's work; their number grows with the corpus.
SHARD_TOKENS = 1 << 18
K1, B = 1.2, 0.75

_UNIT_ROW = "doc_id long, start long, doc_tokens long, ids binary"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        for i, j, ids, ends in enc.column(batch.column(1)):
            ids = np.insert(ids, ends, enc.dtype.type(end_id))
            ends = ends + np.arange(1, j - i + 1)
            n = np.diff(ends, prepend=0)
            units = -(-n // UNIT)
            row = np.repeat(np.arange(j - i), units)
            start = (np.arange(len(row)) - (np.cumsum(units) - units)[row]) * UNIT
            off = np.r_[(ends - n)[row] + start, ends[-1]] * enc.dtype.itemsize
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(off), pa.py_buffer(ids)])
            doc = batch.column(0).slice(i, j - i).take(pa.array(row))
            for k in range(0, len(row), 1024):
                part = slice(k, k + 1024)
                yield pa.RecordBatch.from_arrays([doc[part], pa.array(start[part]), pa.array(n[row[part]]), raw[part].cast(pa.binary())], names=["doc_id", "start", "doc_tokens", "ids"])


def _terms(batches: Iterator[pa.RecordBatch], dtype: str, vocab: int) -> Iterator[pa.RecordBatch]:
    """Units that hold each token id; units and ids of the task under -1 and -2."""
    df, units, total = np.zeros(vocab, np.int64), 0, 0
    for batch in batches:
        for raw in batch.column("ids"):
            ids = np.frombuffer(raw.as_buffer(), dtype)
            df[np.unique(ids)] += 1
            units, total = units + 1, total + len(ids)
    t = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[t, -1, -2], pa.int64()), pa.array(np.r_[df[t], units, total], pa.int64())], names=["term", "n"])


class Index:
    """BM25 inverted index of a shard: postings by term, weights worked out when it is built."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean: float):
        owner = np.repeat(np.arange(len(units)), [len(u) for u in units])
        ids = np.concatenate(units).astype(np.int64)
        key, tf = np.unique(ids * len(units) + owner, return_counts=True)
        term, self.owner = key // len(units), key % len(units)
        size = np.array([len(u) for u in units], np.float64)
        norm = K1 * (1 - B + B * size[self.owner] / mean)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm)
        self.first = np.searchsorted(term, np.arange(len(idf) + 1))
        by = np.argsort(self.owner, kind="stable")
        self.query, self.query_first = term[by], np.searchsorted(self.owner[by], np.arange(len(units) + 1))
        self.units = len(units)

    def neighbours(self, seed: int) -> np.ndarray:
        """All units by falling score against the seed, ties by position."""
        q = self.query[self.query_first[seed] : self.query_first[seed + 1]]
        lo, n = self.first[q], self.first[q + 1] - self.first[q]
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        score = np.bincount(self.owner[at], self.weight[at], self.units)
        return np.argsort(-score, kind="stable")


def pack_units(units: list[np.ndarray], index: Index) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (unit, from, to). `units`: what is left of each document, shorter than a window."""
    used = np.array([len(u) == 0 for u in units])
    done, windows, seed, nxt = np.zeros(len(units), np.int64), [], -1, 0
    while True:
        if seed < 0:
            while nxt < len(units) and used[nxt]:
                nxt += 1
            if nxt == len(units):
                return windows
            seed = nxt
        window, room, cut = [], WINDOW, -1
        order = iter(index.neighbours(seed))
        u = seed
        while True:
            take = min(room, len(units[u]) - done[u])
            window.append((u, int(done[u]), int(done[u] + take)))
            done[u] += take
            room -= take
            used[u] = True
            if done[u] < len(units[u]):
                cut = u
            if not room:
                break
            u = next((int(v) for v in order if not used[v]), -1)
            if u < 0:
                break
        windows.append(window)
        seed = cut


def _powers(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Cut a window into sequences whose lengths are powers of two, the longest first."""
    left = sum(b - a for _, a, b in window)
    parts = list(window)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            u, a, b = parts.pop(0)
            k = min(room, b - a)
            out.append((u, a, a + k))
            room -= k
            if a + k < b:
                parts.insert(0, (u, a + k, b))
        yield out


def _pack_shard(table: pa.Table, dtype: str, stats) -> pa.Table:
    idf, mean = stats.value
    table = table.sort_by([("doc_id", "ascending"), ("start", "ascending")])
    shard = table.column("shard")[0].as_py()
    doc, start, total = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
    ids = [np.frombuffer(x.as_buffer(), dtype) for x in table.column("ids").combine_chunks()]
    seqs = [[(u, a, a + WINDOW)] for u, x in enumerate(ids) for a in range(0, len(x) - WINDOW + 1, WINDOW)]
    base = [len(x) // WINDOW * WINDOW for x in ids]
    tails = [x[b:] for x, b in zip(ids, base, strict=True)]
    for w in pack_units(tails, Index(ids, idf, mean)) if any(len(t) for t in tails) else []:
        w = [(u, a + base[u], b + base[u]) for u, a, b in w]
        seqs += [w] if sum(b - a for _, a, b in w) == WINDOW else list(_powers(w))
    rows = []
    for k, seq in enumerate(seqs):
        at = 0
        for u, a, b in seq:
            rows.append((doc[u], start[u] + a, b - a, zlib.crc32(ids[u][a:b].astype("<u4")), total[u], (shard << 32) + k, at))
            at += b - a
    names = [c.split()[0] for c in _PIECE.split(", ")]
    return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def pack(docs: DataFrame, end_id: int, path: str | None = None) -> DataFrame:
    """Pieces of all rows of `docs` (doc_id, text) in sequences of `WINDOW` ids.

    One row for each piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id,
    offset.  A null or empty text is the end id alone.  Rows that repeat a doc_id are packed each by itself, a null
    doc_id is kept.  Copies are packed like other documents.  An empty table gives no rows; extra columns are not read.
    """
    path = path or default_path()
    spark = docs.sparkSession
    enc = encoder(path)
    dtype, vocab = enc.dtype.str, max(len(enc.width), end_id + 1)
    units = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _encode(it, path, end_id), _UNIT_ROW), "encoded")
    counts = units.select("ids").mapInArrow(lambda it: _terms(it, dtype, vocab), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = dict(counts.collect())  # at most one row for each entry of the vocabulary
    many, total = n.pop(-1, 0), n.pop(-2, 0)
    df = np.zeros(vocab)
    df[list(n)] = list(n.values())
    stats = spark.sparkContext.broadcast((np.log1p((many - df + 0.5) / (df + 0.5)), total / max(many, 1)))
    shards = max(1, -(-total // SHARD_TOKENS))
    dealt = units.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", F.crc32("ids")), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInArrow(lambda t: _pack_shard(t, dtype, stats), _PIECE)
