"""Token-id files: Re-Pair grammar compression per shard, with random access by expansion lengths.

File format: a folder of Parquet files written by Spark, one row for each shard of about
`SHARD_TOKENS` ids, shards in ascending doc_id order:

- `part`, `piece`: order of the shards;  `vocab`: ids below it are tokens, from it on nonterminals;
- `no_id`: so many documents at the front have no doc_id (their number in `doc_ids` means nothing);
- little-endian numbers in bytes from here on.  `left`, `right`: 32 bits each, rule k says vocab + k -> left[k] right[k];  `span`: expansion length of each rule;
- `body`: 32 bits each, the compressed sequence;  `doc_ids`, `doc_tokens`: 64 bits each, the documents in order.

Re-Pair replaces the most frequent pair, then the next one, until no pair is frequent.  Here each round counts all adjacent
pairs of the shard and replaces all that are frequent at once; of occurrences that overlap, the more frequent pair, and
along equal counts every second one from the left.  Rounds go on until no pair is frequent.  Pairs never cross a document's end.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.tokens import default_path, encoder
from tracewell.session import shared_dir

SHARD_TOKENS = 1 << 21
#: A pair that is replaced has at least so many occurrences in its shard.
MIN_PAIR = 64
#: Bits of the slots that pairs are counted by first; the result does not depend on it.
_HASH = 20

_SHARD = "part int, piece int, vocab int, no_id int, left binary, right binary, span binary, body binary, doc_ids binary, doc_tokens binary"


def frequent(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rule number of the pair at each place (-1: not frequent), each rule's code, and its exact count.

    Pairs are counted by hash slot first: one below MIN_PAIR holds no frequent pair.  A slot of one pair has its exact count, the
    pairs that share a slot are sorted and counted one by one, so none of them is lost.
    """
    bits = min(_HASH, max(len(code).bit_length(), 1))
    slot = code * np.uint64(0x9E3779B97F4A7C15)
    slot >>= np.uint64(64 - bits)
    slot = slot.view(np.int64)
    count = np.bincount(slot, minlength=1 << bits)
    at = np.flatnonzero((count >= MIN_PAIR)[slot])
    held, mine = slot[at], code[at]
    one = np.zeros(1 << bits, np.uint64)
    one[held] = mine
    mixed = np.zeros(1 << bits, bool)
    mixed[held[one[held] != mine]] = True
    pure = np.flatnonzero((count >= MIN_PAIR) & ~mixed)
    rule = np.full(1 << bits, -1, np.int32)
    rule[pure] = np.arange(len(pure), dtype=np.int32)
    out = np.full(len(code), -1, np.int32)
    out[at] = rule[held]
    rest = at[mixed[held]]
    pairs, which, n = np.unique(code[rest], return_inverse=True, return_counts=True)
    often = n >= MIN_PAIR
    out[rest] = np.where(often, len(pure) + np.cumsum(often) - 1, -1)[which]
    return out, np.r_[one[pure], pairs[often]], np.r_[count[pure], n[often]]


def compress(ids: np.ndarray, ends: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: rules (left, right, expansion length) and the compressed sequence. `ends`: positions behind documents.

    A round never adds occurrences of a pair of old symbols.  So after the first one only pairs that were frequent or
    hold a new symbol are counted; no other pair can be frequent.
    """
    body = ids.astype(np.int32)
    last = np.zeros(len(body) + 1, bool)
    last[ends] = True
    last = last[1:]
    last[-1:] = True
    left, right = np.empty(0, np.int32), np.empty(0, np.int32)
    look = np.flatnonzero(~last)
    while len(look):
        base = vocab + len(left)
        code = body[look].astype(np.uint64)
        code *= np.uint64(base)
        code += body[look + 1].view(np.uint32)
        mine, pair, count = frequent(code)
        del code
        if not len(pair):
            break
        look, mine = look[mine >= 0], mine[mine >= 0]
        n = count[mine]
        # Of pairs that overlap the most frequent goes first; along equal counts every second one from the left.
        near = np.r_[False, np.diff(look) == 1]
        place = np.arange(len(look))
        head = np.maximum.accumulate(np.where(near & (np.diff(n, prepend=-1) == 0), 0, place))
        weight = 2 * n + ((place - head) % 2 == 0)
        wins = np.ones(len(look), bool)
        wins[1:] &= ~near[1:] | (weight[1:] > weight[:-1])
        wins[:-1] &= ~near[1:] | (weight[:-1] > weight[1:])
        at, mine = look[wins], mine[wins]
        used = np.bincount(mine, minlength=len(pair)) > 0
        left = np.r_[left, (pair[used] // np.uint64(base)).astype(np.int32)]
        right = np.r_[right, (pair[used] % np.uint64(base)).astype(np.int32)]
        body[at] = base + (np.cumsum(used) - 1)[mine]
        last[at] = last[at + 1]
        keep = np.ones(len(body), bool)
        keep[at + 1] = False
        open_ = np.zeros(len(body), bool)
        open_[look] = True
        open_[np.maximum(at - 1, 0)] = True
        body, last = body[keep], last[keep]
        look = np.flatnonzero(open_[keep] & ~last)
    return left, right, spans(left, right, vocab), body


def spans(left: np.ndarray, right: np.ndarray, vocab: int) -> np.ndarray:
    """Tokens that each rule stands for."""
    span = np.ones(len(left), np.int64)
    while len(left):
        size = np.r_[np.ones(vocab, np.int64), span]
        longer = size[left] + size[right]
        if np.array_equal(longer, span):
            break
        span = longer
    return span


def expand(body: np.ndarray, left: np.ndarray, right: np.ndarray, vocab: int) -> np.ndarray:
    """The ids that a (part of a) compressed sequence stands for."""
    span = spans(left, right, vocab)
    if span.sum() > max(len(body), 1 << 16):
        return _unfold(body, left, right, vocab)
    # Each rule is unfolded once, then every symbol is looked up.
    source = np.r_[np.arange(vocab, dtype=np.int32), _unfold(np.arange(vocab, vocab + len(left), dtype=np.int32), left, right, vocab)]
    n = np.r_[np.ones(vocab, np.int64), span][body]
    first = np.r_[np.arange(vocab), vocab + np.cumsum(span) - span][body]
    return source[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _unfold(body: np.ndarray, left: np.ndarray, right: np.ndarray, vocab: int) -> np.ndarray:
    while True:
        big = body >= vocab
        if not big.any():
            return body
        n = np.where(big, 2, 1)
        at = np.cumsum(n) - n
        out = np.repeat(body, n)
        out[at[big]] = left[body[big] - vocab]
        out[at[big] + 1] = right[body[big] - vocab]
        body = out


def document(shard, k: int) -> np.ndarray:
    """Random access: ids of the k-th document of a shard row, expanding only the symbols that cover it."""
    left, right, span, body = (np.frombuffer(shard[c], t) for c, t in (("left", "<i4"), ("right", "<i4"), ("span", "<i8"), ("body", "<i4")))
    n = np.frombuffer(shard["doc_tokens"], "<i8")
    begin = int(n[:k].sum())
    ends = np.cumsum(np.r_[np.ones(shard["vocab"], np.int64), span][body])
    i, j = np.searchsorted(ends, begin, side="right"), np.searchsorted(ends, begin + int(n[k]), side="left") + 1
    skip = begin - (int(ends[i - 1]) if i else 0)
    return expand(body[i:j], left, right, shard["vocab"])[skip : skip + int(n[k])]


def _shard(part: int, piece: int, vocab: int, ids: list[np.ndarray], sizes: list[np.ndarray], docs: list[pa.Array]) -> tuple:
    n, docs = np.concatenate(sizes), pa.concat_arrays(docs)
    left, right, span, body = compress(np.concatenate(ids), np.cumsum(n), vocab)
    # Documents without an id come first.
    return (part, piece, vocab, docs.null_count, *(x.astype(t).tobytes() for x, t in ((left, "<i4"), (right, "<i4"), (span, "<i8"), (body, "<i4"))), docs.fill_null(0).to_numpy().astype("<i8").tobytes(), n.astype("<i8").tobytes())


def _write_shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc, names = encoder(path), [c.split()[0] for c in _SHARD.split(", ")]
    part, piece, ids, docs, sizes, held = TaskContext.get().partitionId(), 0, [], [], [], 0
    vocab = max(len(enc.width), end_id + 1)

    def row():
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if isinstance(x, int) else pa.binary()) for x in _shard(part, piece, vocab, ids, sizes, docs)], names=names)

    for batch in batches:
        keys = batch.column(0)
        for i, j, got, ends in enc.column(batch.column(1)):
            got = np.insert(got, ends, enc.dtype.type(end_id))
            ends = np.r_[0, ends + np.arange(1, j - i + 1)]
            a = 0
            while a < j - i:
                # The document that fills the shard is its last one.
                b = min(int(np.searchsorted(ends, ends[a] + SHARD_TOKENS - held)), j - i)
                ids.append(got[ends[a] : ends[b]])
                sizes.append(np.diff(ends[a : b + 1]))
                docs.append(keys.slice(i + a, b - a))
                held += int(ends[b] - ends[a])
                a = b
                if held >= SHARD_TOKENS:
                    yield row()
                    piece, ids, docs, sizes, held = piece + 1, [], [], [], 0
    if ids:
        yield row()


def write(docs: DataFrame, folder: str, end_id: int, path: str | None = None) -> None:
    """Encode `docs` (doc_id, text) and write the shards to `folder` in ascending doc_id order, nulls first.

    A null text is an empty one: a single end id.  Rows that share a doc_id follow each other, ordered by text.
    Extra columns are not read.  An empty table gives a folder without shards.
    """
    path = path or default_path()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(lambda it: _write_shards(it, path, end_id), _SHARD).write.parquet(folder)


def _read_shard(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, s in pdf.iterrows():
        left, right, body = (np.frombuffer(s[c], "<i4") for c in ("left", "right", "body"))
        ids = expand(body, left, right, s["vocab"]).astype("<u4")
        docs, n = (np.frombuffer(s[c], "<i8") for c in ("doc_ids", "doc_tokens"))
        known = pd.array(docs, dtype="Int64")
        known[: s["no_id"]] = pd.NA
        ends = np.cumsum(n)
        crc = [zlib.crc32(ids[e - k : e]) for e, k in zip(ends, n, strict=True)]
        yield pd.DataFrame({"part": s["part"], "piece": s["piece"], "doc_id": known, "in_shard": ends - n, "n_tokens": n, "ids_crc32": np.array(crc, np.int64)})


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document, decoded from the files.

    `start` adds up whole shards before it; only one number for each shard is ordered, never the documents.
    """
    shards = spark.read.schema(_SHARD).parquet(folder)
    sized = shards.select("part", "piece", "doc_tokens").mapInPandas(
        lambda it: (p[["part", "piece"]].assign(n=[int(np.frombuffer(b, "<i8").sum()) for b in p["doc_tokens"]]) for p in it), "part int, piece int, n long"
    )
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sized.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    w = W.partitionBy("part").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    base = sized.join(parts, "part").select("part", "piece", (F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0))).alias("base"))
    decoded = shards.mapInPandas(lambda it: (x for p in it for x in _read_shard(p)), "part int, piece int, doc_id long, in_shard long, n_tokens long, ids_crc32 long")
    out = decoded.join(base, ["part", "piece"])
    return out.select("doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/llm-token-files-{uuid.uuid4().hex}"
