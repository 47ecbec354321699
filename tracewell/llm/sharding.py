"""Sharding by sampled splitters: near equal bytes, with copies of a text side by side.

Rows have the key (hash of the text, doc_id).  A sample whose chances grow with a row's size gives keys at equal
steps of bytes; they split the keys into ranges.  Ranges found overfull (a hot text, bad luck) are sampled
again by themselves and subdivided.  Within ranges rows are sorted and their bytes added up; with the bytes of the
ranges before, each row knows the bytes in front of it, and its middle decides its shard.  So shards
differ by about one row's size, and equal texts share a shard unless a border falls between them.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.shared import stage

#: Bytes that a range is meant to hold, and the least number of ranges. The driver holds DRAWS keys of 32 bytes for each.
RANGE_BYTES, MIN_RANGES = 1 << 30, 256
#: Keys drawn for each range.
DRAWS = 16
#: A range of more than so many times the mean is subdivided.
OVERFULL = 2.0
MAX_ROUNDS = 6


def _key(text: str, doc_id: str) -> Column:
    """Sortable key of 32 hex digits: hash of the text, then doc_id with its sign bit turned, null first."""
    d = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(d), 16, "0"))


def _draw(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n keys, drawn without replacement with chances that grow with the size (smallest exponential clocks)."""
    u = (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return rows.select("key", (-F.log(u) / F.col("size")).alias("clock")).orderBy("clock", "key").limit(n).select("key")


def _splitters(sample: DataFrame, parts: int) -> list[str]:
    """Keys at the quantile borders of a sample; `parts` of them at most."""
    keys = [r[0] for r in sample.orderBy("key").collect()]  # DRAWS for each range asked for
    step = max(1, len(keys) // parts)
    return keys[step - 1 :: step]


def _ranged(rows: DataFrame, splitters: list[str]) -> DataFrame:
    """`rows` with range: the number of splitters at or before the row's key, by binary search."""
    keys = F.split(F.lit(",".join(splitters)), ",")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(splitters).bit_length()))])
    return rows.withColumn("range", F.aggregate(steps, F.lit(0), lambda a, s: F.when(F.get(keys, a + s - 1) <= F.col("key"), a + s).otherwise(a)))


def shard_by_bytes(docs: DataFrame, shards: int) -> DataFrame:
    """Columns of `docs` (doc_id, text, ...) with size, shard and slot (gapless from 0 in its shard).

    size: UTF-8 bytes of the text (null: none) plus 1.  A null doc_id sorts first.  Rows of equal doc_id and text have one
    key: they stay in one range, in any order among themselves.  Columns named size, shard or slot
    are replaced.  An empty table gives no rows.
    """
    docs = docs.drop("size", "shard", "slot")
    own = docs.columns
    keyed = docs.withColumns({"size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1, "key": _key("text", "doc_id")})
    slim = keyed.select("key", "size")
    total, many = slim.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not many:
        return keyed.select(*own, "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = max(MIN_RANGES, -(-total // RANGE_BYTES))
    splitters = sorted(set(_splitters(_draw(slim, parts * DRAWS, 0), parts)))
    for k in range(MAX_ROUNDS):
        ranged = _ranged(slim, splitters)
        full = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        full = {r["range"]: r["bytes"] for r in full.where((F.col("bytes") > OVERFULL * total / parts) & (F.col("lo") < F.col("hi"))).collect()}
        if not full:
            break
        new = int(sum(-(-b * parts // total) for b in full.values()))
        more = _splitters(_draw(ranged.where(F.col("range").isin(list(full))), new * DRAWS, k + 1), new)
        splitters = sorted({*splitters, *more})
    ranged = _ranged(keyed, splitters)
    sums = stage(ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "ranges")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    w = W.partitionBy("range").orderBy("key")
    placed = ranged.withColumns({"_sum": F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)), "_row": F.row_number().over(w)}).join(sums, "range")
    middle = F.col("base") + F.col("_sum") - F.col("size") / 2
    placed = placed.select(*own, "size", F.least(F.lit(shards - 1), F.floor(middle * shards / total)).cast("int").alias("shard"), (F.col("first") + F.col("_row") - 1).alias("_at"))
    starts = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(starts), "shard").select(*own, "size", "shard", (F.col("_at") - F.col("_first")).cast("long").alias("slot"))
