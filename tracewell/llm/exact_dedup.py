"""Exact dedup with heavy hitters split off.

Texts are equal when their SHA-256 is equal after every run of white space has become one space (with 10^12 different
texts, two of them share a digest with odds under 10^-53).  Misra-Gries summaries of the digests, one for each task,
add up to at most `COUNTERS` + 1 possible heavy hitters; an exact count among these names the winners, whose keepers
are broadcast, so that no copy of a heavy text is ever shuffled.  All other digests, none of which holds more than
2 / (COUNTERS + 1) of the rows, take an ordinary exchange.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import stage

#: Counters of a summary.  At most COUNTERS + 1 digests are broadcast, whatever the input.
COUNTERS = 1024


def normalised(text: Column) -> Column:
    """Text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def reduced(counts: dict[bytes, int], k: int) -> dict[bytes, int]:
    """At most `k` counters: the (k+1)-th largest is taken off all, so each loses at most 1 / (k+1) of what was counted."""
    if len(counts) <= k:
        return counts
    cut = heapq.nlargest(k + 1, counts.values())[-1]
    return {d: n - cut for d, n in counts.items() if n > cut}


def _summaries(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}
    for batch in batches:
        for d, n in Counter(batch.column(0).to_pylist()).items():
            held[d] = held.get(d, 0) + n
        held = reduced(held, k)
    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["digest", "low"])


def _order() -> Column:
    """Smallest doc_id first, null ids last; rows that share an id are told apart by their place in the input."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))


def heavy_hitters(rows: DataFrame, k: int = COUNTERS) -> DataFrame:
    """Digests that hold 2 / (k+1) of `rows` (digest, doc_id, row) or more: digest, first, n.  At most (k+1) / 2 rows.

    The summaries' sums fall short of the true counts by at most a (k+1)-th of all rows, so every such digest has a sum of
    that much, and since the sums add up to no more than all rows, at most k+1 digests have.
    """
    total = rows.count()
    low = rows.select("digest").mapInArrow(lambda it: _summaries(it, k), "digest binary, low long").groupBy("digest").agg(F.sum("low").alias("low"))
    likely = stage(low.where(F.col("low") * (k + 1) >= total).select("digest"), "likely")
    exact = rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n"))
    return stage(exact.where((F.col("n") * (k + 1) >= 2 * total) & (F.col("n") > 1)), "heavy")


def group_copies(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """One row for each row of `docs` (doc_id, text; other columns are ignored): doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the smallest doc_id among equal texts, group_size counts their rows.  Exactly one row of a group is kept; of
    rows with the same doc_id and text, the first.  Null and empty texts are equal; a null doc_id comes after all others
    and is a keep_id only where a group has no other.  Very long texts are hashed whole.  No rows give no rows.
    """
    rows = stage(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("digest")), "digests")
    heavy = heavy_hitters(rows, k)
    hot = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").repartition("digest")
    cold = rest.join(rest.groupBy("digest").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n")), "digest")
    found = hot.unionByName(cold)
    return found.select("doc_id", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """The rows of `docs` that `group_copies` keeps, with all their columns.

    Copies of a heavy text other than its keeper leave where they are read; only what is left is shuffled, by digest.
    """
    d = "__digest"
    while d in docs.columns:
        d += "_"
    marked = docs.withColumn(d, digest(F.col("text")))
    rows = stage(docs.select("doc_id", F.lit(0).alias("row"), digest(F.col("text")).alias("digest")), "digests")
    heavy = heavy_hitters(rows, k).select(F.col("digest").alias(d), F.struct("first").alias(d + "first"))
    left = marked.join(F.broadcast(heavy), d, "left").where(F.col(d + "first").isNull() | F.col("doc_id").eqNullSafe(F.col(d + "first")["first"]["id"]))
    first = Window.partitionBy(d).orderBy(F.col("doc_id").asc_nulls_last())
    return left.withColumn(d + "n", F.row_number().over(first)).where(F.col(d + "n") == 1).select(*docs.columns)
