"""Deterministic trajectory-level splits. Ranks inside a class are computed bucket by bucket."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators import ordered
from tracewell.operators.ordered import BUCKET, attach

PARTITIONS = ("train", "validation", "test")


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str | None = "_n", rows_per_bucket: int = 10_000) -> DataFrame:
    """Zero-based rank by numeric `order[0]` (then the rest) plus the class size; a numeric `order[1]` also splits large ties."""
    placed = ordered.quantile_bucket(df, keys, order[0], rows_per_bucket)
    if len(order) > 1 and isinstance(df.schema[order[1]].dataType, T.NumericType):
        placed = ordered.split_ties(placed, keys, order[0], order[1], rows_per_bucket)
    ranked = ordered.row_numbers(placed, keys, list(order), "_rank", size)
    return ranked.withColumn("_rank", F.col("_rank") - 1).drop(BUCKET)


def _hash_ranked(df: DataFrame, keys: Sequence[str], digest: Column, id: str, digits: int = 4) -> DataFrame:
    """Zero-based rank by digest; the digest's leading digits are the buckets."""
    placed = ordered.hash_bucket(df.withColumn("_digest", digest), "_digest", digits)
    ranked = ordered.row_numbers(placed, keys, ["_digest", id], "_rank", "_n")
    return ranked.withColumn("_rank", F.col("_rank") - 1).drop(BUCKET, "_digest")


def seeded_digest(seed: Column | int, id: str) -> Column:
    s = seed if isinstance(seed, Column) else F.lit(seed)
    return F.sha2(F.concat(s.cast("string"), F.lit("|"), F.col(id).cast("string")), 256)


def interleaved(df: DataFrame, keys: Sequence[str], id: str, modulus: int = 10, min_size: int = 3) -> DataFrame:
    """Every `modulus`-th trajectory by id goes to test, the next one to validation; tiny classes only train."""
    r = _ranked(df, keys, [id])
    phase = F.col("_rank") % modulus
    part = (
        F.when(F.col("_n") < min_size, "train").when(phase == 0, "test").when(phase == 1, "validation").otherwise("train")
    )
    return r.withColumn("partition", part).drop("_rank", "_n")


def contiguous_folds(df: DataFrame, case: str, size: int, folds: int) -> DataFrame:
    """One row per (fold, case): block `fold` of consecutive case numbers is the test part."""
    return df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn(
        "partition", F.when(F.floor((F.col(case) - 1) / size) == F.col("fold"), "test").otherwise("train")
    )


def repeated_stratified(df: DataFrame, label: str, id: str, seeds: Sequence[int], test: float = 0.2, validation: float = 0.2) -> DataFrame:
    """Hash-ordered 60/20/20 split per class for each seed; the same everywhere SHA-256 exists."""
    rows = df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    r = _hash_ranked(rows, ["seed", label], seeded_digest(F.col("seed"), id), id)
    n_test = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(test), 0).cast("long"))
    n_val = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(validation), 0).cast("long"))
    part = F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + n_val, "validation").otherwise("train")
    return r.withColumn("partition", part).withColumn("split_id", F.concat(F.lit("seed_"), F.col("seed").cast("string"))).drop("_rank", "_n")


def _test_count() -> Column:
    return F.greatest(F.lit(1), F.ceil(F.round(F.col("_n") * F.lit(0.2), 9)))


def _fifth(n: Column) -> Column:
    """Python's round(0.2 n): half to even, at least one."""
    return F.greatest(F.lit(1).cast("long"), F.bround(F.round(n * F.lit(0.2), 9), 0).cast("long"))


def severity_blocked(df: DataFrame, label: str, severity: str, id: str, min_size: int = 6) -> DataFrame:
    """Low, middle and high severity blocks held out in turn, with guard rows beside the block."""
    r = _ranked(df, [label], [severity, id]).where(F.col("_n") >= min_size)
    rows = r.withColumn("split_id", F.explode(F.array(F.lit("low_block"), F.lit("middle_block"), F.lit("high_block"))))
    n, k, tc = F.col("_n"), F.col("_rank"), F.col("_tc")
    rows = rows.withColumn("_tc", _test_count())
    start = (
        F.when(F.col("split_id") == "low_block", F.lit(0))
        .when(F.col("split_id") == "high_block", n - tc)
        .otherwise(F.greatest(F.lit(0), F.floor((n - tc) / 2)))
    )
    rows = rows.withColumn("_s", start)
    s = F.col("_s")
    is_test = (k >= s) & (k < s + tc)
    low_guard, high_guard = (s - 1 >= 0).cast("int"), (s + tc < n).cast("int")
    is_guard = (k == s - 1) | (k == s + tc)
    avail = n - tc - low_guard - high_guard
    val = _fifth(avail)
    # position among the rows that are neither test nor guard
    pos = F.when(k < s, k).otherwise(k - tc - low_guard - high_guard)
    part = F.when(is_test, "test").when(is_guard, "gap_excluded").when(pos >= avail - val, "validation").otherwise("train")
    return rows.where(avail - val >= 1).withColumn("partition", part).withColumn("split_type", F.lit("severity_blocked")).drop(
        "_n", "_rank", "_tc", "_s"
    )


def extrapolation(df: DataFrame, label: str, severity: str, id: str, min_size: int = 6) -> DataFrame:
    """Train on one end of the severity range and test on the other, one guard row in between."""
    r = _ranked(df, [label], [severity, id]).where(F.col("_n") >= min_size).withColumn("_tc", _test_count())
    rows = r.withColumn("split_id", F.explode(F.array(F.lit("low_train_to_high_test"), F.lit("high_train_to_low_test"))))
    n, tc = F.col("_n"), F.col("_tc")
    # distance from the test end, so that both directions share one rule
    k = F.when(F.col("split_id") == "low_train_to_high_test", n - 1 - F.col("_rank")).otherwise(F.col("_rank"))
    rest = n - tc - 1
    val = _fifth(rest)
    part = F.when(k < tc, "test").when(k == tc, "gap_excluded").when(k <= tc + val, "validation").otherwise("train")
    return rows.where(rest - val >= 1).withColumn("partition", part).withColumn("split_type", F.lit("severity_extrapolation")).drop(
        "_n", "_rank", "_tc"
    )


def release_protocol(df: DataFrame, label: str, id: str, seed: int, locked: str = "test") -> DataFrame:
    """Keep the locked test partition, re-split the rest per class into train / validation / calibration."""
    held = df.where(F.col("partition") == locked).withColumn("release_partition", F.lit("locked_release_test"))
    pool = df.where(F.col("partition").isin("train", "validation"))
    r = _hash_ranked(pool, [label], seeded_digest(seed, id), id)
    n = F.col("_n")
    fifth = F.greatest(F.lit(1).cast("long"), F.bround(F.round(n * F.lit(0.2), 9), 0).cast("long"))
    cal = F.when(n >= 3, fifth).otherwise(F.lit(0))
    val = F.when(n >= 4, fifth).otherwise(F.lit(0))
    part = (
        F.when(F.col("_rank") < cal, "calibration")
        .when(F.col("_rank") < cal + val, "development_validation")
        .otherwise("development_train")
    )
    return held.unionByName(r.withColumn("release_partition", part).drop("_rank", "_n"))


def named_sets(records: DataFrame, sets: Mapping[str, tuple[str, str | None]], label: str, partition: str = "release_partition") -> DataFrame:
    """Rows of each named set: (partition, optional class). The set list is a literal."""
    hits = F.array(*[
        F.when((F.col(partition) == p) & (F.lit(True) if c is None else F.col(label) == c), F.lit(name)) for name, (p, c) in sets.items()
    ])
    return records.withColumn("set", F.explode(F.array_compact(hits)))


def half_split(df: DataFrame, case: str, limit: int) -> DataFrame:
    return df.withColumn("partition", F.when(F.col(case) <= limit, "train").otherwise("test"))


def cross_direction(df: DataFrame, direction: str, values: Sequence[str]) -> DataFrame:
    """Train on one direction and test on the other, for each direction in turn."""
    return df.withColumn("train_direction", F.explode(F.array(*[F.lit(v) for v in values]))).withColumn(
        "partition", F.when(F.col(direction) == F.col("train_direction"), "train").otherwise("test")
    )


def overlap_audit(sets: DataFrame, id: str = "sample_id") -> DataFrame:
    """Overlap of every unordered pair of named sets, with a content hash of the shared ids.

    Grouping the set names per id keeps it to one shuffle; an id lists its few set names,
    never the ids of a set.  The hash is order-free and covers the whole digests.
    """
    names = sets.select("set", id).distinct()
    per_id = names.groupBy(id).agg(F.array_sort(F.collect_set("set")).alias("_s"))
    pairs = per_id.select(
        id, F.explode(F.flatten(F.transform("_s", lambda a: F.transform(F.filter("_s", lambda c: c > a), lambda c: F.struct(a.alias("l"), c.alias("r")))))).alias("_p")
    )
    shared = pairs.groupBy(F.col("_p.l").alias("left_set"), F.col("_p.r").alias("right_set")).agg(
        F.count(F.lit(1)).alias("overlap"), id_set_digest(id).alias("overlap_digest"))
    every = names.agg(F.array_sort(F.collect_set("set")).alias("_s")).select(F.explode(F.flatten(F.transform(
        "_s", lambda a: F.transform(F.filter("_s", lambda c: c > a), lambda c: F.struct(a.alias("l"), c.alias("r")))))).alias("_p"))
    grid = every.select(F.col("_p.l").alias("left_set"), F.col("_p.r").alias("right_set"))
    return attach(grid, shared, ["left_set", "right_set"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)).cast("long"))


def id_set_digest(id: str) -> Column:
    """Order-free digest of a set of ids: decimal sums of the five limbs (13 hex digits, the last 12) of each SHA-256."""
    sha = F.sha2(F.col(id).cast("string"), 256)
    limbs = [F.sum(F.conv(F.substring(sha, 13 * k + 1, 13), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(5)]
    return F.concat(limbs[0], *[x for limb in limbs[1:] for x in (F.lit("-"), limb)])
