"""Aligning trajectories with references, events, splits and each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators import ordered
from tracewell.operators.ordered import BUCKET, attach
from tracewell.session import cut_lineage


SALTS = 16


def _equi_with_reference(df: DataFrame, side: DataFrame, on: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Join many trajectories with a reference on (time-like) keys.

    Few distinct times carry all rows, so the rows of one time are spread over `salts` and the reference is
    copied once per salt.  The plan is the same for every size; whether a side is broadcast is left to
    the planner, which goes by bytes.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"]).drop("_salt")


def join_reference(df: DataFrame, ref: DataFrame, features: Sequence[str], on: Sequence[str] = ("t",)) -> DataFrame:
    """Exact-time join; reference columns get the suffix `_ref`."""
    return _equi_with_reference(df, ref.select(*on, *[F.col(f).alias(f"{f}_ref") for f in features]), on)


def interpolate_reference(
    df: DataFrame, ref: DataFrame, features: Sequence[str], bucket: float, keys: Sequence[str] = (), t: str = "t",
    segment: float | None = None,
) -> DataFrame:
    """Join each row with the linearly interpolated reference inside the reference's time range.

    The reference becomes segments [t0, t1); a segment is copied to each time bucket it
    touches, so the range condition turns into an equi-join plus a residual.
    """
    keyed = list(keys) or ["_ref_all"]
    r = ref.select(*keys, t, *features) if keys else ref.select(F.lit(1).alias("_ref_all"), t, *features)
    placed = ordered.time_bucket(r, t, segment or bucket)
    near = ordered.neighbour(placed, keyed, [t], {"_t1": t, **{f"_v1_{f}": f for f in features}}, "next")
    segs = near.select(
        *keys, F.col(t).alias("_t0"), "_t1", *[F.col(f).alias(f"_v0_{f}") for f in features], *[f"_v1_{f}" for f in features],
        F.explode(F.sequence(F.floor(F.col(t) / bucket), F.floor(F.coalesce("_t1", F.col(t)) / bucket))).alias("_slot"),
    )
    left = df.withColumn("_slot", F.floor(F.col(t) / bucket))
    hit = _equi_with_reference(left, segs, [*keys, "_slot"]).where(
        ((F.col(t) >= F.col("_t0")) & (F.col(t) < F.col("_t1"))) | (F.col("_t1").isNull() & (F.col(t) == F.col("_t0")))
    )
    share = (F.col(t) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    for f in features:
        v0, v1 = F.col(f"_v0_{f}"), F.col(f"_v1_{f}")
        hit = hit.withColumn(f"{f}_ref", F.when(F.col("_t1").isNull(), v0).otherwise(v0 + (v1 - v0) * share))
    return hit.select(*df.columns, *[f"{f}_ref" for f in features])


def join_events(df: DataFrame, events: DataFrame, id: str = "sample_id", how: str = "left") -> DataFrame:
    """Many rows to one event row per trajectory; repeated event rows fail the job."""
    n = events.groupBy(id).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[c for c in events.columns if c != id])).alias("_e"))
    checked = n.select(id, F.when(F.col("_n") == 1, F.col("_e")).otherwise(
        F.raise_error(F.concat(F.lit("more than one event row for "), F.col(id).cast("string")))).alias("_e"))
    out = df.join(checked, id, how)
    return out.select(*df.columns, *[F.col(f"_e.{c}").alias(c) for c in events.columns if c != id])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (empty when the key is unique)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pass `df` on; raise if `keys` is not unique. Runs one aggregation."""
    bad = duplicate_keys(df, keys).limit(1).collect()  # at most one row reaches the driver
    if bad:
        raise ValueError(f"key {list(keys)} is not unique, e.g. {bad[0].asDict()}")
    return df


def join_splits(rows: DataFrame, splits: DataFrame, id: str = "sample_id") -> DataFrame:
    """Feature rows times every split assignment of their trajectory."""
    return rows.join(splits, id)


def nearest_in_train(
    assigned: DataFrame, value: str = "severity", groups: Sequence[str] = ("split_id", "class"), id: str = "sample_id",
    partition: str = "test", train: str = "train", rows_per_bucket: int = 10_000,
) -> DataFrame:
    """Nearest train value of the same group for every row of `partition`; ties go to the lower value.

    One sort of train and test rows together with forward and backward fills: O(n log n), no pairs.
    """
    g = list(groups)
    both = assigned.where(F.col("partition").isin(partition, train)).withColumn(
        "_train", F.when(F.col("partition") == train, F.col(value).cast("double"))
    )
    both = cut_lineage(both.select(*g, id, "partition", value, "_train"))  # read for bounds, ties, summaries and fills
    placed = ordered.quantile_bucket(both, g, value, rows_per_bucket)
    if isinstance(both.schema[id].dataType, T.NumericType):
        # rows that share one value go train rows last, as in the order below, and then by id
        code = F.col("partition") == train if train > partition else F.col("partition") != train
        span = both.agg(F.min(id).alias("_i0"), (F.max(id) - F.min(id) + 1).alias("_i1"))
        placed = ordered.attach_row(placed, span).withColumn("_tie", code.cast("double") * F.col("_i1") + (F.col(id) - F.col("_i0")))
        placed = ordered.split_ties(placed.drop("_i0", "_i1"), g, value, "_tie", rows_per_bucket).drop("_tie")
    order = [value, "partition", id]
    both_ways = ordered.fill_both(placed, g, order, "_train", "_lo", "_hi")
    v = F.col(value).cast("double")
    d_lo, d_hi = v - F.col("_lo"), F.col("_hi") - v
    pick_lo = F.col("_hi").isNull() | (d_lo <= d_hi)
    return both_ways.where(F.col("partition") == partition).select(
        *g, id, v.alias("test_value"),
        F.when(pick_lo, F.col("_lo")).otherwise(F.col("_hi")).alias("nearest_train"),
        F.when(pick_lo, d_lo).otherwise(d_hi).alias("gap"),
    )


def restrict(df: DataFrame, cohort: DataFrame, id: str = "sample_id") -> DataFrame:
    return df.join(cohort.select(id), id, "left_semi")


def in_all_windows(rows: DataFrame, windows: Sequence[float], id: str = "sample_id", window: str = "window_s") -> DataFrame:
    """Ids present in every one of the given windows."""
    wanted = rows.where(F.col(window).isin([float(w) for w in windows]))
    return wanted.groupBy(id).agg(F.countDistinct(window).alias("_k")).where(F.col("_k") == len(windows)).select(id)


def missing_keys(expected: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    return expected.join(present.select(*on), list(on), "left_anti")


def match_condition(runs: DataFrame, references: DataFrame, condition: Sequence[str], id: str = "scenario_id") -> DataFrame:
    """Pair each scenario with the reference scenario run under the same conditions."""
    side = references.select(*condition, F.col(id).alias("reference_id"))
    return runs.join(side, list(condition), "inner")


def baseline_delta(metrics: DataFrame, keys: Sequence[str], group: str, baseline: str, value: str) -> DataFrame:
    """Difference of each row's metric to the baseline group's metric under the same keys."""
    base = metrics.where(F.col(group) == baseline).select(*keys, F.col(value).alias(f"{value}_baseline"))
    return metrics.join(base, list(keys), "left").withColumn(f"{value}_delta", F.col(value) - F.col(f"{value}_baseline"))


def flag_selected(rows: DataFrame, selected: DataFrame, keys: Sequence[str], out: str = "validation_selected") -> DataFrame:
    side = selected.select(*keys).distinct().withColumn(out, F.lit(True))
    return rows.join(side, list(keys), "left").withColumn(out, F.coalesce(out, F.lit(False)))


def dense_confusion(pred: DataFrame, keys: Sequence[str], labels: Sequence[str], truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """Counts for the full label grid including zeros. The grid has len(labels)^2 literal cells per key."""
    if not keys:
        return dense_confusion(pred.withColumn("_all", F.lit(1)), ["_all"], labels, truth, guess).drop("_all")
    arr = F.array(*[F.lit(x) for x in labels])
    counts = pred.groupBy(*keys, truth, guess).agg(F.count(F.lit(1)).alias("count"))
    grid = counts.select(*keys).distinct().withColumn(truth, F.explode(arr)).withColumn(guess, F.explode(arr))
    return attach(grid, counts, [*keys, truth, guess], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))


def unordered_pairs(confusion: DataFrame, keys: Sequence[str], truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """Forward plus reverse counts of each unordered pair of different labels."""
    a, b = F.least(truth, guess), F.greatest(truth, guess)
    return (
        confusion.where(F.col(truth) != F.col(guess))
        .groupBy(*keys, a.alias("left_class"), b.alias("right_class"))
        .agg(
            F.coalesce(F.sum(F.when(F.col(truth) < F.col(guess), F.col("count"))), F.lit(0)).alias("forward_count"),
            F.coalesce(F.sum(F.when(F.col(truth) > F.col(guess), F.col("count"))), F.lit(0)).alias("reverse_count"),
        )
        .withColumn("pair_count", F.col("forward_count") + F.col("reverse_count"))
    )
