"""Windowed trajectory features, rolling statistics and persistence detection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import ordered
from tracewell.operators.ordered import BUCKET
from tracewell.operators.quantiles import medians

STATS = ("last", "delta_t0", "mean", "std", "slope")


def in_window(t: str | Column, injection: float, window: float | Column) -> Column:
    """Half-open predicate (injection, injection + window]."""
    c = F.col(t) if isinstance(t, str) else t
    return (c > injection) & (c <= injection + window)


def window_summary(
    df: DataFrame, features: Sequence[str], windows: Sequence[float], injection: float,
    id: str = "sample_id", t: str = "t", min_length: bool = True,
) -> DataFrame:
    """One row per (trajectory, window): last, change from baseline, mean, spread and slope per feature.

    The baseline is the last row at or before the injection.  All windows come out of
    one aggregation; its partial step runs before the shuffle, so long trajectories do
    not gather in one task.  Windows longer than the trajectory are left out.
    """
    grid = F.array(*[F.lit(float(w)) for w in windows])
    horizon = injection + max(windows)
    rows = df.where(F.col(t) <= horizon).withColumn(
        "window_s", F.explode(F.filter(grid, lambda w: F.col(t) <= w + F.lit(injection)))
    )
    inside = F.col(t) > injection
    aggs = [F.max(F.when(inside, F.col(t))).alias("last_sample_s"), F.count(F.when(inside, 1)).alias("n_points")]
    for f in features:
        x = F.when(inside, F.col(f))
        aggs += [
            F.max_by(f, F.when(inside, F.col(t))).alias(f"{f}__last"),
            F.max_by(f, F.when(~inside, F.col(t))).alias(f"_{f}_t0"),
            F.avg(x).alias(f"{f}__mean"),
            F.stddev_pop(x).alias(f"{f}__std"),
            F.coalesce(F.regr_slope(x, F.col(t)), F.lit(0.0)).alias(f"{f}__slope"),
        ]
    out = rows.groupBy(id, "window_s").agg(*aggs)
    if min_length:
        ends = df.groupBy(id).agg(F.max(t).alias("_end"))
        out = out.join(ends, id).where(F.col("_end") >= F.col("window_s")).drop("_end")
    for f in features:
        out = out.withColumn(f"{f}__delta_t0", F.col(f"{f}__last") - F.col(f"_{f}_t0"))
    return out.where("n_points > 0").select(
        id, "window_s", "last_sample_s", "n_points", *[f"{f}__{s}" for f in features for s in STATS]
    )


def strict_pre_event(rows: DataFrame, event: str, last: str = "last_sample_s", out: str = "strict_pre_event") -> DataFrame:
    """Event known and later than the last used sample."""
    return rows.withColumn(out, F.col(event).isNotNull() & (F.coalesce(F.col(event) > F.col(last), F.lit(False))))


def landmark_dataset(
    df: DataFrame, events: DataFrame, features: Sequence[str], landmarks: Sequence[float], injection: float,
    event: str = "first_protection_s", id: str = "sample_id", t: str = "t",
) -> DataFrame:
    """Window summaries at each landmark for trajectories whose event is still ahead."""
    rows = window_summary(df, features, landmarks, injection, id, t).withColumnRenamed("window_s", "landmark_s")
    return (
        rows.join(events.select(id, event), id)
        .where(F.col(event) > F.col("landmark_s"))
        .withColumn("remaining_s", F.col(event) - F.col("landmark_s"))
    )


def rates(df: DataFrame, features: Sequence[str], step: float, width: float, id: str = "sample_id", t: str = "t") -> DataFrame:
    """First difference per feature divided by the grid step, NULL on the first row."""
    placed = ordered.time_bucket(df, t, width)
    near = ordered.neighbour(placed, [id], [t], {f"_p_{f}": f for f in features})
    for f in features:
        near = near.withColumn(f"{f}__rate", (F.col(f) - F.col(f"_p_{f}")) / F.lit(float(step)))
    return near.drop(BUCKET, *[f"_p_{f}" for f in features])


def rolling_slopes(
    df: DataFrame, features: Sequence[str], spans: Sequence[float], step: float, width: float,
    id: str = "sample_id", t: str = "t",
) -> DataFrame:
    """Trailing least-squares slope over each span of a regular grid, NULL until the span is full."""
    halo = ordered.with_halo(df, t, width, max(spans))
    for span in spans:
        k = int(round(span / step))
        w = Window.partitionBy(id, BUCKET).orderBy(t).rowsBetween(-k, 0)
        full = F.count(F.lit(1)).over(w) == k + 1
        for f in features:
            halo = halo.withColumn(f"{f}__slope_{span:g}", F.when(full, F.regr_slope(F.col(f), F.col(t)).over(w)))
    return halo.where("_core").drop("_core", BUCKET)


def feature_groups(
    df: DataFrame, features: Sequence[str], group: str, spans: Sequence[float], step: float, width: float,
    id: str = "sample_id", t: str = "t",
) -> DataFrame:
    """Group A static, B adds rates, C adds rolling slopes; rows before the group's warm-up are left out."""
    out = df.select(id, t, *features)
    warm = 0.0
    if group in ("B", "C"):
        out = rates(out, features, step, width, id, t)
        warm = step
    if group == "C":
        out = rolling_slopes(out, features, spans, step, width, id, t)
        warm = max(spans)
    start = df.groupBy(id).agg(F.min(t).alias("_start"))
    return out.join(start, id).where(F.col(t) - F.col("_start") >= warm).drop("_start")


def normalised_deviation(df: DataFrame, scales: Mapping[str, float | None], suffix: str = "_ref") -> DataFrame:
    """|x - ref| / scale per feature; a missing scale gives a missing score."""
    return df.select(
        "*", *[(F.abs(F.col(f) - F.col(f"{f}{suffix}")) / F.lit(s).cast("double")).alias(f"{f}__score") for f, s in scales.items()]
    )


def deviation_from_start(df: DataFrame, reference: DataFrame, features: Sequence[str], t: str = "t", least: float = 1e-6, suffix: str = "_ref") -> DataFrame:
    """|x - ref| relative to the size of the reference's first row; a size under `least` counts as 1.

    `df` carries the reference's values as `<feature><suffix>` (see `align.join_reference`).
    """
    start = reference.agg(*[F.abs(F.min_by(f, t)).alias(f"_start_{f}") for f in features])
    joined = ordered.attach_row(df, start)
    size = lambda f: F.when(F.col(f"_start_{f}") >= least, F.col(f"_start_{f}")).otherwise(F.lit(1.0))
    return joined.select(*df.columns, *[(F.abs(F.col(f) - F.col(f"{f}{suffix}")) / size(f)).alias(f"{f}__score") for f in features])


def persistent_alarm(
    df: DataFrame, score: str, threshold: float | Column, k: int, width: float, keys: Sequence[str] = ("sample_id",),
    t: str = "t", semantics: str = "strict", start_after: float | None = None, out: str = "first_alarm_s",
) -> DataFrame:
    """First time at which `score` has exceeded `threshold` on k consecutive rows.

    strict            a missing or non-finite score breaks the run
    legacy_off_by_one missing scores are skipped, and the low row in front of a run counts
                      towards it, so the alarm comes one sample earlier than strict
    """
    keys = list(keys)
    rows = df if start_after is None else df.where(F.col(t) > start_after)
    good = F.col(score).isNotNull() & ~F.isnan(score)
    if semantics == "legacy_off_by_one":
        rows = rows.where(good)
    elif semantics != "strict":
        raise ValueError(f"unknown semantics {semantics}")
    above = F.coalesce(good & (F.col(score) > threshold) & (F.col(score) != float("inf")), F.lit(False))
    if semantics == "legacy_off_by_one":
        above = F.coalesce(F.col(score) > threshold, F.lit(False))
    flagged = ordered.time_bucket(rows.withColumn("_above", above), t, width)
    runs = ordered.run_lengths(flagged, keys, [t], "_above", "_run", "_broken")
    length = F.col("_run")
    if semantics == "legacy_off_by_one":
        length = length + F.col("_broken").cast("int")
    return runs.groupBy(*keys).agg(F.min(F.when(F.col("_above") & (length >= k), F.col(t))).alias(out))


def alarm_vs_event(
    alarms: DataFrame, events: DataFrame, injection: float, event: str = "first_protection_s", id: str = "sample_id"
) -> DataFrame:
    """Detected, detected before the event, lead time and delay since injection."""
    a, e = F.col("first_alarm_s"), F.col(event)
    return alarms.join(events.select(id, event), id, "left").select(
        "*",
        a.isNotNull().alias("detected"),
        F.coalesce(a < e, F.lit(False)).alias("detected_before_event"),
        (e - a).alias("lead_time_s"),
        (a - injection).alias("delay_s"),
    )


def pre_injection_alarm(
    df: DataFrame, score: str, threshold: float, k: int, injection: float, width: float, id: str = "sample_id", t: str = "t"
) -> DataFrame:
    """Both published readings of a pre-injection alarm: any point above, and a persistent run."""
    pre = df.where(F.col(t) < injection)
    point = df.groupBy(id).agg(
        F.max(F.when(F.col(t) < injection, F.col(score))).alias("pre_injection_max"),
        F.coalesce(F.max(F.when(F.col(t) < injection, F.col(score) > threshold)), F.lit(False)).alias("pre_point_alarm"),
    )
    runs = persistent_alarm(pre, score, threshold, k, width, [id], t, out="_pre")
    return point.join(runs, id, "left").withColumn("pre_persistent_alarm", F.col("_pre").isNotNull()).drop("_pre")


def score_vector(
    long: DataFrame, value: str, early: float | None = None, id: str = "sample_id", feature: str = "feature", t: str = "t",
) -> DataFrame:
    """median, mean, max and last of each (trajectory, feature) score series, missing values skipped."""
    rows = long.where(F.col(value).isNotNull() & ~F.isnan(value))
    base = rows.groupBy(id, feature).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.max_by(value, t).alias("last")
    )
    out = base.join(medians(rows, [id, feature], value, "median"), [id, feature])
    if early is not None:
        out = out.join(medians(rows.where(F.col(t) <= early), [id, feature], value, "median_early"), [id, feature], "left")
    return out


def rank_features_at(
    long: DataFrame, score: str, times: Sequence[float], n: int, feature: str = "feature", t: str = "t"
) -> DataFrame:
    """Top-n features by largest score at each chosen time, over all trajectories."""
    top = long.where(F.col(t).isin([float(x) for x in times])).groupBy(t, feature).agg(F.max(score).alias("max_score"))
    w = Window.partitionBy(t).orderBy(F.col("max_score").desc_nulls_last(), feature)
    return top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def perturb_after(
    df: DataFrame, scales: DataFrame, features: Sequence[str], injection: float, factor: float = 0.001, t: str = "t"
) -> DataFrame:
    """Shift every post-injection sample by `factor` of the feature's training scale (one-row `scales`)."""
    joined = ordered.attach_row(df, scales)
    for f in features:
        joined = joined.withColumn(f, F.when(F.col(t) > injection, F.col(f) + factor * F.col(f"{f}_scale")).otherwise(F.col(f)))
    return joined.drop(*[f"{f}_scale" for f in features])


def to_long(df: DataFrame, ids: Sequence[str], features: Sequence[str], value: str = "x", feature: str = "feature") -> DataFrame:
    return df.unpivot(list(ids), list(features), feature, value)
