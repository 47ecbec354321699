"""Reference-based detectors: fit on one normal trajectory, score every trajectory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import aggregates as agg
from tracewell.operators import align, gram
from tracewell.operators import windows as win
from tracewell.operators.quantiles import quantiles

METHODS = ("robust_z", "mahalanobis", "pca_error")


@dataclass(frozen=True)
class ReferenceModel:
    center: dict[str, float]
    scale: dict[str, float]
    inactive: tuple[str, ...]
    precision: np.ndarray
    shrinkage: float
    axes: np.ndarray
    thresholds: dict[str, float]
    mean: dict[str, float]  # raw reference means, which the principal axes start from

    @property
    def features(self) -> list[str]:
        return list(self.center)


def row_median(values: Column) -> Column:
    """Median of a short array; missing entries are skipped, NULL when none is left."""
    s = F.array_sort(F.array_compact(values))
    n = F.size(s)
    at = lambda k: F.element_at(s, F.floor(k).cast("int"))
    return F.when(n > 0, (at((n + 1) / 2) + at((n + 2) / 2)) / 2)


def standardised(center: Mapping[str, float], scale: Mapping[str, float]) -> Column:
    return F.array(*[(F.col(f) - F.lit(center[f])) / F.lit(scale[f]) for f in center])


def robust_z(center: Mapping[str, float], scale: Mapping[str, float]) -> Column:
    """Median over features of |x - center| / scale."""
    return row_median(F.transform(standardised(center, scale), lambda z: F.abs(z)))


def score_rows(df: DataFrame, model: ReferenceModel) -> DataFrame:
    """The three scores as columns; narrow, no shuffle."""
    z = standardised(model.center, model.scale)
    centred = standardised(model.mean, model.scale)
    return df.select(
        "*", robust_z(model.center, model.scale).alias("robust_z"),
        F.sqrt(gram.quadratic_form(z, model.precision)).alias("mahalanobis"), gram.reconstruction_rmse(centred, model.axes).alias("pca_error"),
    )


def fit_robust(reference: DataFrame, features: Sequence[str], id: str = "sample_id", t: str = "t") -> tuple[dict[str, float], dict[str, float], tuple[str, ...]]:
    """center and scale of the active features; a handful of numbers per feature on the driver."""
    params = agg.robust_scale(win.to_long(reference, [id, t], features)).collect()
    by = {r["feature"]: r for r in params}
    active = [f for f in features if f in by and by[f]["active"]]
    if len(active) < 2:
        raise ValueError("too few features vary on the reference")
    return {f: by[f]["center"] for f in active}, {f: by[f]["scale"] for f in active}, tuple(f for f in features if f not in active)


def fit_reference(
    reference: DataFrame, features: Sequence[str], calibration_end: float | None = None, quantile: float = 0.995,
    share: float = 0.95, id: str = "sample_id", t: str = "t",
) -> ReferenceModel:
    """Centres, shrunk precision, principal axes and alarm thresholds, all from the reference only."""
    rows = (reference if calibration_end is None else reference.where(F.col(t) <= calibration_end)).persist()
    center, scale, inactive = fit_robust(rows, features, id, t)
    m = gram.fit_moments(rows, standardised(center, scale))
    lw = gram.ledoit_wolf(m)
    mean = rows.agg(*[F.avg((F.col(f) - center[f]) / scale[f]).alias(f) for f in center]).first()
    mu = np.array([mean[f] for f in center])
    axes = gram.principal_axes(gram.Moments(m.n, m.quartic, m.gram - m.n * np.outer(mu, mu)), share)
    raw = {f: center[f] + mean[f] * scale[f] for f in center}
    model = ReferenceModel(center, scale, inactive, lw.precision, lw.shrinkage, axes, {}, raw)
    long = score_rows(rows, model).unpivot([t], list(METHODS), "method", "score")
    cut = {r["method"]: r["q"] for r in quantiles(long, ["method"], "score", {"q": quantile}).collect()}
    rows.unpersist()
    return ReferenceModel(center, scale, inactive, lw.precision, lw.shrinkage, axes, cut, raw)


def evaluate_detectors(
    df: DataFrame, model: ReferenceModel, events: DataFrame, reference_ids: Sequence, k: int, width: float, injection: float,
    id: str = "sample_id", t: str = "t",
) -> tuple[DataFrame, DataFrame]:
    """Case rows per (trajectory, method) and the summary per method, the reference itself as false-alarm check."""
    long = score_rows(df, model).unpivot([id, t], list(METHODS), "method", "score")
    limit = F.element_at(F.create_map(*[F.lit(v) for kv in model.thresholds.items() for v in kv]), F.col("method"))
    alarms = win.persistent_alarm(long.withColumn("_limit", limit), "score", F.col("_limit"), k, width, [id, "method"], t)
    cases = win.alarm_vs_event(alarms, events, injection, id=id).withColumn("is_reference", F.col(id).isin(list(reference_ids)))
    summary = agg.detection_summary(cases.where(~F.col("is_reference")), ["method"])
    own = cases.where("is_reference").groupBy("method").agg(F.count_if("detected").alias("reference_false_alarms"))
    return cases, summary.join(own, "method", "left")


def detector_cases(
    long: DataFrame, events: DataFrame, starts: DataFrame, k: int, width: float, event: str = "first_protection_s", start: str = "injection_s",
    id: str = "sample_id", t: str = "t",
) -> DataFrame:
    """Case rows per (trajectory, method) from scores with their limits (id, t, method, score, limit), each judged after its own start.

    first_alarm_s is the first of k consecutive rows over the limit among the rows after the trajectory's `start`, delay_s counts from there;
    points_above counts all rows over the limit after the start.  A trajectory without a start is judged from time 0 on.
    """
    begun = long.join(starts.select(id, F.col(start).alias("_start")), id, "left").withColumn("_start", F.coalesce("_start", F.lit(0.0))).where(F.col(t) > F.col("_start"))
    groups = [id, "method"]
    points = begun.groupBy(*groups).agg(F.max("_start").alias("start_s"), F.count(F.lit(1)).alias("points"), F.count_if(F.col("score") > F.col("limit")).alias("points_above"))
    alarms = win.persistent_alarm(begun.drop("_start"), "score", F.col("limit"), k, width, groups, t)
    a, e = F.col("first_alarm_s"), F.col(event)
    return points.join(alarms, groups).join(events.select(id, event), id, "left").select(
        *groups, "start_s", "points", "points_above", "first_alarm_s", event, a.isNotNull().alias("detected"),
        F.coalesce(a < e, F.lit(False)).alias("detected_before_event"), (e - a).alias("lead_time_s"), (a - F.col("start_s")).alias("delay_s"))


def deviation_gate(
    df: DataFrame, reference: DataFrame, features: Sequence[str], scales: Mapping[str, float | None], threshold: float, k: int,
    bucket: float, width: float, keys: Sequence[str] = (), id: str = "sample_id", t: str = "t", semantics: str = "legacy_off_by_one",
) -> DataFrame:
    """Rule gate: composite deviation from the interpolated reference, first persistent alarm and peak."""
    aligned = align.interpolate_reference(df, reference, features, bucket, keys, t, segment=width)
    scored = win.normalised_deviation(aligned, scales).withColumn("composite", row_median(F.array(*[f"{f}__score" for f in features])))
    groups = [id, *keys]
    alarm = win.persistent_alarm(scored, "composite", threshold, k, width, groups, t, semantics)
    peak = scored.groupBy(*groups).agg(F.max("composite").alias("peak_score"))
    return peak.join(alarm, groups, "left")
