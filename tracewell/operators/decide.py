"""Batch diagnosis: gate, features, model, prediction set, distance, policy and views."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import label_set, map_label
from tracewell.operators import audit, gram, learn
from tracewell.operators import windows as win
from tracewell.operators.calibrate import Calibrated, fit_calibrated
from tracewell.operators.quantiles import order_statistics, quantiles
from tracewell.operators.aggregates import conformal_rank
from tracewell.operators.ranking import best_per_group
from tracewell.session import cut_lineage

TIER_DEFAULT = "Tier C"


def status_policy(set_size: Column, ood: Column, tier: Column) -> Column:
    """Order matters: an out-of-distribution warning is looked at before the tier."""
    return (
        F.when(set_size == 0, "unknown")
        .when((set_size > 1) | ood, "requires_review")
        .when(tier == "Tier C", "unknown")
        .when(tier == "Tier B", "requires_review")
        .otherwise("accepted")
    )


def capability(family: Column, tiers: Mapping[str, str]) -> Column:
    """Tier of a family from the literal capability table, tier C when it is not listed."""
    return map_label(family, tiers, TIER_DEFAULT)


@dataclass(frozen=True)
class ClassDistance:
    """Standardisation plus mean and shrunk precision per class, and the overall one as fallback."""

    mean: np.ndarray
    scale: np.ndarray
    centers: dict
    precisions: dict

    def z(self, x: str) -> Column:
        lit = lambda vs: F.array(*[F.lit(float(v)) for v in vs])
        return F.zip_with(F.zip_with(F.col(x), lit(self.mean), lambda a, m: a - m), lit(self.scale), lambda a, s: a / s)

    def parts(self, x: str, guess: str) -> Column:
        """Struct for the predicted class: the squared distance by the whole precision matrix, the displacement of each
        feature, and the diagonal share of each; NULL for a class without a model."""
        order = {c: i for i, c in enumerate(self.centers)}
        mus, precisions = [np.asarray(m) for m in self.centers.values()], [np.asarray(p) for p in self.precisions.values()]
        number = F.coalesce(*[F.when(F.col(guess) == c, F.lit(i)) for c, i in order.items()], F.lit(-1))

        @F.pandas_udf("distance double, displacement array<double>, diagonal array<double>")
        def products(z: pd.Series, which: pd.Series) -> pd.DataFrame:
            out = pd.DataFrame({"distance": np.full(len(z), np.nan), "displacement": None, "diagonal": None}, index=z.index).astype({"displacement": object, "diagonal": object})
            for i, (mu, p) in enumerate(zip(mus, precisions)):
                mine = (which == i).to_numpy()
                if mine.any():
                    d = np.vstack(z[mine].to_numpy()) - mu
                    out.loc[mine, "distance"] = ((d @ p) * d).sum(axis=1)
                    out.loc[mine, "displacement"] = pd.Series(list(d), index=z.index[mine])
                    out.loc[mine, "diagonal"] = pd.Series(list(np.maximum(d * d * np.diag(p), 0.0)), index=z.index[mine])
            return out

        return F.when(number >= 0, products(self.z(x), number))

    def score(self, x: str, guess: str) -> Column:
        """Squared distance to the predicted class, NULL for a class without a model."""
        out = F.lit(None).cast("double")
        for c, mu in self.centers.items():
            delta = F.zip_with(self.z(x), F.array(*[F.lit(float(v)) for v in mu]), lambda a, m: a - m)
            out = F.when(F.col(guess) == c, gram.quadratic_form(delta, self.precisions[c])).otherwise(out)
        return out


def fit_class_distance(train: DataFrame, label: str, labels: Sequence, x: str = "x") -> ClassDistance:
    lit = lambda vs: F.array(*[F.lit(float(v)) for v in vs])
    cells = train.select(F.col(label).alias("_c"), F.posexplode(x).alias("j", "v"))
    per = cells.groupBy("_c", "j").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2")).collect()  # classes x p rows
    p = max(r["j"] for r in per) + 1
    n = {r["_c"]: r["n"] for r in per}
    by = {c: (np.zeros(p), np.zeros(p)) for c in n}
    for r in per:
        by[r["_c"]][0][r["j"]], by[r["_c"]][1][r["j"]] = r["m"], r["s2"]
    total = sum(n.values())
    mean = sum(n[c] * by[c][0] for c in n) / total
    var = sum(n[c] * (by[c][1] + (by[c][0] - mean) ** 2) for c in n) / total
    scale = np.where(var > 1e-24, np.sqrt(var), 1.0)
    model = ClassDistance(mean, scale, {}, {})
    centers = {c: (by[c][0] - mean) / scale for c in n}
    own = F.element_at(F.create_map(*[v for c, m in centers.items() for v in (F.lit(c), lit(m))]), F.col(label))
    moments = gram.fit_moments_by(train, label, F.zip_with(model.z(x), own, lambda a, m: a - m))
    overall = None
    for c in labels:
        if n.get(c, 0) >= 2:
            model.centers[c], model.precisions[c] = centers[c], gram.ledoit_wolf(moments[c]).precision
        else:
            overall = overall or gram.ledoit_wolf(gram.fit_moments(train, model.z(x))).precision
            model.centers[c], model.precisions[c] = np.zeros(p), overall
    return model


@dataclass(frozen=True)
class Bundle:
    labels: tuple
    classifier: Calibrated
    cutoff: float
    distance: ClassDistance
    distance_limit: float
    tiers: dict
    regressor: learn.Ridge | None = None
    regressor_label: str | None = None


def fit_bundle(
    train: DataFrame, calibration: DataFrame, label: str, labels: Sequence, tiers: Mapping, alpha: float = 0.1, quantile: float = 0.95, iterations: int = 100,
    folds: int = 3, target: str | None = None, target_label: str | None = None, id: str = "sample_id",
) -> Bundle:
    """Cross-fitted classifier and distances from train rows, set cutoff and distance limit from calibration rows.

    With `target`, a ridge model of it is fitted on the train rows of `target_label`, for the estimate behind the gate.
    """
    train, calibration = train.persist(), calibration.persist()  # feature rows, read by several fits
    model = fit_calibrated(train, label, labels, lambda rows: learn.fit_logistic(rows, label, labels, iterations=iterations), folds, id=id)
    dist = fit_class_distance(train, label, labels)
    names = F.array(*[F.lit(c) for c in labels])
    own = F.element_at("probs", F.array_position(names, F.col(label)).cast("int"))
    held = model.predict(calibration).select((1 - own).alias("_nc"), dist.score("x", "y_pred").alias("_d")).persist()
    nc = order_statistics(held, [], "_nc", {"q": conformal_rank(alpha)}).first()
    limit = quantiles(held, [], "_d", {"q": quantile}).first()
    ridge = learn.fit_ridge(train.where(F.col(label) == target_label), "x", target) if target else None
    for used in (train, calibration, held):
        used.unpersist()
    return Bundle(tuple(labels), model, 1.0 - nc["q"], dist, limit["q"], dict(tiers), ridge, target_label)


def diagnose(
    df: DataFrame, bundle: Bundle, features: Sequence[str], injection: float, window: float, interval: float, tolerance: float, width: float,
    id: str = "sample_id", t: str = "t", order: Sequence[str] | None = None, ordinal: str | None = None, header: DataFrame | None = None,
) -> DataFrame:
    """One row per trajectory; rejected input keeps its row with status invalid_input and the error codes.

    `ordinal` and `header` go to the gate: rows are then checked in the order of their source, and against its column names.
    """
    gate = audit.input_gate(df, features, injection, window, interval, tolerance, width, id, t, order, ordinal=ordinal, header=header)
    feats = win.window_summary(df, features, [window], injection, id, t)
    cols = [f"{f}__{s}" for f in features for s in win.STATS]
    good = gate.where("valid").join(feats, id).select(id, F.array(*cols).alias("x"))
    scored = decide_rows(good, bundle)
    out = gate.select(id, "valid", "errors", "row_count").join(scored.drop("x", "probs"), id, "left")
    return out.withColumn("status", F.when(F.col("valid"), F.col("status")).otherwise("invalid_input"))


def decide_rows(rows: DataFrame, bundle: Bundle) -> DataFrame:
    """Prediction set, distance warning, tier and status for feature rows with an `x` array."""
    p = bundle.classifier.predict(rows).withColumn("confidence", F.array_max("probs"))
    p = p.withColumn("conformal_set", label_set(F.col("probs"), list(bundle.labels), bundle.cutoff))
    p = p.withColumn("distance", bundle.distance.score("x", "y_pred")).withColumn("ood_warning", F.coalesce(F.col("distance") > bundle.distance_limit, F.lit(False)))
    p = p.withColumn("tier", capability(F.col("y_pred"), bundle.tiers))
    p = p.withColumn("status", status_policy(F.size("conformal_set"), F.col("ood_warning"), F.col("tier")))
    if bundle.regressor is None:
        return p
    # Written once: both sides of the gate read it, and no filter moves below the models to rows that they can not score.
    return gated_estimate(cut_lineage(p), gate_open(bundle.regressor_label), lambda rows: rows.withColumn("estimate", bundle.regressor.predict(F.col("x"))))


def gate_open(label: str) -> Column:
    """Accepted, of the one class, and tier A; never NULL."""
    return F.coalesce((F.col("status") == "accepted") & (F.col("y_pred") == label) & (F.col("tier") == "Tier A"), F.lit(False))


def gated_estimate(decided: DataFrame, gate: Column, estimate: Callable[[DataFrame], DataFrame], out: str = "estimate") -> DataFrame:
    """Run a second model on the rows that pass the gate, and on no other; every row stays.

    `estimate` adds the column `out` to the rows it is given.
    """
    inside = estimate(decided.where(gate)).withColumn("severity_status", F.lit("available_exploratory"))
    outside = decided.where(~gate).withColumn(out, F.lit(None).cast("double")).withColumn("severity_status", F.lit("not_run_due_to_gating"))
    return inside.withColumn(out, F.col(out).cast("double")).unionByName(outside)


def secondary_estimate(decided: DataFrame, estimates: DataFrame, family: str, id: str = "sample_id") -> DataFrame:
    """Attach the estimate only to accepted tier-A rows of one family."""
    open_gate = (F.col("status") == "accepted") & (F.col("y_pred") == family) & (F.col("tier") == "Tier A")
    wanted = decided.where(open_gate).select(id).join(estimates, id)
    return decided.join(wanted, id, "left").withColumn(
        "severity_status", F.when(F.coalesce(open_gate, F.lit(False)), "available_exploratory").otherwise("not_run_due_to_gating"))


def legacy_decision(first_alarm: Column, predicted: Column, fixed_condition: Column) -> Column:
    """NoAlarm without an alarm; the class under the fixed condition, Unknown elsewhere."""
    return F.when(first_alarm.isNull(), "NoAlarm").when(fixed_condition, predicted).otherwise("Unknown")


def first_examples(df: DataFrame, categories: Mapping[str, Column], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First row per category in key order; a category without rows still gets one."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in categories.items()]))
    rows = df.withColumn("category", F.explode(hits)).select("category", *columns)
    best = best_per_group(rows, ["category"], list(order))
    dim = df.sparkSession.createDataFrame([(n,) for n in categories], "category string")
    return dim.join(best.withColumn("_hit", F.lit(True)), "category", "left").withColumn(
        "observed", F.coalesce("_hit", F.lit(False))).drop("_hit")


def result_view(decided: DataFrame, labels: Mapping[str, str], top: str, fallback: Sequence[str], n: int = 5) -> DataFrame:
    """Readable status, trend variables with a fallback list, and the gated section flag."""
    chosen = F.slice(F.array_distinct(F.coalesce(F.col(top), F.array().cast("array<string>"))), 1, n)
    return decided.withColumn("status_label", map_label(F.col("status"), labels, "unmapped")).withColumn(
        "trend_fallback", F.size(chosen) == 0
    ).withColumn("trend_variables", F.when(F.size(chosen) > 0, chosen).otherwise(F.array(*[F.lit(f) for f in fallback])))
