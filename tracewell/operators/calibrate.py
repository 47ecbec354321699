"""Cross-fitted probability calibration: every calibrator sees only scores of rows that its model has not seen."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import argmax_label
from tracewell.operators import splits
from tracewell.operators.learn import Classifier, Platt
from tracewell.session import cut_lineage


@dataclass(frozen=True)
class Prior:
    """Class shares of the train rows for every row."""

    labels: tuple
    shares: tuple[float, ...]

    def predict(self, df: DataFrame, x: str = "x", probs: str = "probs", guess: str = "y_pred") -> DataFrame:
        out = df.withColumn(probs, F.array(*[F.lit(float(p)) for p in self.shares]))
        return out.withColumn(guess, argmax_label(F.col(probs), list(self.labels)))


@dataclass(frozen=True)
class Calibrated:
    """Mean of the calibrated probabilities of one model per fold; a member without calibrator gives its own."""

    labels: tuple
    members: tuple[tuple[Classifier | Prior, Platt | None], ...]
    folds: int
    status: str

    def predict(self, df: DataFrame, x: str = "x", probs: str = "probs", guess: str = "y_pred") -> DataFrame:
        keep, cur = df.columns, df
        for i, (model, platt) in enumerate(self.members):
            cur = model.predict(cur, x, f"_m{i}", "_guess").drop("_guess")
            if platt:
                cur = cur.withColumn(f"_m{i}", platt.apply(F.col(f"_m{i}")))
        n = len(self.members)
        mean = F.array(*[reduce(lambda a, c: a + c, [F.element_at(f"_m{i}", k + 1) for i in range(n)]) / n for k in range(len(self.labels))])
        out = cur.withColumn(probs, mean).select(*keep, probs)
        return out.withColumn(guess, argmax_label(F.col(probs), list(self.labels)))


def fit_sigmoids(scores: DataFrame, group: str, groups: int, label: str, labels: Sequence, probs: str = "probs", rounds: int = 100, tolerance: float = 1e-10) -> list[Platt]:
    """One Platt sigmoid per group (0, 1, ...) and class, all fitted together: each Newton step is one aggregate over the rows.

    Targets are smoothed as (n1 + 1) / (n1 + 2) and 1 / (n0 + 2).  The driver sees six numbers per group and class.
    """
    names, size = F.array(*[F.lit(c) for c in labels]), len(labels)
    cells = scores.select(F.col(group).cast("int").alias("g"), F.posexplode(probs).alias("k", "p"), (F.array_position(names, F.col(label)) - 1).alias("_own"))
    cells = cut_lineage(cells.select((F.col("g") * size + F.col("k")).cast("int").alias("c"), "p", (F.col("_own") == F.col("k")).alias("hit")))
    shape = groups * size
    one, none = np.zeros(shape), np.zeros(shape)
    for r in cells.groupBy("c").agg(F.count_if("hit").alias("n1"), F.count_if(~F.col("hit")).alias("n0")).collect():
        one[r["c"]], none[r["c"]] = r["n1"], r["n0"]
    high, low = (one + 1) / (one + 2), 1 / (none + 2)
    lit = lambda v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), F.col("c") + 1)

    def sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        z = lit(a) * F.col("p") + lit(b)
        rows = cells.withColumn("z", z).withColumn("t", F.when(F.col("hit"), lit(high)).otherwise(lit(low))).withColumn("s", 1 / (1 + F.exp(-F.col("z"))))
        s, t, p, w = F.col("s"), F.col("t"), F.col("p"), F.col("s") * (1 - F.col("s"))
        loss = F.greatest(F.col("z"), F.lit(0.0)) - F.col("z") * t + F.log1p(F.exp(-F.abs("z")))
        out = np.zeros((shape, 6))
        for r in rows.groupBy("c").agg(F.sum(loss), F.sum((s - t) * p), F.sum(s - t), F.sum(w * p * p), F.sum(w * p), F.sum(w)).collect():
            out[r[0]] = r[1:]
        return out

    def step(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        haa, hab, hbb = m[:, 3] + 1e-9, m[:, 4], m[:, 5] + 1e-9
        det = haa * hbb - hab * hab
        return -(hbb * m[:, 1] - hab * m[:, 2]) / det, -(haa * m[:, 2] - hab * m[:, 1]) / det

    a, b = np.zeros(shape), np.log((one + 1) / (none + 1))
    best = sums(a, b)
    da, db = step(best)
    for _ in range(rounds):
        if np.maximum(np.abs(da), np.abs(db)).max(initial=0.0) < tolerance:
            break
        trial = sums(a + da, b + db)
        better = trial[:, 0] <= best[:, 0] + 1e-12 * np.abs(best[:, 0])
        a, b = np.where(better, a + da, a), np.where(better, b + db, b)
        best = np.where(better[:, None], trial, best)
        na, nb = step(best)
        da, db = np.where(better, na, da / 2), np.where(better, nb, db / 2)
    a, b = a.reshape(groups, size), b.reshape(groups, size)
    return [Platt(tuple(labels), tuple(map(float, x)), tuple(map(float, y))) for x, y in zip(a, b, strict=True)]


def fit_calibrated(
    train: DataFrame, label: str, labels: Sequence, fit: Callable[[DataFrame], Classifier], folds: int = 3, seed: int = 7, id: str = "sample_id", workers: int = 3
) -> Calibrated:
    """Up to `folds` stratified folds of the train rows: a model on the others, a sigmoid per class on the fold's own scores.

    The smallest class bounds the folds.  With one row of it, the model is fitted on all rows and not calibrated; with one class only, the
    answer is that class.  The status says which case it was.
    """
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    labels = tuple(labels)
    if len(counts) < 2:
        total = max(1, sum(counts.values()))
        return Calibrated(labels, ((Prior(labels, tuple(counts.get(c, 0) / total for c in labels)), None),), 0, "uncalibrated_single_class_fallback")
    folds = min(folds, min(counts.values()))
    if folds < 2:
        return Calibrated(labels, ((fit(train), None),), 0, "uncalibrated_min_class_support")
    ranked = splits._hash_ranked(train, [label], splits.seeded_digest(seed, id), id)
    rows = cut_lineage(ranked.withColumn("_fold", F.col("_rank") % folds).drop("_rank", "_n"))  # read by every fold
    with ThreadPoolExecutor(workers) as pool:
        models = list(pool.map(lambda f: fit(rows.where(F.col("_fold") != f)), range(folds)))
    held = [m.predict(rows.where(F.col("_fold") == f)).select("_fold", label, "probs") for f, m in enumerate(models)]
    sigmoids = fit_sigmoids(reduce(DataFrame.unionByName, held), "_fold", folds, label, labels)
    return Calibrated(labels, tuple(zip(models, sigmoids, strict=True)), folds, "train_only_sigmoid_cv")
