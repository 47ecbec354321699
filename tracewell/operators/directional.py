"""Errors under a shift of severity: by direction and class, over repeated splits, and against the distance to the train rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import aggregates as agg
from tracewell.operators import align, metrics
from tracewell.operators.ordered import attach


def directional_errors(
    assigned: DataFrame, labels: Sequence[str], keys: Sequence[str] = ("split_id",), severity: str = "severity", label: str = "class", guess: str = "y_pred"
) -> DataFrame:
    """Per split and class: precision, recall, F1, main confusion target, nearest-train gap and severity ranges."""
    k = list(keys)
    test = assigned.where("partition = 'test'").withColumn("y_true", F.col(label))
    per = metrics.per_class(test, k, labels, "y_true", guess)
    wrong = agg.most_frequent(test.where(F.col("y_true") != F.col(guess)), [*k, "y_true"], guess, "main_confusion_target").drop("votes")
    gaps = align.nearest_in_train(assigned, severity, [*k, label]).groupBy(*k, label).agg(F.avg("gap").alias("nearest_gap_mean"))
    rng = assigned.groupBy(*k, label).agg(*[
        f(F.when(F.col("partition") == p, F.col(severity))).alias(f"{p}_{severity}_{n}") for p in ("train", "test") for n, f in (("min", F.min), ("max", F.max))])
    out = per.join(wrong.withColumnRenamed("y_true", "label"), [*k, "label"], "left")
    out = out.join(gaps.withColumnRenamed(label, "label"), [*k, "label"], "left")
    return out.join(rng.withColumnRenamed(label, "label"), [*k, "label"], "left")


def direction_summary(errors: DataFrame, direction: str = "direction", label: str = "label", severity: str = "severity") -> DataFrame:
    """`directional_errors` of several splits rolled up: means and spreads per direction and class over splits with support.

    The spread of a single split is 0.  The main confusion target is the most frequent one, ties to the smallest label.
    """
    some = errors.where("support > 0")
    every = errors.select(direction, label).distinct()
    stats = []
    for m in ("precision", "recall", "f1", "nearest_gap_mean"):
        stats += [F.avg(m).alias(f"{m}_mean" if m != "nearest_gap_mean" else m), F.when(F.count(m) > 1, F.stddev_samp(m)).when(F.count(m) == 1, F.lit(0.0)).alias(f"{m.removesuffix('_mean')}_std")]
    ranges = [F.avg(f"{p}_{severity}_{n}").alias(f"{p}_{severity}_{n}") for p in ("train", "test") for n in ("min", "max")]
    per = some.groupBy(direction, label).agg(F.count(F.lit(1)).alias("n_splits"), F.avg("support").alias("support_mean"), F.min("support").alias("support_min"), *stats, *ranges)
    mode = agg.most_frequent(some.where("main_confusion_target is not null"), [direction, label], "main_confusion_target", "main_confusion_target").drop("votes")
    out = attach(attach(every, per, [direction, label], "left"), mode, [direction, label], "left")
    return out.withColumn("n_splits", F.coalesce("n_splits", F.lit(0)).cast("long"))


def recall_by_gap(assigned: DataFrame, edges: Sequence[float], keys: Sequence[str], severity: str = "severity", label: str = "class", guess: str = "y_pred", id: str = "sample_id") -> DataFrame:
    """Recall of test rows by their distance to the nearest train row of the same class, in fixed bins [edge, next edge); empty bins stay.

    The last bin is open.  Rows of a class without train rows have no distance: they come as the bin -1.
    """
    k = list(keys)
    gaps = align.nearest_in_train(assigned, severity, [*k, label], id).select(*k, label, id, "gap")
    test = assigned.where("partition = 'test'").select(*k, label, id, (F.col(label) == F.col(guess)).alias("_hit"))
    arr = F.array(*[F.lit(float(e)) for e in edges])
    rows = test.join(gaps, [*k, label, id], "left").withColumn("bin", F.when(F.col("gap").isNull(), -1).otherwise(F.size(F.filter(arr, lambda e: e <= F.col("gap"))) - 1).cast("int"))
    per = rows.groupBy(*k, "bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("_hit").alias("hits"), F.avg("gap").alias("gap_mean"))
    grid = assigned.select(*k).distinct().withColumn("bin", F.explode(F.sequence(F.lit(-1), F.lit(len(edges) - 1))))
    out = attach(grid, per, [*k, "bin"], "left")
    n, hits = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("hits", F.lit(0)).cast("long")
    return out.select(*k, "bin", F.get(arr, F.col("bin")).alias("gap_from"), F.get(arr, F.col("bin") + 1).alias("gap_to"), n.alias("n"), hits.alias("hits"), F.when(n > 0, hits / F.when(n > 0, n)).alias("recall"), "gap_mean")
