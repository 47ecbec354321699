"""Grouped statistics: scales, descriptions, stability, dependence and weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import ordered
from tracewell.operators.ordered import BUCKET, attach, quantile_bucket
from tracewell.operators.quantiles import average_ranks, medians, order_statistics

MAD_TO_SIGMA = 1.4826


def baseline_scale(long: DataFrame, value: str = "x", keys: Sequence[str] = ("feature",), floor: float = 1e-6) -> DataFrame:
    """max(sample deviation, 1 % of the median magnitude); NULL when below `floor`."""
    mag = medians(long.withColumn("_mag", F.abs(value)), keys, "_mag", "_med")
    std = long.groupBy(*keys).agg(F.stddev_samp(value).alias("_std"))
    scale = F.greatest(F.col("_std"), 0.01 * F.col("_med"))
    return std.join(mag, list(keys)).select(*keys, F.when(scale >= floor, scale).alias("scale"))


def robust_scale(
    long: DataFrame, value: str = "x", keys: Sequence[str] = ("feature",), near_zero: float = 1e-10
) -> DataFrame:
    """center = median, mad, scale = max(1.4826 mad, 1 % of median magnitude, 1e-12), active = mad > near_zero."""
    k = list(keys)
    center = medians(long, k, value, "center")
    both = F.array(
        F.struct(F.lit("mad").alias("kind"), F.abs(F.col(value) - F.col("center")).alias("_d")), F.struct(F.lit("mag").alias("kind"), F.abs(value).alias("_d")))
    dev = attach(long.select(*k, value), center, k).select(*k, F.explode(both).alias("_e")).select(*k, "_e.*")
    med = medians(dev, [*k, "kind"], "_d", "m")
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("m")))
    wide = med.groupBy(*k).agg(at("mad").alias("mad"), at("mag").alias("_mag"))
    return (
        attach(center, wide, k)
        .withColumn("scale", F.greatest(MAD_TO_SIGMA * F.col("mad"), 0.01 * F.col("_mag"), F.lit(1e-12)))
        .withColumn("active", F.col("mad") > near_zero)
        .drop("_mag")
    )


def fit_scales(scales: DataFrame, value: str = "scale", feature: str = "feature") -> dict[str, float | None]:
    """Per-feature parameters as plain numbers; one row per feature reaches the driver."""
    return {r[feature]: r[value] for r in scales.select(feature, value).collect()}


def describe(df: DataFrame, keys: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """n, mean, std (0 for one value), median, min, max and the normal 95 % interval, for groups of any size."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    out = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("_s"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    out = attach(out, medians(df, keys, value, "median"), keys, "left")
    out = out.withColumn("std", F.when(F.col("n") > 1, F.col("_s")).when(F.col("n") == 1, F.lit(0.0)))
    margin = F.when(F.col("n") > 1, 1.96 * F.col("std") / F.sqrt("n")).otherwise(F.lit(0.0))
    names = ["n", "mean", "std", "median", "min", "max", "ci95_low", "ci95_high"]
    out = out.withColumn("ci95_low", F.col("mean") - margin).withColumn("ci95_high", F.col("mean") + margin)
    return out.select(*keys, *[F.col(c).alias(prefix + c) for c in names])


def metric_summary(metrics: DataFrame, keys: Sequence[str], values: Sequence[str], model: str | None = None) -> DataFrame:
    """Describe several metrics per configuration, plus how often each model was selected."""
    k = list(keys)
    long = metrics.unpivot([*k, *([model] if model else [])], list(values), "_metric", "_value")
    stats = describe(long, [*k, "_metric"], "_value")
    names = ["n", "mean", "std", "median", "min", "max", "ci95_low", "ci95_high"]
    wide = stats.groupBy(*k).agg(*[
        F.max(F.when(F.col("_metric") == m, F.col(s))).alias(f"{m}_{s}") for m in values for s in names
    ])
    if model:
        per = metrics.groupBy(*k, model).agg(F.count(F.lit(1)).alias("_c"))
        text = per.groupBy(*k).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), F.col("_c").alias("c")))),
                                     lambda s: F.concat(s["m"], F.lit("="), s["c"].cast("string"))), ";").alias("selected_model_counts")
        )  # one entry per model name
        wide = attach(wide, text, k, "left")
    return wide


def recall_stability(recalls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-class recall over splits that have test support, with support counters and a status."""
    supported = recalls.withColumn("_r", F.when(F.col("support") > 0, F.col("recall")))
    stats = describe(supported, keys, "_r", "recall_")
    counts = recalls.groupBy(*keys).agg(
        F.max("cohort_support").alias("cohort_support"), F.count(F.lit(1)).alias("n_splits"),
        F.count_if(F.col("support") > 0).alias("n_evaluable_splits"), F.avg("support").alias("support_mean"),
        F.min("support").alias("support_min"), F.max("support").alias("support_max"),
        F.count_if(F.col("support") >= 3).alias("n_splits_support_ge_3"),
        F.count_if(F.col("support") >= 5).alias("n_splits_support_ge_5"),
    )
    status = (
        F.when(F.col("cohort_support") == 0, "not_evaluable_no_strict_trajectory")
        .when(F.col("support_min") < 5, "low_support")
        .otherwise("evaluable")
    )
    return attach(
        counts.withColumn("status", status).withColumn("reliable_for_gate", (F.col("cohort_support") > 0) & (F.col("support_min") >= 5)),
        stats, keys,
    )


def confusion_stability(pairs: DataFrame, keys: Sequence[str], split_cols: Sequence[str]) -> DataFrame:
    """How often each unordered confusion pair shows up over splits; stable from half of them on."""
    k = [*keys, "left_class", "right_class"]
    seen = (F.col("pair_count") > 0).cast("int")
    return pairs.groupBy(*k).agg(
        F.countDistinct(*split_cols).alias("n_splits"), F.sum(seen).alias("split_count_present"),
        F.avg(seen).alias("pair_frequency"), (F.avg(seen) >= 0.5).alias("stable_frequency_ge_50pct"),
        F.avg("forward_count").alias("forward_count_mean"), F.avg("reverse_count").alias("reverse_count_mean"),
        F.avg("pair_count").alias("pair_count_mean"), F.max("pair_count").alias("pair_count_max"),
    )


def support_table(assigned: DataFrame, keys: Sequence[str], label: str, labels: Sequence[str], partitions: Sequence[str]) -> DataFrame:
    """Dense (keys x label) counts per partition."""
    counts = assigned.groupBy(*keys, label).pivot("partition", list(partitions)).agg(F.count(F.lit(1)))
    grid = assigned.select(*keys).distinct().withColumn(label, F.explode(F.array(*[F.lit(x) for x in labels])))
    out = attach(grid, counts, [*keys, label], "left")
    return out.select(*keys, label, *[F.coalesce(F.col(p), F.lit(0)).alias(f"{p}_n") for p in partitions])


def alarm_summary(cases: DataFrame, keys: Sequence[str], alarm: str = "first_alarm_s") -> DataFrame:
    """Count, alarm rate and median first alarm per group of any size."""
    base = cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(alarm).alias("n_alarm"), F.avg(F.col(alarm).isNotNull().cast("int")).alias("alarm_rate")
    )
    return attach(base, medians(cases, keys, alarm, "median_first_alarm_s"), keys, "left")


def detection_summary(cases: DataFrame, keys: Sequence[str], event_known: str = "first_protection_s") -> DataFrame:
    """Detection and lead-time statistics per method."""
    base = cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("detected").alias("detected_count"),
        F.count_if("detected_before_event").alias("before_event_count"),
        F.avg(F.col("detected").cast("int")).alias("detection_rate"),
        F.avg(F.col("detected_before_event").cast("int")).alias("before_event_rate"),
        F.min("first_alarm_s").alias("detection_min_s"), F.max("first_alarm_s").alias("detection_max_s"),
        F.min("lead_time_s").alias("lead_min_s"), F.max("lead_time_s").alias("lead_max_s"),
    )
    # both medians in one pass over (column, value) rows
    names = {"first_alarm_s": "detection_median_s", "lead_time_s": "lead_median_s"}
    med = medians(cases.unpivot(list(keys), list(names), "_of", "_v"), [*keys, "_of"], "_v", "_m")
    wide = med.groupBy(*keys).agg(*[F.max(F.when(F.col("_of") == c, F.col("_m"))).alias(n) for c, n in names.items()])
    return attach(base, wide, keys, "left")


def between_class_share(long: DataFrame, keys: Sequence[str], label: str, value: str) -> DataFrame:
    """Between-class share of variance: SSB / (SSB + SSW + 1e-12)."""
    per = long.groupBy(*keys, label).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    grand = per.groupBy(*keys).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    both = attach(per, grand, keys)
    ssb = F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2)
    ssw = F.sum(F.col("n") * F.col("v"))
    return both.groupBy(*keys).agg((ssb / (ssb + ssw + 1e-12)).alias("between_share"))


def spearman_abs(long: DataFrame, keys: Sequence[str], x: str, y: str, rows_per_bucket: int = 10_000) -> DataFrame:
    """|Spearman| with average ranks; 0 for fewer than four rows or a constant side."""
    k = list(keys)
    rx, ry = average_ranks(long, k, x, "_rx", rows_per_bucket), average_ranks(long, k, y, "_ry", rows_per_bucket)
    ranked = attach(attach(long.select(*k, x, y), rx, [*k, x]), ry, [*k, y])
    r = ranked.groupBy(*k).agg(
        F.corr("_rx", "_ry").alias("_r"), F.count(F.lit(1)).alias("n"),
        F.stddev_pop("_rx").alias("_sx"), F.stddev_pop("_ry").alias("_sy"),
    )
    ok = (F.col("n") >= 4) & (F.col("_sx") > 0) & (F.col("_sy") > 0)
    return r.select(*k, "n", F.when(ok, F.abs("_r")).otherwise(F.lit(0.0)).alias("spearman_abs"))


def conformal_rank(alpha: float):
    """Zero-based index ceil((n + 1)(1 - alpha)) - 1 in terms of the column n."""
    return F.ceil(F.round((F.col("n") + 1) * F.lit(1.0 - alpha), 9)) - 1


def quantile_table(df: DataFrame, keys: Sequence[str], value: str, p: float, alpha: float) -> DataFrame:
    """The three quantile readings side by side: linear, lower/higher order statistic, conformal index."""
    at = F.round(F.lit(float(p)) * (F.col("n") - 1), 9)
    s = order_statistics(df, keys, value, {"q_lower": F.floor(at), "q_higher": F.ceil(at), "q_conformal": conformal_rank(alpha)})
    linear = F.col("q_lower") + (F.col("q_higher") - F.col("q_lower")) * (at - F.floor(at))
    return s.select(*keys, "n", linear.alias("q_linear"), "q_lower", "q_higher", "q_conformal")


def most_frequent(df: DataFrame, keys: Sequence[str], label: str, out: str = "majority") -> DataFrame:
    """Most frequent label per key, ties to the smallest label."""
    n = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(
        F.min_by(label, F.struct((-F.col("_n")).alias("n"), F.col(label))).alias(out), F.max("_n").alias("votes")
    )


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    out = df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
    return out.select(row, *[F.coalesce(F.col(str(v)), F.lit(0)).alias(str(v)) for v in values])


def peak_and_top_share(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.1) -> DataFrame:
    """Peak value and the median of the largest max(1, ceil(share n)) values.

    The median of the top m values is an order statistic of all n, so no group is collected.
    """
    m = F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * F.lit(share), 9)))
    ranks = {
        "peak": F.col("n") - 1,
        "_lo": F.col("n") - m + F.floor((m - 1) / 2),
        "_hi": F.col("n") - m + F.ceil((m - 1) / 2),
    }
    s = order_statistics(df, keys, value, ranks)
    return s.select(*keys, "n", "peak", ((F.col("_lo") + F.col("_hi")) / 2).alias("top_median"))


def pairwise_correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of every feature pair from one pass over the rows (one aggregate per pair)."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "_pair", "r")
    return long.select(
        F.element_at(F.split("_pair", r"\|"), 1).alias("left_feature"), F.element_at(F.split("_pair", r"\|"), 2).alias("right_feature"), "r"
    )


def prune_redundant(correlations: DataFrame, features: Sequence[str], limit: float = 0.98) -> list[str]:
    """Greedy keep-first over feature names; the driver sees one number per feature pair."""
    close = {
        (r["left_feature"], r["right_feature"])
        for r in correlations.where(F.abs("r") >= limit).collect()
    }
    kept: list[str] = []
    for f in features:
        if not any((k, f) in close or (f, k) in close for k in kept):
            kept.append(f)
    return kept


def ordered_text(df: DataFrame, keys: Sequence[str], value: str, order: str, separator: str = ",", distinct: bool = False, out: str = "text", rows_per_bucket: int = 10_000) -> DataFrame:
    """The values of each key as one text, in the order of a numeric column and then of the value; NULL values are left out.

    `distinct` keeps the first occurrence of each value.  Rows are sorted bucket by bucket, and only the buckets' texts meet for a key,
    so no task sorts the rows of a large key; its text is one row of the result all the same.
    """
    rows = df.select(*keys, F.col(order).cast("double").alias("_o"), F.col(value).cast("string").alias("_v")).where("_v is not null and _o is not null")
    if distinct:
        rows = rows.groupBy(*keys, "_v").agg(F.min("_o").alias("_o"))
    placed = quantile_bucket(rows, keys, "_o", rows_per_bucket)
    parts = placed.groupBy(*keys, BUCKET).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda s: s["_v"]), separator).alias("_part"), F.count(F.lit(1)).alias("_n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(BUCKET, "_part"))), lambda s: s["_part"]), separator)
    return parts.groupBy(*keys).agg(whole.alias(out), F.sum("_n").alias("n"))


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """N / (K n_c) for each row's class."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(1))  # one row per class
    table = per.withColumn(out, F.sum("_n").over(w) / (F.count(F.lit(1)).over(w) * F.col("_n"))).drop("_n")
    return attach(df, table, [label])


def first_alarm_histogram(cases: DataFrame, alarm: str = "first_alarm_s") -> DataFrame:
    return cases.groupBy(alarm).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, keys: Sequence[str], cols: Mapping[str, str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.groupBy(*keys).agg(*[count(c).alias(n) for n, c in cols.items()])
