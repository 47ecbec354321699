"""Data-quality and dataset audits. Ordered checks go through bucketed neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import is_finite
from tracewell.operators import ordered
from tracewell.operators.ordered import BUCKET, attach, attach_row
from tracewell.operators.quantiles import medians


def steps(df: DataFrame, id: str, t: str, width: float, order: Sequence[str] | None = None, ordinal: str | None = None) -> DataFrame:
    """Rows with `dt` to the previous row of the same trajectory (NULL on the first).

    With `ordinal`, the column that holds each row's place in its source, the previous row is the one in front of it there, so
    a time that falls gives a negative step.  Else rows are ordered by time plus the given tie columns.
    """
    placed = ordered.ordinal_bucket(df, ordinal) if ordinal else ordered.time_bucket(df, t, width)
    near = ordered.neighbour(placed, [id], [ordinal] if ordinal else list(order or [t]), {"_prev": t})
    return near.withColumn("dt", F.col(t) - F.col("_prev")).drop("_prev", BUCKET)


def ends(t: str, ordinal: str | None) -> tuple[Column, Column]:
    """First and last time: of the source's first and last row with `ordinal`, else the smallest and the largest."""
    return (F.min_by(t, ordinal), F.max_by(t, ordinal)) if ordinal else (F.min(t), F.max(t))


def time_metrics(
    df: DataFrame, width: float, id: str = "sample_id", t: str = "t", order: Sequence[str] | None = None,
    rtol: float = 1e-5, atol: float = 1e-6, ordinal: str | None = None,
) -> DataFrame:
    """Row count, span, step statistics, monotonicity, repeated times and non-uniform steps per trajectory.

    Pass `ordinal` to audit the rows in the order of their source: only then can a falling time be seen.
    """
    s = steps(df, id, t, width, order, ordinal)
    start, end = ends(t, ordinal)
    base = s.groupBy(id).agg(
        F.count(F.lit(1)).alias("rows"), start.alias("time_start_s"), end.alias("time_end_s"),
        F.min("dt").alias("sampling_min_s"), F.max("dt").alias("sampling_max_s"),
        F.coalesce(F.min(F.col("dt") > 0), F.lit(True)).alias("time_strictly_increasing"),
        # on a sorted axis a row repeats a time exactly when its step is zero
        F.count_if(F.col("dt") == 0).alias("time_duplicate_count"),
    )
    if ordinal:
        again = df.groupBy(id, t).agg((F.count(F.lit(1)) - 1).alias("_n")).groupBy(id).agg(F.sum("_n").alias("time_duplicate_count"))
        base = base.drop("time_duplicate_count").join(again, id)
    med = medians(s, [id], "dt", "sampling_median_s")
    off = attach(s, med, [id]).groupBy(id).agg(
        F.count_if(F.abs(F.col("dt") - F.col("sampling_median_s")) > atol + rtol * F.abs("sampling_median_s")).alias("_off"))
    out = base.join(med, id, "left").join(off, id, "left")
    return out.withColumn("nonuniform_sampling_intervals", F.coalesce("_off", F.lit(0)).cast("long")).drop("_off")


def presence(expected: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """Every expected or found key with its status: present, missing or extra."""
    e = expected.select(on).distinct().withColumn("_e", F.lit(True))
    f = found.select(on).distinct().withColumn("_f", F.lit(True))
    status = F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise("present")
    return e.join(f, on, "full_outer").select(on, status.alias("status"))


def file_report(expected: DataFrame, rows: DataFrame, faults: DataFrame, on: str) -> DataFrame:
    """Every expected or found source with its status, rows read, faults of each kind, and the first fault as text.

    `faults` has line, error and detail for each source; a fault of the whole source comes before those of its lines.
    """
    found = rows.select(on).unionByName(faults.select(on))
    status = presence(expected, found, on)
    n = rows.groupBy(on).agg(F.count(F.lit(1)).alias("rows"))
    kinds = ("unreadable", "empty", "missing_columns", "repeated_columns", "cells", "number")
    text = F.concat_ws(": ", F.concat(F.col("error"), F.coalesce(F.concat(F.lit(" in line "), F.col("line")), F.lit(""))), "detail")
    bad = faults.groupBy(on).agg(
        *[F.count_if(F.col("error") == k).alias(k) for k in kinds], F.min_by(text, F.struct(F.coalesce("line", F.lit(0)), "error")).alias("error"))
    out = status.join(n, on, "left").join(bad, on, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(on, "status", zero("rows"), *[zero(k) for k in kinds], "error")


def schema_conformance(columns: DataFrame, expected: Sequence[str], id: str, column: str) -> DataFrame:
    """Missing and extra column names per source; a source lists each of its columns once."""
    want = F.array(*[F.lit(c) for c in expected])
    have = columns.groupBy(id).agg(F.collect_set(column).alias("_have"))  # one entry per distinct column name
    return have.select(
        id, F.size("_have").cast("long").alias("column_count"),
        F.array_join(F.array_sort(F.array_except(want, "_have")), ";").alias("schema_missing_columns"),
        F.array_join(F.array_sort(F.array_except("_have", want)), ";").alias("schema_extra_columns"),
        (F.size(F.array_except(want, "_have")) + F.size(F.array_except("_have", want)) == 0).alias("schema_match"),
    )


def missing_cells(df: DataFrame, features: Sequence[str], id: str = "sample_id") -> DataFrame:
    bad = {f: ~is_finite(F.col(f)) for f in features}
    total = sum((c.cast("long") for c in bad.values()), F.lit(0).cast("long"))
    per = [F.max(c.cast("long")) for c in bad.values()]
    return df.groupBy(id).agg(F.sum(total).alias("missing_cells"), sum(per[1:], per[0]).alias("columns_with_missing"))


def key_signal(df: DataFrame, signal: str, id: str = "sample_id", t: str = "t") -> DataFrame:
    return df.groupBy(id).agg(
        F.min_by(signal, t).alias(f"{signal}_first"), F.max_by(signal, t).alias(f"{signal}_last"),
        F.min(signal).alias(f"{signal}_min"), F.max(signal).alias(f"{signal}_max"),
    )


def first_rows(df: DataFrame, columns: Sequence[str], id: str = "sample_id", t: str = "t") -> DataFrame:
    """First row of every trajectory, only the needed columns."""
    return df.groupBy(id).agg(F.min_by(F.struct(*columns), t).alias("_first")).select(id, "_first.*")


def initial_state_match(df: DataFrame, reference_id, features: Sequence[str], atol: float = 1e-6, id: str = "sample_id", t: str = "t") -> DataFrame:
    """Whether the first row equals the reference's first row within `atol`; two missing values are equal."""
    first = first_rows(df, features, id, t)
    ref = df.where(F.col(id) == reference_id).agg(F.min_by(F.struct(*[F.col(f).alias(f"_r_{f}") for f in features]), t).alias("_r"))
    both = attach_row(first, ref.select("_r.*"))
    same = F.lit(True)
    for f in features:
        a, c = F.col(f), F.col(f"_r_{f}")
        same = same & F.coalesce((a.isNull() & c.isNull()) | (F.abs(a - c) <= atol), F.lit(False))
    return both.select(id, same.alias("initial_state_match"))


def table_equality(left: DataFrame, right: DataFrame, keys: Sequence[str], features: Sequence[str], atol: float = 1e-6) -> DataFrame:
    """One row: key mismatches and per-feature value mismatches between two tables."""
    l = left.select(*keys, F.struct(*features).alias("_l"))
    r = right.select(*keys, F.struct(*features).alias("_r"))
    both = l.join(r, list(keys), "full_outer")
    ok = lambda f: F.coalesce(
        (F.col(f"_l.{f}").isNull() & F.col(f"_r.{f}").isNull()) | (F.abs(F.col(f"_l.{f}") - F.col(f"_r.{f}")) <= atol), F.lit(False))
    matched = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.agg(
        F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"),
        F.count_if(matched).alias("matched"), *[F.count_if(matched & ~ok(f)).alias(f"{f}_differs") for f in features],
    )


def pre_injection_metrics(df: DataFrame, injection: float, width: float, id: str = "sample_id", t: str = "t") -> DataFrame:
    """Segment before the injection: rows, span, median step, and whether it can serve as normal data."""
    s = steps(df, id, t, width).withColumn("_pre", F.col(t) < injection)
    base = s.groupBy(id).agg(
        F.count_if("_pre").alias("pre_injection_rows"),
        F.min(F.when(F.col("_pre"), F.col(t))).alias("pre_injection_time_start_s"),
        F.max(F.when(F.col("_pre"), F.col(t))).alias("pre_injection_time_end_s"),
    ).withColumn("pre_injection_window_s", F.col("pre_injection_time_end_s") - F.col("pre_injection_time_start_s"))
    med = medians(s.where("_pre"), [id], "dt", "pre_injection_sampling_median_s")
    return base.join(med, id, "left").select(
        "*", (F.col("pre_injection_rows") > 0).alias("has_valid_pre_injection_sample"),
        F.coalesce((F.col("pre_injection_rows") >= 2) & (F.col("pre_injection_window_s") > 0), F.lit(False)).alias("pre_window_usable_for_normal"),
    )


def classify_references(inventory: DataFrame) -> DataFrame:
    """A: legal fixed-condition reference; B: legal only under its own conditions; C: not a legal reference."""
    legal = F.col("is_legal_normal_reference")
    cls = F.when(legal & F.col("fixed_condition"), "A").when(legal, "B").otherwise("C")
    return inventory.withColumn("classification", cls)


def audit_summary(inventory: DataFrame, group: str, category: str) -> DataFrame:
    """Per (group, category), per group and overall, from one grouping-sets aggregation."""
    out = inventory.groupingSets([[group, category], [group], []], group, category).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("trajectory_count"),
        *[F.count_if(F.col("classification") == c).alias(f"{c}_count") for c in "ABC"],
        F.count_if("is_legal_normal_reference").alias("legal_normal_count"), F.min("schema_match").alias("schema_all"),
        F.min("rows").alias("rows_min"), F.max("rows").alias("rows_max"),
    )
    return out.select(
        F.when(F.col("level") == 3, "overall").otherwise(F.col(group)).alias("summary_group"),
        F.when(F.col("level") == 3, "all scanned trajectories").when(F.col("level") == 1, F.col(group)).otherwise(F.col(category)).alias("label"),
        *[c for c in out.columns if c not in (group, category)],
    )


def window_availability(df: DataFrame, windows: Sequence[float], id: str = "sample_id", t: str = "t") -> DataFrame:
    ends = df.groupBy(id).agg(F.max(t).alias("_end"))
    return ends.select(id, *[(F.col("_end") >= w).alias(f"available_{w:g}s") for w in windows])


def feature_states(long: DataFrame, id: str = "sample_id", feature: str = "feature", value: str = "x", t: str = "t", few: int = 5) -> DataFrame:
    """present / changed / low_cardinality per (trajectory, feature), with a tolerance from the largest magnitude."""
    k = [id, feature]
    v = F.when(is_finite(F.col(value)), F.col(value))
    rows = long.withColumn("_v", v)
    base = rows.groupBy(*k).agg(F.max(F.abs("_v")).alias("_m"), F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col(t))).alias("_f"),
                                F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    distinct = rows.where(F.col("_v").isNotNull()).select(*k, F.round("_v", 6).alias("_r")).distinct().groupBy(*k).agg(F.count(F.lit(1)).alias("_d"))
    tol = F.greatest(F.lit(1e-9), F.greatest(F.col("_m"), F.lit(1.0)) * 1e-6)
    # the farthest value from the first one is the minimum or the maximum
    moved = F.greatest(F.col("_hi") - F.col("_f"), F.col("_f") - F.col("_lo"))
    return attach(base, distinct, k, "left").select(
        *k, F.coalesce(F.col("_m") > tol, F.lit(False)).alias("present"), F.coalesce(moved > tol, F.lit(False)).alias("changed"),
        (F.coalesce("_d", F.lit(0)) <= few).alias("low_cardinality"),
    )


def leakage_screen(states: DataFrame, initial: DataFrame, label: str = "class", feature: str = "feature") -> DataFrame:
    """Class rate against the rate of all other classes per feature, with the triggers that fired.

    `initial` holds (feature, class, class_initial_condition_flag).
    """
    flags = ("present", "changed", "low_cardinality")
    per = states.groupBy(feature, label).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"_{c}") for c in flags])
    w = Window.partitionBy(feature)  # one row per class
    out = per.withColumn("_N", F.sum("n").over(w))
    for c in flags:
        rest = F.when(F.col("_N") > F.col("n"), (F.sum(f"_{c}").over(w) - F.col(f"_{c}")) / (F.col("_N") - F.col("n"))).otherwise(F.lit(0.0))
        out = out.withColumn(f"class_{c}_rate", F.col(f"_{c}") / F.col("n")).withColumn(f"other_{c}_rate", rest)
    out = attach(out, initial, [feature, label], "left")
    hi = lambda c: (F.col(f"class_{c}_rate") >= 0.9) & (F.col(f"other_{c}_rate") <= 0.1)
    label_triggers = F.array_compact(F.array(
        F.when(hi("present"), F.lit("class_specific_nonzero")),
        F.when(hi("changed"), F.lit("class_specific_state_change")),
        F.when(hi("low_cardinality") & (F.col("class_changed_rate") >= 0.5), F.lit("class_specific_low_cardinality_state")),
    ))
    start = F.when(F.coalesce("class_initial_condition_flag", F.lit(False)), F.array(F.lit("class_specific_initial_constant"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("_t", label_triggers).withColumn("_all", F.concat("_t", start)).where(F.size("_all") > 0)
    return out.select(
        feature, label, F.col("n").alias("class_trajectory_count"), (F.col("_N") - F.col("n")).alias("other_trajectory_count"),
        *[f"{side}_{c}_rate" for c in flags for side in ("class", "other")], F.array_join("_all", ";").alias("trigger"),
        (F.size("_t") > 0).alias("potential_label_leakage"),
        F.when(F.size("_t") > 0, "potential_label_leakage").otherwise("initial_condition_confounding").alias("risk_type"),
        F.when(F.col("n") < 3, "low_sample_class").otherwise("review_candidate").alias("confidence_note"),
    )


def initial_condition_confounding(initial: DataFrame, label: str = "class", feature: str = "feature", value: str = "x") -> DataFrame:
    """Per (feature, class) statistics of the first value and how far the class mean is from the others."""
    per = initial.groupBy(feature, label).agg(
        F.count(value).alias("initial_count"), F.avg(value).alias("initial_mean"), F.stddev_samp(value).alias("initial_std"),
        F.min(value).alias("initial_min"), F.max(value).alias("initial_max"))
    w = Window.partitionBy(feature)  # one row per class
    m = F.col("initial_mean")
    by_hi, by_lo = w.orderBy(m.desc(), F.col(label)), w.orderBy(m, F.col(label))
    out = (
        per.withColumn("max_pairwise_mean_diff", F.max(m).over(w) - F.min(m).over(w))
        .withColumn("global_class_mean_max", F.max(F.abs(m)).over(w))
        .withColumn("_median", F.median(m).over(w))
        .withColumn("_k", F.count(F.lit(1)).over(w))
        .withColumn("_rh", F.row_number().over(by_hi)).withColumn("_rl", F.row_number().over(by_lo))
        .withColumn("_h1", F.max(m).over(w)).withColumn("_l1", F.min(m).over(w))
        .withColumn("_h2", F.max(F.when(F.col("_rh") > 1, m)).over(w)).withColumn("_l2", F.min(F.when(F.col("_rl") > 1, m)).over(w))
    )
    other_hi = F.when(F.col("_rh") == 1, F.col("_h2")).otherwise(F.col("_h1"))
    other_lo = F.when(F.col("_rl") == 1, F.col("_l2")).otherwise(F.col("_l1"))
    limit = F.greatest(F.lit(1e-6), F.col("global_class_mean_max") * 1e-6)
    return out.select(
        feature, label, "initial_count", "initial_mean", "initial_std", "initial_min", "initial_max", "max_pairwise_mean_diff", "global_class_mean_max",
        F.when(F.col("_k") > 1, F.greatest(other_hi - m, m - other_lo)).alias("class_mean_vs_other_max_diff"),
        F.abs(m - F.col("_median")).alias("class_mean_vs_global_class_median_diff"),
        (F.col("max_pairwise_mean_diff") > limit).alias("initial_condition_flag"),
        (F.abs(m - F.col("_median")) > limit).alias("class_initial_condition_flag"),
    )


def class_audit(inventory: DataFrame, label: str, windows: Sequence[str], eligible: int = 10) -> DataFrame:
    """Counts, ranges, parse success and split counts per class."""
    return inventory.groupBy(label).agg(
        F.count(F.lit(1)).alias("trajectory_count"), F.sum("rows").alias("total_rows"), F.min("rows").alias("rows_min"), F.max("rows").alias("rows_max"),
        F.min("time_end_s").alias("time_end_min_s"), F.max("time_end_s").alias("time_end_max_s"),
        F.count("injection_s").alias("injection_parse_success_count"), F.count("first_protection_s").alias("first_protection_parse_success_count"),
        *[F.count_if(w).alias(w) for w in windows],
        *[F.count_if(F.col("partition") == p).alias(f"{p}_count") for p in ("train", "validation", "test")],
        (F.count(F.lit(1)) >= eligible).alias("first_version_eligible"),
        F.when(F.count(F.lit(1)) >= 3, "three-way grouped split").otherwise("train-only until more independent trajectories are available").alias("class_size_strategy"),
    )


def header_faults(header: DataFrame, expected: Sequence[str], id: str = "sample_id", column: str = "column") -> DataFrame:
    """Missing, extra and repeated column names of each source, from one row per name in its header."""
    names = header.groupBy(id, column).agg(F.count(F.lit(1)).alias("_n"))  # then one entry per distinct name
    have = names.groupBy(id).agg(F.collect_set(column).alias("_have"), F.max(F.col("_n") > 1).alias("duplicate_columns"))
    want = F.array(*[F.lit(c) for c in expected])
    return have.select(
        id, F.array_intersect(want, F.array_except(want, "_have")).alias("missing_columns"), F.array_sort(F.array_except("_have", want)).alias("extra_columns"),
        "duplicate_columns")


def input_gate(
    df: DataFrame, features: Sequence[str], injection: float, window: float, interval: float, tolerance: float, width: float,
    id: str = "sample_id", t: str = "t", order: Sequence[str] | None = None, span: str = "end", ordinal: str | None = None, header: DataFrame | None = None,
) -> DataFrame:
    """Error codes and quality figures per trajectory before any scoring.

    span = "end" tests the last time against the window, "length" tests last minus first.
    A feature with no value at all counts as a missing column and hides the other codes.
    `ordinal` holds each row's place in its source: steps are then taken in that order and the median step is reported.
    `header` has one row (id, column) for each name in a source's header; it adds missing, extra and repeated names.
    """
    s = steps(df, id, t, width, order, ordinal)
    bad_t = ~is_finite(F.col(t))
    inside = (F.col(t) > injection) & (F.col(t) <= injection + window)
    start, end = ends(t, ordinal)
    stats = s.groupBy(id).agg(
        F.count(F.lit(1)).alias("row_count"), F.max(bad_t).alias("_bad_t"), F.min("dt").alias("_dt_min"),
        F.max(F.abs(F.col("dt") - interval)).alias("sampling_interval_max_deviation_s"),
        start.alias("time_start_s"), end.alias("time_end_s"), F.min(t).alias("_lo"), F.max(t).alias("_hi"), F.max(F.col(t) <= injection).alias("_base"), F.max(inside).alias("_inside"),
        *[F.count(f).alias(f"_have_{f}") for f in features], *[F.max(~is_finite(F.col(f))).alias(f"_bad_{f}") for f in features],
    ).withColumn("window_s", F.col("_hi") - F.col("_lo"))
    none = F.array().cast("array<string>")
    absent = F.array_compact(F.array(*[F.when(F.col(f"_have_{f}") == 0, F.lit(f)) for f in features]))
    more = []
    if ordinal:
        stats = stats.join(medians(s, [id], "dt", "sampling_interval_median_s"), id, "left")
        more.append("sampling_interval_median_s")
    repeated = F.lit(False)
    if header is not None:
        faults = header_faults(header, [t, *features], id).select(F.col(id), *[F.col(c).alias(f"_{c}") for c in ("missing_columns", "extra_columns", "duplicate_columns")])
        stats = stats.join(faults, id, "left")
        absent = F.array_union(F.coalesce("_missing_columns", none), absent)
        repeated = F.col("_duplicate_columns")
        more.append(F.array_join(F.coalesce("_extra_columns", none), ";").alias("extra_columns"))
    length = F.col("_hi") if span == "end" else F.col("window_s")
    code = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    errors = F.array_compact(F.array(
        code(repeated, "duplicate_column_names"),
        code(F.col("_bad_t"), "time_contains_NaN_or_Inf"),
        code(F.col("row_count") < 2, "at_least_two_rows_required"),
        code(F.col("_dt_min") <= 0, "time_not_strictly_increasing_or_duplicate"),
        code(F.col("sampling_interval_max_deviation_s") > tolerance, "sampling_interval_off"),
        code(~F.col("_bad_t") & (length < window), "window_too_short"),
        code(~F.col("_bad_t") & ~F.col("_base"), "baseline_at_or_before_injection_missing"),
        code(~F.col("_bad_t") & ~F.col("_inside"), "no_samples_in_window"),
        *[code(F.col(f"_bad_{f}"), f"{f}_contains_NaN_or_Inf") for f in features],
    ))
    stats = stats.withColumn("_absent", absent)
    final = F.when(F.size("_absent") > 0, F.array(F.concat(F.lit("missing_required_columns:"), F.array_join("_absent", ",")))).otherwise(errors)
    return stats.withColumn("_errors", final).select(
        id, "row_count", "time_start_s", "time_end_s", "window_s", "sampling_interval_max_deviation_s", *more,
        F.array_join("_errors", ";").alias("errors"), (F.size("_errors") == 0).alias("valid"),
    )


def alignment_audit(aligned: DataFrame, features: Sequence[str], times: Sequence[float], id: str = "sample_id", t: str = "t") -> DataFrame:
    """At each chosen time: max and median over trajectories of the largest absolute difference to the reference."""
    gap = F.greatest(*[F.abs(F.col(f) - F.col(f"{f}_ref")) for f in features])
    rows = aligned.where(F.col(t).isin([float(x) for x in times])).select(id, t, gap.alias("_gap"))
    top = rows.groupBy(t).agg(F.max("_gap").alias("max_difference"), F.count(F.lit(1)).alias("n"))
    return top.join(medians(rows, [t], "_gap", "median_difference"), t)


def shared_times(df: DataFrame, t: str = "t", least: int = 2) -> DataFrame:
    return df.groupBy(t).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def label_correlations(long: DataFrame, keys: Sequence[str], value: str, target: str, threshold: float = 0.95) -> DataFrame:
    """Features whose |Pearson| with the target reaches the threshold; undefined ones drop out."""
    r = long.groupBy(*keys).agg(F.corr(value, target).alias("r"))
    return r.where(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") >= threshold))


def non_constant(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Features with more than one value, a missing value counting as one of its own."""
    v = F.when(is_finite(F.col(value)), F.col(value))
    stats = long.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.max(v.isNull()).alias("_miss"))
    return stats.where((F.col("_lo") < F.col("_hi")) | (F.col("_miss") & F.col("_lo").isNotNull())).select(*keys)


def sampling_patterns(df: DataFrame, windows: Sequence[float], injection: float, id: str = "sample_id", t: str = "t") -> DataFrame:
    """Per window: trajectories, distinct sample times, and whether all trajectories share the same times.

    They do exactly when every time occurs in every trajectory, so no time list is collected.
    """
    grid = F.array(*[F.lit(float(w)) for w in windows])
    rows = df.withColumn("window_s", F.explode(F.filter(grid, lambda w: (F.col(t) > injection) & (F.col(t) <= w + F.lit(injection)))))
    pairs = rows.groupBy("window_s", t, id).agg(F.count(F.lit(1)).alias("_c"))
    per_t = pairs.groupBy("window_s", t).agg(F.count(F.lit(1)).alias("_ids"), F.max("_c").alias("_most"))
    ids = pairs.groupBy("window_s", id).agg(F.sum("_c").alias("_p")).groupBy("window_s").agg(
        F.count(F.lit(1)).alias("trajectories"), F.min("_p").alias("points_min"), F.max("_p").alias("points_max"))
    out = per_t.groupBy("window_s").agg(F.count(F.lit(1)).alias("distinct_times"), F.min("_ids").alias("_least"), F.max("_most").alias("_most"))
    return out.join(ids, "window_s").select(
        "window_s", "trajectories", "distinct_times", "points_min", "points_max",
        ((F.col("_least") == F.col("trajectories")) & (F.col("_most") == 1)).alias("same_pattern"))


def landmark_coverage(rows: DataFrame, expected: DataFrame, landmarks: Sequence[float], id: str = "sample_id") -> DataFrame:
    """Every (landmark, expected id) that has no row: the missing ids as a table, not as a list."""
    want = expected.select(id).withColumn("landmark_s", F.explode(F.array(*[F.lit(float(x)) for x in landmarks])))
    return want.join(rows.select(id, "landmark_s"), [id, "landmark_s"], "left_anti")


def not_allowed(features: DataFrame, allowed: Sequence[str], column: str = "feature") -> DataFrame:
    """Features outside the literal allow-list."""
    return features.where(~F.col(column).isin(list(allowed)))
