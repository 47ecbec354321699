"""Evaluation metrics from one long prediction table.

Rows are reduced to confusion counts (or binned counts) before anything else, so every
later step works on tables whose size depends on labels and bins only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ordered import attach, quantile_bucket, running_sum
from tracewell.operators.quantiles import order_statistics, quantiles
from tracewell.operators.aggregates import conformal_rank
from tracewell.operators.ranking import best_per_group, held_out_row, union_all

COUNT = "_count"


def confusion_counts(pred: DataFrame, keys: Sequence[str], truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    return pred.groupBy(*keys, truth, guess).agg(F.count(F.lit(1)).alias(COUNT))


def label_counts(counts: DataFrame, keys: Sequence[str], labels: Sequence[str], truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """support, predicted and tp for every key and every label of the fixed set, zeros included."""
    tp = F.when(F.col(truth) == F.col(guess), F.col(COUNT)).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = counts.select(*keys, F.explode(F.array(
        F.struct(F.col(truth).alias("label"), F.col(COUNT).alias("support"), zero.alias("predicted"), tp.alias("tp")),
        F.struct(F.col(guess).alias("label"), zero.alias("support"), F.col(COUNT).alias("predicted"), zero.alias("tp")),
    )).alias("_s")).select(*keys, "_s.*")
    seen = sides.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    base = counts if keys else counts.withColumn("_all", F.lit(1))
    k = list(keys) or ["_all"]
    grid = base.groupBy(*k).agg(F.sum(COUNT).alias("_n")).withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    out = attach(grid, seen if keys else seen.withColumn("_all", F.lit(1)), [*k, "label"], "left")
    fill = lambda c: F.coalesce(F.col(c), zero).alias(c)
    return out.select(*keys, "label", fill("support"), fill("predicted"), fill("tp"), "_n")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(pred: DataFrame, keys: Sequence[str], labels: Sequence[str], truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """precision, recall, F1 and support per label; missing when the label has no support."""
    c = label_counts(confusion_counts(pred, keys, truth, guess), keys, labels, truth, guess)
    some = F.col("support") > 0
    return c.select(
        *keys, "label", "support",
        F.when(some, _ratio(F.col("tp"), F.col("predicted"))).alias("precision"),
        F.when(some, F.col("tp") / F.when(some, F.col("support"))).alias("recall"),
        F.when(some, _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))).alias("f1"),
    )


def _summaries(prefix: str = "") -> list[Column]:
    f1 = _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.when(F.col("support") > 0, F.col("support")))
    return [
        (F.sum("tp") / F.max("_n")).alias(f"{prefix}accuracy"),
        F.avg(recall).alias(f"{prefix}balanced_accuracy"),
        F.avg(f1).alias(f"{prefix}macro_f1_fixed"),
        F.avg(F.when(F.col("support") > 0, f1)).alias(f"{prefix}macro_f1_observed"),
        F.avg(F.when(F.col("support") >= 3, f1)).alias(f"{prefix}macro_f1_support_ge_3"),
        F.avg(F.when(F.col("support") >= 5, f1)).alias(f"{prefix}macro_f1_support_ge_5"),
    ]


def classification(pred: DataFrame, keys: Sequence[str], labels: Sequence[str], truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """Accuracy, balanced accuracy and macro-F1 over the fixed, observed and supported label sets."""
    c = label_counts(confusion_counts(pred, keys, truth, guess), keys, labels, truth, guess)
    return c.groupBy(*keys).agg(F.max("_n").alias("n"), *_summaries())


def regression(pred: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """MAE, RMSE and R2 (0 for a constant target)."""
    r = F.col(y) - F.col(p)
    sst = F.var_pop(y) * F.count(y)
    return pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"),
        F.when(sst > 0, 1 - F.sum(r * r) / F.when(sst > 0, sst)).otherwise(F.lit(0.0)).alias("r2"),
    )


def selective_from_counts(counts: DataFrame, keys: Sequence[str], labels: Sequence[str], truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """Coverage and accepted-only quality from confusion counts with an `_accepted` flag."""
    total = counts.groupBy(*keys).agg(F.sum(COUNT).alias("n_total"), F.coalesce(F.sum(F.when(F.col("_accepted"), F.col(COUNT))), F.lit(0)).alias("n_accepted"))
    taken = label_counts(counts.where("_accepted").groupBy(*keys, truth, guess).agg(F.sum(COUNT).alias(COUNT)), keys, labels, truth, guess)
    quality = taken.groupBy(*keys).agg(*_summaries())
    out = attach(total, quality, keys, "left")
    return out.select(
        *keys, "n_total", "n_accepted", (F.col("n_total") - F.col("n_accepted")).alias("n_rejected"),
        (F.col("n_accepted") / F.col("n_total")).alias("coverage"), F.col("accuracy").alias("selective_accuracy"),
        F.col("macro_f1_fixed").alias("selective_macro_f1"), F.col("balanced_accuracy").alias("selective_balanced_accuracy"),
        (1 - F.col("accuracy")).alias("risk"), (1 - F.col("n_accepted") / F.col("n_total")).alias("reject_rate"),
    )


def selective(pred: DataFrame, keys: Sequence[str], labels: Sequence[str], accepted: Column, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    counts = pred.withColumn("_accepted", F.coalesce(accepted, F.lit(False))).groupBy(*keys, truth, guess, "_accepted").agg(F.count(F.lit(1)).alias(COUNT))
    return selective_from_counts(counts, keys, labels, truth, guess)


def risk_coverage(
    pred: DataFrame, keys: Sequence[str], labels: Sequence[str], score: str, thresholds: Sequence[float],
    truth: str = "y_true", guess: str = "y_pred",
) -> DataFrame:
    """Selective metrics at every threshold of a fixed grid (accept when score >= threshold).

    Rows are counted once per passed-threshold level; the grid only multiplies the counts.
    """
    grid = sorted(float(x) for x in thresholds)
    arr = F.array(*[F.lit(x) for x in grid])
    level = F.size(F.filter(arr, lambda x: x <= F.col(score)))
    counts = pred.groupBy(*keys, truth, guess, level.alias("_level")).agg(F.count(F.lit(1)).alias(COUNT))
    spread = counts.select("*", F.posexplode(arr).alias("_pos", "threshold")).withColumn("_accepted", F.col("_pos") < F.col("_level"))
    merged = spread.groupBy(*keys, "threshold", truth, guess, "_accepted").agg(F.sum(COUNT).alias(COUNT))
    return selective_from_counts(merged, [*keys, "threshold"], labels, truth, guess)


def choose_threshold(curve: DataFrame, keys: Sequence[str], min_coverage: float = 0.5) -> DataFrame:
    """Best validation macro-F1 among thresholds with enough coverage (all of them if none has)."""
    ok = (F.col("coverage") >= min_coverage).cast("int")
    w = Window.partitionBy(*keys).orderBy(  # one row per grid threshold
        ok.desc(), F.col("selective_macro_f1").desc_nulls_last(), F.col("selective_accuracy").desc_nulls_last(), F.col("coverage").desc(), F.col("threshold"))
    return curve.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def combination_thresholds(
    pred: DataFrame, labels: Sequence[str], good: str, bad: str, targets: Sequence[float], target: float,
    truth: str = "y_true", guess: str = "y_pred",
) -> DataFrame:
    """Every pair of a `good >= a` and a `bad <= b` threshold from target coverages, closest coverage first.

    The two threshold lists (one number per target) are fitted first and reach the driver;
    the rows are then counted once per pair of levels.
    """
    names = {f"q{i}": t for i, t in enumerate(targets)}
    lo = quantiles(pred, [], good, {n: 1.0 - t for n, t in names.items()}, "lower").first()
    hi = quantiles(pred, [], bad, dict(names), "higher").first()
    a = F.array(*[F.lit(lo[n]) for n in names])
    b = F.array(*[F.lit(hi[n]) for n in names])
    passed_a = F.transform(a, lambda x: F.col(good) >= x)
    passed_b = F.transform(b, lambda x: F.col(bad) <= x)
    counts = pred.groupBy(truth, guess, passed_a.alias("_pa"), passed_b.alias("_pb")).agg(F.count(F.lit(1)).alias(COUNT))
    t = F.array(*[F.lit(float(x)) for x in targets])
    grid = (
        counts.select("*", F.posexplode(t).alias("_i", "good_target")).select("*", F.posexplode(t).alias("_j", "bad_target"))
        .withColumn("_accepted", F.element_at("_pa", F.col("_i") + 1) & F.element_at("_pb", F.col("_j") + 1))
        .groupBy("good_target", "bad_target", "_i", "_j", truth, guess, "_accepted").agg(F.sum(COUNT).alias(COUNT))
    )
    s = selective_from_counts(grid, ["good_target", "bad_target", "_i", "_j"], labels, truth, guess)
    w = Window.partitionBy(F.lit(1)).orderBy(  # one row per threshold pair
        F.round(F.abs(F.col("coverage") - target), 12), F.round("selective_macro_f1", 12).desc_nulls_last(), F.round("selective_accuracy", 12).desc_nulls_last(), "_i", "_j")
    return s.select(
        "*", F.element_at(a, F.col("_i") + 1).alias("good_threshold"), F.element_at(b, F.col("_j") + 1).alias("bad_threshold"),
        F.row_number().over(w).cast("long").alias("position"),
    ).drop("_i", "_j")


def cumulative_counts(pred: DataFrame, keys: Sequence[str], good: str, bad: str, at_least: Sequence[float], at_most: Sequence[float], truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """For each pair (i, j) of thresholds: confusion counts of the rows with `good` >= at_least[i] and `bad` <= at_most[j], and of all others.

    Rows are counted once by the number of thresholds that each of their scores passes; the pairs only add up these counts.
    """
    passed = [F.transform(F.array(*[F.lit(float(v)) for v in at_least]), lambda v: F.coalesce(F.col(good) >= v, F.lit(False))),
              F.transform(F.array(*[F.lit(float(v)) for v in at_most]), lambda v: F.coalesce(F.col(bad) <= v, F.lit(False)))]
    counts = pred.groupBy(*keys, truth, guess, passed[0].alias("_a"), passed[1].alias("_b")).agg(F.count(F.lit(1)).alias(COUNT))
    spread = counts.select("*", F.posexplode("_a").alias("i", "_ga")).select("*", F.posexplode("_b").alias("j", "_gb"))
    return spread.groupBy(*keys, "i", "j", truth, guess, (F.col("_ga") & F.col("_gb")).alias("_accepted")).agg(F.sum(COUNT).alias(COUNT))


def fitted_combination(
    validation: DataFrame, test: DataFrame, labels: Sequence[str], good: str, bad: str, targets: Sequence[float], target: float,
    truth: str = "y_true", guess: str = "y_pred",
) -> DataFrame:
    """Threshold pairs fitted and ranked on validation rows, and what each does to the test rows.

    One row per partition and pair with the selective metrics, the thresholds, the pair's `position` on validation (coverage
    closest to `target`, then macro-F1, accuracy and the order of `targets`) and whether it is the `chosen` one.  Only the
    thresholds, one number per target and score, reach the driver.
    """
    names = {f"q{i}": t for i, t in enumerate(targets)}
    lo = quantiles(validation, [], good, {n: 1.0 - t for n, t in names.items()}, "lower").first()
    hi = quantiles(validation, [], bad, dict(names), "higher").first()
    low, high = [lo[n] for n in names], [hi[n] for n in names]
    both = validation.select(F.lit("validation").alias("partition"), truth, guess, good, bad).unionByName(test.select(F.lit("test").alias("partition"), truth, guess, good, bad))
    out = selective_from_counts(cumulative_counts(both, ["partition"], good, bad, low, high, truth, guess), ["partition", "i", "j"], labels, truth, guess)
    w = Window.partitionBy("partition").orderBy(  # one row per pair
        F.round(F.abs(F.col("coverage") - target), 12), F.round("selective_macro_f1", 12).desc_nulls_last(), F.round("selective_accuracy", 12).desc_nulls_last(), "i", "j")
    place = out.withColumn("position", F.row_number().over(w).cast("long")).where("partition = 'validation'").select("i", "j", "position")
    at = lambda values, k: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col(k))
    out = attach(out, place, ["i", "j"])
    return out.select(
        "partition", at(targets, "i").alias("good_target"), at(targets, "j").alias("bad_target"), at(low, "i").alias("good_threshold"), at(high, "j").alias("bad_threshold"),
        *[c for c in out.columns if c not in ("partition", "i", "j", "position")], "position", (F.col("position") == 1).alias("chosen"))


def select_setting(per: DataFrame, keys: Sequence[str], settings: Sequence[str], scores: Sequence[str] = ("macro_f1_fixed", "accuracy")) -> DataFrame:
    """The best setting of each key on its validation row, and what it reached on test.

    `per` has one row for each key, setting and partition.  Scores are compared to nine digits, then settings in their order.  A chosen
    setting without exactly one test row fails the job.
    """
    order = [*[F.round(s, 9).desc_nulls_last() for s in scores], *settings]
    candidates = per.where("partition = 'validation'")
    best = best_per_group(candidates, keys, order)
    n = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"))
    test = held_out_row(best, per.where("partition = 'test'"), [*keys, *settings])
    pick = lambda df, p: df.select(*keys, *settings, *[F.col(s).alias(f"{p}_{s}") for s in scores])
    return pick(best, "validation").join(pick(test, "test"), [*keys, *settings]).join(n, list(keys))


def reliability(
    pred: DataFrame, keys: Sequence[str], probs: str, labels: Sequence[str], bins: int = 10, truth: str = "y_true", guess: str = "y_pred", eps: float = 1e-15
) -> DataFrame:
    """Dense reliability bins with expected calibration error, multiclass Brier score and log-loss."""
    p, names = F.col(probs), F.array(*[F.lit(x) for x in labels])
    conf = F.array_max(p)
    hit = F.transform(names, lambda l: F.when(l == F.col(truth), 1.0).otherwise(0.0))
    brier = F.aggregate(F.zip_with(p, hit, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
    own = F.element_at(p, F.array_position(names, F.col(truth)).cast("int"))
    rows = pred.select(
        *keys, conf.alias("_conf"), (F.col(guess) == F.col(truth)).cast("double").alias("_ok"), brier.alias("_brier"),
        (-F.log(F.least(F.greatest(own, F.lit(eps)), F.lit(1 - eps)))).alias("_loss"), F.least(F.floor(conf * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    k = list(keys) or ["_all"]
    rows = rows if keys else rows.withColumn("_all", F.lit(1))
    per = rows.groupBy(*k, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg("_conf").alias("mean_confidence"), F.avg("_ok").alias("accuracy"), F.sum("_brier").alias("_b"), F.sum("_loss").alias("_l"))
    total = per.groupBy(*k).agg(
        (F.sum(F.col("count") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("count")).alias("ece"),
        (F.sum("_b") / F.sum("count")).alias("brier_score"), (F.sum("_l") / F.sum("count")).alias("log_loss"))
    grid = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = attach(grid, per, [*k, "bin"], "left")
    return out.select(
        *keys, "bin", (F.col("bin") / bins).alias("bin_lower"), ((F.col("bin") + 1) / bins).alias("bin_upper"), F.coalesce("count", F.lit(0)).alias("count"),
        "mean_confidence", "accuracy", "ece", "brier_score", "log_loss")


def conformal_cutoffs(calibration: DataFrame, keys: Sequence[str], p_true: str, alphas: Mapping[str, float]) -> DataFrame:
    """Probability cutoff per alpha: 1 minus the conformal order statistic of 1 - p(true label)."""
    scored = calibration.withColumn("_nc", 1 - F.col(p_true))
    s = order_statistics(scored, keys, "_nc", {n: conformal_rank(a) for n, a in alphas.items()})
    return s.select(*keys, F.col("n").alias("calibration_n"), *[(1 - F.col(n)).alias(n) for n in alphas])


def conformal_metrics(
    pred: DataFrame, keys: Sequence[str], sets: str, labels: Sequence[str], truth: str = "y_true", guess: str = "y_pred"
) -> DataFrame:
    """Set coverage and sizes, plus selective metrics when only singleton sets are accepted."""
    size = F.size(sets)
    base = pred.groupBy(*keys).agg(
        F.avg(F.array_contains(sets, F.col(truth)).cast("double")).alias("empirical_set_coverage"), F.avg(size).alias("average_prediction_set_size"),
        F.avg((size == 1).cast("double")).alias("single_label_rate"), F.avg((size > 1).cast("double")).alias("ambiguous_multi_label_rate"),
        F.avg((size == 0).cast("double")).alias("empty_unknown_rate"))
    return attach(base, selective(pred, keys, labels, size == 1, truth, guess), keys)


def ranking_quality(pred: DataFrame, keys: Sequence[str], score: str, positive: str, rows_per_bucket: int = 10_000) -> DataFrame:
    """AUROC (ties count half) and average precision; NULL when only one class is present.

    Rows collapse to distinct scores first; the running counts go bucket by bucket.
    """
    k = list(keys) or ["_all"]
    src = pred if keys else pred.withColumn("_all", F.lit(1))
    v = F.col(score).cast("double")
    counts = src.where(v.isNotNull() & ~F.isnan(v) & F.col(positive).isNotNull()).groupBy(*k, v.alias("_v")).agg(
        F.count_if(F.col(positive)).alias("_p"), F.count_if(~F.col(positive)).alias("_q"))
    cum = running_sum(quantile_bucket(counts, k, "_v", rows_per_bucket), k, ["_v"], {"_cp": F.col("_p"), "_cq": F.col("_q")})
    tot = counts.groupBy(*k).agg(F.sum("_p").alias("_np"), F.sum("_q").alias("_nq"))
    both = attach(cum, tot, k)
    # from the top: everything at or above this score
    tp, fp = F.col("_np") - F.col("_cp") + F.col("_p"), F.col("_nq") - F.col("_cq") + F.col("_q")
    out = both.groupBy(*k).agg(
        F.max("_np").alias("n_positive"), F.max("_nq").alias("n_negative"),
        F.sum(F.col("_p") * (F.col("_cq") - F.col("_q") + F.col("_q") / 2.0)).alias("_u"), F.sum(F.col("_p") * tp / (tp + fp)).alias("_ap"))
    two = (F.col("n_positive") > 0) & (F.col("n_negative") > 0)
    return out.select(
        *keys, "n_positive", "n_negative",
        F.when(two, F.col("_u") / F.when(two, F.col("n_positive") * F.col("n_negative"))).alias("auroc"),
        F.when(two, F.col("_ap") / F.when(two, F.col("n_positive"))).alias("average_precision"))


def detection_table(samples: DataFrame, proxies: Mapping[str, Column], score: str = "ood_score", keys: Sequence[str] = ("mechanism",), gap: str = "gap") -> DataFrame:
    """Per (mechanism, proxy): reject rates inside and outside the proxy, ranking quality and gap means."""
    arr = F.array(*[F.struct(F.lit(n).alias("proxy_type"), c.alias("is_ood")) for n, c in proxies.items()])
    rows = samples.withColumn("_p", F.explode(arr)).select("*", "_p.proxy_type", "_p.is_ood").drop("_p").where("is_ood IS NOT NULL")
    k = [*keys, "proxy_type"]
    rate = lambda c: F.avg(F.when(c, F.col("rejected").cast("double")))
    mean = lambda c: F.avg(F.when(c, F.col(gap)))
    base = rows.groupBy(*k).agg(
        F.count_if("is_ood").alias("n_ood_proxy"), F.count_if(~F.col("is_ood")).alias("n_id_proxy"), rate(F.col("is_ood")).alias("ood_reject_rate"),
        rate(~F.col("is_ood")).alias("id_reject_rate"), mean(F.col("rejected")).alias("mean_gap_rejected"), mean(~F.col("rejected")).alias("mean_gap_accepted"))
    out = attach(base, ranking_quality(rows, k, score, "is_ood").select(*k, "auroc", "average_precision"), k, "left")
    return out.withColumn("gap_difference", F.col("mean_gap_rejected") - F.col("mean_gap_accepted"))


def rejection_by_class(samples: DataFrame, keys: Sequence[str], label: str, focus: Sequence[str], gap: str = "gap") -> DataFrame:
    """Rejection of each focus class and how it compares with all other classes."""
    k = [*keys]
    per = samples.groupBy(*k, label).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if("rejected").alias("n_rejected"),
        F.avg(F.when(F.col("rejected"), F.col(gap))).alias("gap_mean_rejected"), F.avg(F.when(~F.col("rejected"), F.col(gap))).alias("gap_mean_accepted"))
    w = Window.partitionBy(*k) if k else Window.partitionBy(F.lit(1))  # one row per class
    n, r = F.col("n_total"), F.col("n_rejected")
    other = (F.sum(r).over(w) - r) / (F.sum(n).over(w) - n)
    out = per.withColumn("reject_rate", r / n).withColumn("other_reject_rate", other)
    return out.withColumn("enrichment", F.col("reject_rate") - F.col("other_reject_rate")).where(F.col(label).isin(list(focus)))


def parity(expected: DataFrame, actual: DataFrame, keys: Sequence[str], discrete: Sequence[str], numeric: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Per row: do the discrete columns agree and how far apart are the numbers.

    Two NULLs agree; against a number a NULL fails, and then there is no `max_delta`.
    """
    e = expected.select(*keys, F.struct(*discrete, *numeric).alias("_e"))
    a = actual.select(*keys, F.struct(*discrete, *numeric).alias("_a"))
    same = F.lit(True)
    for c in discrete:
        same = same & F.col(f"_e.{c}").eqNullSafe(F.col(f"_a.{c}"))
    apart = [F.when(F.col(f"_e.{c}").eqNullSafe(F.col(f"_a.{c}")), 0.0).otherwise(F.abs(F.col(f"_e.{c}") - F.col(f"_a.{c}"))) for c in numeric]
    known = F.lit(True)
    for d in apart:
        known = known & d.isNotNull()
    delta = F.when(known, F.greatest(F.lit(0.0), F.lit(0.0), *apart))
    both = F.col("_e").isNotNull() & F.col("_a").isNotNull()
    return e.join(a, list(keys), "full_outer").select(
        *keys, both.alias("in_both"), F.coalesce(both & same, F.lit(False)).alias("discrete_match"), F.when(both, delta).alias("max_delta"),
        F.coalesce(both & same & (delta <= tolerance), F.lit(False)).alias("passed"))


def capability_tiers(support: DataFrame, matched: str = "matched", low: str = "low_support", high: str = "high_support", missing: Column | None = None) -> DataFrame:
    """Tier A needs 20 matched cases and 5 test cases in both directions; any matched case gives tier B."""
    full = (F.col(matched) >= 20) & (F.col(low) >= 5) & (F.col(high) >= 5)
    if missing is not None:
        full = full & ~missing
    tier = F.when(full, "Tier A").when(F.col(matched) > 0, "Tier B").otherwise("Tier C")
    status = F.when(full, "supported").when(F.col(matched) > 0, "exploratory").otherwise("not-supported")
    return support.withColumn("tier", tier).withColumn("status", status)


def family_tiers(classes: DataFrame, family: str = "family", label: str = "class", expected: str = "expected") -> DataFrame:
    """Capability of each family from its members' support (label, family, matched, low_support, high_support), with the members named.

    Only members with a matched case lend their support.  `expected` marks the members that a family must have: one of them without a matched
    case keeps it from tier A.
    """
    active = F.col("matched") > 0
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col(label)))), ";")  # a few members
    out = classes.groupBy(family).agg(
        listed(F.lit(True)).alias("members"), listed(F.col(expected)).alias("expected_members"), listed(active).alias("active_members"),
        listed(F.col(expected) & ~active).alias("missing_members"),
        *[F.coalesce(F.sum(F.when(active, F.col(c))), F.lit(0)).cast("long").alias(c) for c in ("matched", "low_support", "high_support")])
    return capability_tiers(out, missing=F.col("missing_members") != "")


def release_benchmark(
    pred: DataFrame, labels: Sequence[str], accepted: Column, sets: str, ood: str, status: str, tier: str, truth: str = "y_true", guess: str = "y_pred"
) -> DataFrame:
    """Everything that is reported for a locked cohort, as (metric_group, metric, key, value) rows.

    forced: all rows decided; selective: accepted rows only; conformal: prediction sets; ood: warnings and the
    accuracy with and without one; per_class: recall and support; status_by_tier: rows of each status and tier.
    Every group reduces the rows to counts before it goes on.
    """
    one = pred.withColumn("_every", F.lit(""))
    warned = F.coalesce(F.col(ood), F.lit(False))
    hit = (F.col(truth) == F.col(guess)).cast("double")
    warnings = one.agg(
        F.avg(warned.cast("double")).alias("warning_rate"), F.avg(F.when(warned, hit)).alias("accuracy_with_warning"), F.avg(F.when(~warned, hit)).alias("accuracy_without_warning"))
    cells = pred.groupBy(F.concat_ws("|", status, tier).alias("_cell")).agg(F.count(F.lit(1)).alias("count"))
    sizes = ["empirical_set_coverage", "average_prediction_set_size", "single_label_rate", "ambiguous_multi_label_rate", "empty_unknown_rate"]
    return union_all([
        long_metrics(classification(one, ["_every"], labels, truth, guess), "forced", ["accuracy", "balanced_accuracy", "macro_f1_fixed"]),
        long_metrics(selective(one, ["_every"], labels, accepted, truth, guess), "selective", ["coverage", "selective_accuracy", "selective_macro_f1", "risk"]),
        long_metrics(conformal_metrics(one, ["_every"], sets, labels, truth, guess), "conformal", sizes),
        long_metrics(warnings, "ood", ["warning_rate", "accuracy_with_warning", "accuracy_without_warning"]),
        long_metrics(per_class(pred, [], labels, truth, guess), "per_class", ["recall", "support"], "label"),
        long_metrics(cells, "status_by_tier", ["count"], "_cell"),
    ])


def long_metrics(row: DataFrame, group: str, metrics: Sequence[str], key: str | None = None) -> DataFrame:
    """(metric_group, metric, key, value) rows from a wide metric table."""
    k = F.col(key).cast("string") if key else F.lit("")
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return row.select(F.lit(group).alias("metric_group"), k.alias("key"), F.explode(arr).alias("_m")).select("metric_group", "_m.metric", "key", "_m.value")
