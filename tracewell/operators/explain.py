"""Attribution of decisions to input variables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import base_variable, top_two_margin
from tracewell.operators import splits
from tracewell.operators.decide import ClassDistance
from tracewell.operators.learn import Classifier
from tracewell.operators.ordered import attach
from tracewell.operators.windows import perturb_after

EPS = 1e-15


def _own(probs: str, label: Column, labels: Sequence) -> Column:
    return F.element_at(probs, F.array_position(F.array(*[F.lit(c) for c in labels]), label).cast("int"))


def _replace(x: str | Column, j: Column, value: Column) -> Column:
    """Array with element j (zero based) replaced."""
    return F.transform(x, lambda v, i: F.when(i == j, value).otherwise(v))


def shuffled_partner(df: DataFrame, id: str, seed: int, repeat: int, x: str = "x") -> DataFrame:
    """Give every row the vector of another row: a permutation by hashed ranks, one equi-join per repeat.

    Ranks are computed inside hash buckets, so there is no global sort.
    """
    base = df.select(id, x).withColumn("_all", F.lit(1))
    a = splits._hash_ranked(base, ["_all"], splits.seeded_digest(seed, id), id).select(F.col(id), F.col("_rank").alias("_k"))
    c = splits._hash_ranked(base, ["_all"], splits.seeded_digest(seed + 1 + repeat, id), id).select(F.col("_rank").alias("_k"), F.col(x).alias("_other"))
    return df.join(a.join(c, "_k").drop("_k"), id)


def permutation_importance(df: DataFrame, model: Classifier, label: str, features: Sequence[str], repeats: int = 8, seed: int = 7, id: str = "sample_id") -> DataFrame:
    """Mean and mean absolute change of log-loss when one feature is permuted.

    Variants are exploded from each row and scored by the model in one pass per repeat.
    """
    own = _own("probs", F.col(label), model.labels)
    loss = -F.log(F.least(F.greatest(own, F.lit(EPS)), F.lit(1 - EPS)))
    base = model.predict(df.select(id, label, "x")).agg(F.avg(loss).alias("m")).first()["m"]
    parts = None
    for r in range(repeats):
        rows = shuffled_partner(df.select(id, label, "x"), id, seed, r)
        # one cell of the partner goes with each variant, not its whole vector
        variants = rows.select(id, label, "x", F.posexplode("_other").alias("j", "_cell")).withColumn("x", _replace("x", F.col("j"), F.col("_cell"))).drop("_cell")
        one = model.predict(variants).groupBy("j").agg(F.avg(loss).alias("m")).withColumn("repeat", F.lit(r))
        parts = one if parts is None else parts.unionByName(one)
    names = F.array(*[F.lit(f) for f in features])
    delta = F.col("m") - base
    return parts.groupBy(F.get(names, F.col("j")).alias("feature")).agg(
        F.avg(delta).alias("delta_log_loss"), F.stddev_pop(delta).alias("delta_std"), F.avg(F.abs(delta)).alias("importance"), F.count(F.lit(1)).alias("repeats"))


def importance_variables(importance: DataFrame, feature: str = "feature") -> DataFrame:
    """`permutation_importance` summed over the engineered features of each base variable."""
    return importance.groupBy(base_variable(F.col(feature)).alias("variable")).agg(
        F.sum("importance").alias("importance"), F.sum("delta_log_loss").alias("delta_log_loss"), F.count(F.lit(1)).alias("features"))


def value_drivers(df: DataFrame, predict: Callable[[Column], Column], center: Sequence[float], names: Sequence[str], keep: Sequence[str], x: str = "x") -> DataFrame:
    """Change of an estimate when one feature is set to its training centre, one row per feature.

    `predict` turns a column of feature arrays into the estimate.
    """
    c = F.array(*[F.lit(float(v)) for v in center])
    cells = df.select(*keep, x, predict(F.col(x)).alias("estimate"), F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("_j"))
    moved = cells.withColumn("_x", _replace(x, F.col("_j"), F.get(c, F.col("_j"))))
    return moved.select(*keep, F.get(F.array(*[F.lit(n) for n in names]), F.col("_j")).alias("feature"), "estimate", (F.col("estimate") - predict(F.col("_x"))).alias("contribution"))


def value_faithfulness(
    df: DataFrame, predict: Callable[[Column], Column], center: Sequence[float], k: int = 5, draws: int = 5, seed: int = 7, id: str = "sample_id", x: str = "x"
) -> DataFrame:
    """Change of an estimate when its k strongest features are set to their centres, against the mean and spread over random sets of k."""
    size = len(center)
    c = F.array(*[F.lit(float(v)) for v in center])
    # What a lambda names is computed anew for each of its elements, so the arrays that rows have once are arguments of functions.
    first = lambda pairs: F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: s["j"])
    alone = lambda j: predict(_replace(x, j, F.get(c, j)))
    effects = F.array(*[F.abs(F.col("_e") - alone(F.lit(j))) for j in range(size)])
    without = lambda chosen: F.col("_e") - predict(F.aggregate(chosen, F.col(x), lambda v, j: _replace(v, j, F.get(c, j))))
    drawn = lambda i: first(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.struct(F.xxhash64(F.lit(seed + i), F.col(id), j).alias("k"), j.alias("j"))))
    # A few bytes for each row, but much work: all tasks get their share of the rows.
    dealt = df.select(id, x).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), id)
    rows = dealt.withColumn("_e", predict(F.col(x))).withColumn("_abs", effects)
    rows = rows.withColumn("_top", first(F.transform("_abs", lambda a, j: F.struct((-a).alias("k"), j.alias("j")))))
    out = rows.select(
        id, F.col("_e").alias("estimate"), F.array_sort("_top").alias("top_features"), without(F.col("_top")).alias("top_k_effect"),
        F.array(*[without(drawn(i)) for i in range(draws)]).alias("_random"))
    out = out.withColumn("random_k_effect", sum((F.get("_random", F.lit(i)) for i in range(1, draws)), F.get("_random", F.lit(0))) / draws)
    spread = F.sqrt(F.aggregate("_random", F.lit(0.0), lambda acc, v: acc + (v - F.col("random_k_effect")) * (v - F.col("random_k_effect"))) / draws)
    gain = F.col("top_k_effect") - F.col("random_k_effect")
    return out.select(id, "estimate", "top_features", "top_k_effect", "random_k_effect", spread.alias("random_k_std"), gain.alias("difference"), (gain > 0).alias("top_exceeds_random"))


def leave_one_out(df: DataFrame, model: Classifier, center: Sequence[float], features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Drop of the predicted class's probability when one feature is set to its training centre."""
    base = model.predict(df).withColumn("_p", F.array_max("probs")).withColumnRenamed("y_pred", "_guess").drop("probs")
    c = F.array(*[F.lit(float(v)) for v in center])
    variants = base.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1)))).withColumn("x", _replace("x", F.col("j"), F.get(c, F.col("j"))))
    scored = model.predict(variants)
    names = F.array(*[F.lit(f) for f in features])
    return scored.select(*keep, F.get(names, F.col("j")).alias("feature"), (F.col("_p") - _own("probs", F.col("_guess"), model.labels)).alias("contribution"))


def distance_drivers(deltas: DataFrame, keys: Sequence[str], delta: str, diagonal: str, full: Column | None = None) -> DataFrame:
    """Diagonal share of a quadratic distance per feature, its direction, and what the cross terms leave over."""
    w = Window.partitionBy(*keys)  # one row per feature of one decision
    part = F.greatest(F.lit(0.0), F.col(delta) * F.col(delta) * F.col(diagonal))
    out = deltas.withColumn("contribution", part).withColumn("_sum", F.sum("contribution").over(w))
    out = out.withColumn("fraction", F.when(F.col("_sum") > 0, F.col("contribution") / F.col("_sum")).otherwise(F.lit(0.0)))
    side = F.when(F.col(delta) > 0, "above_class_center").when(F.col(delta) < 0, "below_class_center").otherwise("at_class_center")
    out = out.withColumn("direction", side)
    if full is not None:
        out = out.withColumn("cross_term_residual", full - F.col("_sum"))
    return out.drop("_sum")


def distance_explanation(rows: DataFrame, distance: ClassDistance, names: Sequence[str], keep: Sequence[str], x: str = "x", guess: str = "y_pred") -> DataFrame:
    """What moves each row away from its predicted class, one row per feature, from the fitted shrunk precision.

    contribution is the feature's diagonal share of the squared distance, fraction its part of all diagonal shares,
    displacement its standardised distance to the class centre.  Cross terms belong to no feature: cross_term_residual is what they
    leave over, so contributions and residual add up to `distance`.  Rows of a class without a model are left out.
    """
    parts = rows.select(*keep, distance.parts(x, guess).alias("_p")).where("_p is not null")
    total = F.aggregate("_p.diagonal", F.lit(0.0), lambda acc, v: acc + v)
    cells = parts.withColumn("_sum", total).select(
        *keep, F.col("_p.distance").alias("distance"), (F.col("_p.distance") - F.col("_sum")).alias("cross_term_residual"), "_sum",
        F.posexplode(F.arrays_zip(F.col("_p.diagonal").alias("c"), F.col("_p.displacement").alias("d"))).alias("j", "_c"))
    side = F.when(F.col("displacement") > 0, "above_class_center").when(F.col("displacement") < 0, "below_class_center").otherwise("at_class_center")
    out = cells.withColumn("contribution", F.col("_c.c")).withColumn("displacement", F.col("_c.d"))
    return out.select(
        *keep, F.get(F.array(*[F.lit(n) for n in names]), F.col("j")).alias("feature"), "contribution",
        F.when(F.col("_sum") > 0, F.col("contribution") / F.col("_sum")).otherwise(F.lit(0.0)).alias("fraction"), "displacement", side.alias("direction"),
        "distance", "cross_term_residual")


def distance_variables(features: DataFrame, keys: Sequence[str], feature: str = "feature") -> DataFrame:
    """`distance_explanation` rolled up to base variables; the direction is that of the displacement weighted by contribution."""
    out = features.groupBy(*keys, base_variable(F.col(feature)).alias("variable")).agg(
        F.sum("contribution").alias("contribution"), F.sum(F.col("contribution") * F.col("displacement")).alias("weighted_displacement"), F.count(F.lit(1)).alias("features"))
    w = F.col("weighted_displacement")
    return out.withColumn("direction", F.when(w > 0, "above_class_center").when(w < 0, "below_class_center").otherwise("at_class_center"))


def by_variable(contributions: DataFrame, keys: Sequence[str], value: str = "contribution", feature: str = "feature") -> DataFrame:
    """Engineered features rolled up to their base variable: signed and absolute sums."""
    return contributions.groupBy(*keys, base_variable(F.col(feature)).alias("variable")).agg(
        F.sum(value).alias("signed_sum"), F.sum(F.abs(value)).alias("absolute_sum"), F.count(F.lit(1)).alias("features"))


def faithfulness(df: DataFrame, model: Classifier, center: Sequence[float], features: Sequence[str], k: int = 5, draws: int = 5, seed: int = 7, id: str = "sample_id") -> DataFrame:
    """Effect of removing the k strongest features against the mean effect of k random ones."""
    contrib = leave_one_out(df, model, center, [str(i) for i in range(len(features))], [id])
    w = Window.partitionBy(id).orderBy(F.abs("contribution").desc(), F.col("feature").cast("int"))  # one row per feature
    top = contrib.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(id).agg(F.collect_set(F.col("feature").cast("int")).alias("_set"))
    all_j = F.sequence(F.lit(0), F.lit(len(features) - 1))
    drawn = lambda d: F.slice(F.transform(F.array_sort(F.transform(all_j, lambda j: F.struct(F.xxhash64(F.lit(seed + d), F.col(id), j).alias("h"), j.alias("j")))), lambda s: s["j"]), 1, k)
    sets = F.array(F.struct(F.lit("top").alias("kind"), F.col("_set").alias("s")), *[F.struct(F.lit("random").alias("kind"), drawn(i).alias("s")) for i in range(draws)])
    c = F.array(*[F.lit(float(v)) for v in center])
    base = model.predict(df.select(id, "x")).withColumn("_p", F.array_max("probs")).withColumnRenamed("y_pred", "_guess").drop("probs")
    variants = base.join(top, id).withColumn("_v", F.explode(sets)).withColumn(
        "x", F.transform("x", lambda v, i: F.when(F.array_contains(F.col("_v.s"), i), F.get(c, i)).otherwise(v))).withColumn("kind", F.col("_v.kind")).drop("_v", "_set")
    drop = F.col("_p") - _own("probs", F.col("_guess"), model.labels)
    scored = model.predict(variants).groupBy(id).agg(
        F.avg(F.when(F.col("kind") == "top", drop)).alias("top_k_effect"), F.avg(F.when(F.col("kind") == "random", drop)).alias("random_k_effect"),
        F.stddev_pop(F.when(F.col("kind") == "random", drop)).alias("random_k_std"))
    return scored.withColumn("difference", F.col("top_k_effect") - F.col("random_k_effect"))


def stability(before: DataFrame, after: DataFrame, keys: Sequence[str], feature: str = "feature", value: str = "contribution", k: int = 5) -> DataFrame:
    """Jaccard of the top-k features and rank correlation on the common ones (NULL below two)."""
    w = Window.partitionBy(*keys).orderBy(F.abs(value).desc(), feature)  # one row per feature of one decision

    def top(df, n):
        return df.withColumn(n, F.row_number().over(w)).where(F.col(n) <= k).select(*keys, feature, n)

    both = top(before, "_ra").join(top(after, "_rb"), [*keys, feature], "full_outer")
    common = F.col("_ra").isNotNull() & F.col("_rb").isNotNull()
    out = both.groupBy(*keys).agg(
        F.count_if(common).alias("common"), F.count(F.lit(1)).alias("_union"), F.corr(F.when(common, F.col("_ra")), F.when(common, F.col("_rb"))).alias("_r"))
    return out.select(*keys, "common", (F.col("common") / F.col("_union")).alias("jaccard"), F.when(F.col("common") >= 2, F.col("_r")).alias("rank_correlation"))


def perturbation_stability(
    raw: DataFrame, scales: DataFrame, features: Sequence[str], injection: float, run: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    keys: Sequence[str], factor: float = 0.001, k: int = 5,
) -> DataFrame:
    """Decide every trajectory twice, from its series as it is and from the series moved by `factor` of each train scale after the injection.

    `run` takes raw series and gives the decisions (keys, status, score) and their contributions (keys, feature, contribution).  One row
    per trajectory: both statuses and whether they differ, the change of the score, and Jaccard and rank correlation of the
    top-k features.  A trajectory that only one run decides keeps its row, with NULL for the other.
    """
    decided, parts = run(raw)
    again, parts_again = run(perturb_after(raw, scales, features, injection, factor))
    both = decided.select(*keys, "status", "score").join(
        again.select(*keys, F.col("status").alias("perturbed_status"), F.col("score").alias("_score")), list(keys), "full_outer")
    out = both.join(stability(parts, parts_again, keys, k=k), list(keys), "left")
    return out.select(
        *keys, "status", "perturbed_status", (~F.col("status").eqNullSafe(F.col("perturbed_status"))).alias("status_changed"),
        (F.col("_score") - F.col("score")).alias("score_change"), "common", "jaccard", "rank_correlation")


def uncertainty(probs: Column, labels: Sequence[str]) -> dict[str, Column]:
    """Top two labels, margin and nonconformity of the best label."""
    order = F.reverse(F.array_sort(F.transform(F.arrays_zip(probs.alias("p"), F.array(*[F.lit(len(labels) - i) for i in range(len(labels))]).alias("o"), F.array(*[F.lit(c) for c in labels]).alias("l")), lambda s: s)))
    return {
        "top1": F.element_at(order, 1)["l"], "top2": F.element_at(order, 2)["l"], "margin": top_two_margin(probs), "nonconformity": 1 - F.array_max(probs),
    }
