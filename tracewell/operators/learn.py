"""Train-only learning operators on MLlib and on small fitted parameter tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import argmax_label, is_finite
from tracewell.operators import aggregates as agg
from tracewell.operators import binned, gram
from tracewell.operators import trees as grown
from tracewell.operators.ordered import attach
from tracewell.operators.quantiles import medians
from tracewell.session import cut_lineage

LABEL_INDEX, FEATURES = "_y", "_features"


def indexed(df: DataFrame, label: str, labels: Sequence, x: str = "x") -> DataFrame:
    """Feature vector and label index in the fixed label order."""
    table = F.create_map(*[F.lit(v) for i, c in enumerate(labels) for v in (c, float(i))])
    return df.withColumn(LABEL_INDEX, F.element_at(table, F.col(label))).withColumn(FEATURES, array_to_vector(F.col(x)))


# ---------------------------------------------------------------- classifiers


@dataclass(frozen=True)
class Classifier:
    """One fitted MLlib model, or one binary model per label, giving `probs` in label order.

    With `votes`, the models are parts of one forest that hold so many trees each; their probabilities are averaged by these.
    """

    labels: tuple
    models: tuple[PipelineModel, ...]
    votes: tuple[int, ...] = ()

    def predict(self, df: DataFrame, x: str = "x", probs: str = "probs", guess: str = "y_pred") -> DataFrame:
        keep = df.columns
        cur = df.withColumn(FEATURES, array_to_vector(F.col(x)))
        if self.votes or len(self.models) == 1:
            names = [f"_p{i}" for i in range(len(self.models))]
            for i, m in enumerate(self.models):
                p = vector_to_array("probability")
                if m.stages[-1].numClasses < len(self.labels):  # the last labels had no train row
                    p = F.transform(F.sequence(F.lit(0), F.lit(len(self.labels) - 1)), lambda k: F.coalesce(F.get(vector_to_array("probability"), k), F.lit(0.0)))
                cur = m.transform(cur).withColumn(names[i], p).select(*keep, FEATURES, *names[: i + 1])
            votes = self.votes or (1,)
            share = lambda k: lambda v: v * F.lit(k / sum(votes))
            parts = [F.transform(n, share(k)) for n, k in zip(names, votes, strict=True)] if len(names) > 1 else [F.col(names[0])]
            out = cur.withColumn(probs, reduce(lambda a, c: F.zip_with(a, c, lambda v, w: v + w), parts)).select(*keep, probs)
        else:
            names = []
            for i, m in enumerate(self.models):
                cur = m.transform(cur).withColumn(f"_p{i}", vector_to_array("probability")[1])
                names.append(f"_p{i}")
                cur = cur.select(*keep, FEATURES, *names)
            total = reduce(lambda a, c: a + c, [F.col(n) for n in names])
            out = cur.withColumn(probs, F.transform(F.array(*names), lambda p: p / total)).select(*keep, probs)
        return out.withColumn(guess, argmax_label(F.col(probs), list(self.labels)))


@dataclass(frozen=True)
class GrownForest:
    """A forest whose trees are rows; `predict` as of a Classifier."""

    labels: tuple
    forest: grown.Trees

    def predict(self, df: DataFrame, x: str = "x", probs: str = "probs", guess: str = "y_pred") -> DataFrame:
        return self.forest.probabilities(df, x, probs).withColumn(guess, argmax_label(F.col(probs), list(self.labels)))

    def release(self) -> None:
        """Gives back what the trees take; later predictions grow them again."""
        self.forest.release()


MAX_DEPTH = 30  # the deepest trees that MLlib grows; forests are meant to grow until their leaves are small


def _scaled(stage) -> Pipeline:
    scaler = StandardScaler(inputCol=FEATURES, outputCol="_z", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, stage])


def fit_logistic(train: DataFrame, label: str, labels: Sequence, c: float = 1.0, weight: str | None = None, iterations: int = 100) -> Classifier:
    """Standardised multinomial logistic regression; C is turned into MLlib's per-row penalty."""
    rows = indexed(train, label, labels).persist()
    lr = LogisticRegression(
        featuresCol="_z", labelCol=LABEL_INDEX, family="multinomial", elasticNetParam=0.0, standardization=False,
        regParam=1.0 / (c * rows.count()), maxIter=iterations)
    if weight:
        lr = lr.setWeightCol(weight)
    model = _scaled(lr).fit(rows)
    rows.unpersist()
    return Classifier(tuple(labels), (model,))


#: Numbers that one partition of a forest's train rows holds.  Each partition has statistics of all nodes of a level, so that few
#: partitions, and trees grown in parallel, cost less than many partitions.
CELLS_PER_PARTITION = 1 << 22


def _packed(rows: DataFrame, x: str = FEATURES) -> DataFrame:
    """`rows` in partitions of at most CELLS_PER_PARTITION numbers, kept in memory or on disk."""
    size = rows.agg(F.sum(F.size(vector_to_array(x)))).first()[0] or 0
    return rows.repartition(max(1, -(-size // CELLS_PER_PARTITION))).persist()


def _batches(trees: int, batch: int) -> list[int]:
    return [min(batch, trees - at) for at in range(0, trees, batch)]


#: Train rows of so many numbers grow whole trees in tasks (`trees`).  Smaller forests are MLlib's models, which a bundle can hold; rows beyond that
#: do not fit a task at one byte for each number, and MLlib grows the trees level by level.
GROWN = (1 << 12, 1 << 27)


def fit_forest(
    train: DataFrame, label: str, labels: Sequence, trees: int = 200, weight: str | None = None, seed: int = 7, depth: int = MAX_DEPTH, batch: int = 25, workers: int = 8
) -> Classifier | GrownForest:
    """`trees` trees over 32 bins of each feature, each on rows drawn by a Poisson number, with two rows in a leaf at least.

    MLlib grows `batch` at a time in parallel jobs; the node of every row is kept beside it, so that no level sends the trees to all tasks.
    """
    size, features = train.agg(F.sum(F.size("x")), F.max(F.size("x"))).first()
    if GROWN[0] < (size or 0) <= GROWN[1]:
        rows = indexed(train, label, labels).select("x", F.col(LABEL_INDEX).alias("y"), *([F.col(weight).cast("double").alias("w")] if weight else [])).persist()
        forest = grown.fit_forest(rows, features, len(labels), trees, seed, depth, 2, weight is not None)
        rows.unpersist()
        return GrownForest(tuple(labels), forest)
    rows = _packed(indexed(train, label, labels).select(FEATURES, LABEL_INDEX, *([weight] if weight else [])))
    sizes = _batches(trees, batch)

    def grow(i: int) -> PipelineModel:
        rf = RandomForestClassifier(
            featuresCol=FEATURES, labelCol=LABEL_INDEX, numTrees=sizes[i], minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=seed + i, maxDepth=depth,
            cacheNodeIds=True, maxMemoryInMB=512)
        if weight:
            rf = rf.setWeightCol(weight)
        return Pipeline(stages=[rf]).fit(rows)

    with ThreadPoolExecutor(workers) as pool:
        models = tuple(pool.map(grow, range(len(sizes))))
    rows.unpersist()
    return Classifier(tuple(labels), models, tuple(sizes))


def fit_boosted(train: DataFrame, label: str, labels: Sequence, iterations: int = 180, step: float = 0.05, depth: int = 4, seed: int = 7, workers: int = 8) -> Classifier:
    """One boosted binary model per label, grown in parallel jobs; the positive probabilities are normalised."""
    rows = _packed(indexed(train, label, labels).select(FEATURES, LABEL_INDEX))

    def grow(i: int) -> PipelineModel:
        gbt = GBTClassifier(featuresCol=FEATURES, labelCol="_b", maxIter=iterations, stepSize=step, maxDepth=depth, seed=seed, maxMemoryInMB=512)
        return Pipeline(stages=[gbt]).fit(rows.withColumn("_b", (F.col(LABEL_INDEX) == i).cast("double")))

    with ThreadPoolExecutor(workers) as pool:
        models = tuple(pool.map(grow, range(len(labels))))
    rows.unpersist()
    return Classifier(tuple(labels), models)


def majority_class(train: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """The most frequent training class, ties to the smallest label."""
    return agg.most_frequent(train, keys, label)


# ---------------------------------------------------------------- regression


@dataclass(frozen=True)
class Ridge:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def predict(self, x: Column) -> Column:
        w = self.weights / self.scale
        terms = F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, c: a * c)
        return F.aggregate(terms, F.lit(self.intercept - float(self.mean @ w)), lambda acc, v: acc + v)


def fit_ridge(train: DataFrame, x: str, y: str, alpha: float = 10.0) -> Ridge:
    """Standardise and solve (X'X + alpha I) w = X'y from one distributed Gram matrix."""
    stats = train.select(F.posexplode(F.concat(x, F.array(F.col(y).cast("double")))).alias("j", "v")).groupBy("j").agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("j").collect()  # p + 1 rows
    mean = np.array([r["m"] for r in stats])
    scale = np.array([r["s"] if r["s"] and r["s"] > 1e-12 else 1.0 for r in stats])
    centred = F.zip_with(F.concat(x, F.array(F.col(y).cast("double"))), F.array(*[F.lit(float(v)) for v in mean]), lambda a, c: a - c)
    scaled = F.zip_with(centred, F.array(*[F.lit(float(v)) for v in [*scale[:-1], 1.0]]), lambda a, c: a / c)
    w = gram.ridge(gram.fit_moments(train, scaled), alpha)
    return Ridge(mean[:-1], scale[:-1], w, float(mean[-1]))


@dataclass(frozen=True)
class Forest:
    """Mean of several forests, weighted by their trees: the forest of all of them."""

    models: tuple[RandomForestRegressionModel, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        cur, total = df, sum(m.getNumTrees for m in self.models)
        for i, m in enumerate(self.models):
            cur = m.copy().setPredictionCol(f"_t{i}").transform(cur)
        mean = reduce(lambda a, c: a + c, [F.col(f"_t{i}") * F.lit(m.getNumTrees / total) for i, m in enumerate(self.models)])
        return cur.withColumn("prediction", mean).drop(*[f"_t{i}" for i in range(len(self.models))])


def fit_forest_regressor(
    train: DataFrame, y: str, x: str = "x", trees: int = 300, seed: int = 7, depth: int = MAX_DEPTH, leaf: int = 2, batch: int = 75, workers: int = 4
) -> Forest | binned.BinnedForest:
    """`trees` trees over 32 bins of each feature.

    With few features, each tree grows in a task of its own from sums for each cell of bins (`binned`).  With more, MLlib grows `batch` at a time
    in parallel jobs: the node of every row is kept beside it, without that each level would send all trees grown so far to all tasks.  A level's
    statistics are added up in groups of nodes that fit a fixed memory, so they do not grow with the number of trees.
    """
    bins = binned.fit_bins(train, x)
    if bins:
        return binned.fit_forest(train, bins, x, y, trees, seed, depth, leaf, 0.7)
    rows = train.select(array_to_vector(F.col(x)).alias(FEATURES), F.col(y).cast("double").alias(y)).persist()
    sizes = [min(batch, trees - at) for at in range(0, trees, batch)]

    def grow(i: int) -> RandomForestRegressionModel:
        rf = RandomForestRegressor(
            featuresCol=FEATURES, labelCol=y, numTrees=sizes[i], minInstancesPerNode=leaf, featureSubsetStrategy="0.7", seed=seed + i, maxDepth=depth, cacheNodeIds=True, maxMemoryInMB=1024)
        return rf.fit(rows)

    with ThreadPoolExecutor(workers) as pool:
        models = tuple(pool.map(grow, range(len(sizes))))
    rows.unpersist()
    return Forest(models)


def fit_boosted_regressor(train: DataFrame, y: str, x: str = "x", iterations: int = 200, seed: int = 7) -> PipelineModel | binned.BinnedModel:
    """Squared loss; MLlib has no Huber loss for trees.

    With few features, every cell of bins enters with its mean, weighted by its rows.  Splits and leaves are those of the rows, since no tree parts
    a cell and its inner spread is the same on both sides of any split.
    """
    gbt = GBTRegressor(featuresCol=FEATURES, labelCol=y, maxIter=iterations, stepSize=0.03, maxDepth=2, lossType="squared", seed=seed, cacheNodeIds=True)
    least = 3  # rows of a leaf
    bins = binned.fit_bins(train, x)
    if not bins:
        return Pipeline(stages=[gbt.setMinInstancesPerNode(least)]).fit(train.withColumn(FEATURES, array_to_vector(F.col(x))))
    cells = cut_lineage(binned.cell_means(train, bins, x, y))
    count = cells.agg(F.sum("n")).first()[0]
    rows = _packed(cells.select(array_to_vector("_bins").alias(FEATURES), "n", y))
    share = min((least - 0.5) / count, 0.499)
    model = Pipeline(stages=[gbt.setWeightCol("n").setMinInstancesPerNode(1).setMinWeightFractionPerNode(share)]).fit(rows)
    rows.unpersist()
    return binned.BinnedModel(bins, model)


def regress(model: PipelineModel | Forest | binned.BinnedForest | binned.BinnedModel, df: DataFrame, x: str = "x", out: str = "estimate") -> DataFrame:
    keep = df.columns
    return model.transform(df.withColumn(FEATURES, array_to_vector(F.col(x)))).select(*keep, F.col("prediction").alias(out))


# ---------------------------------------------------------------- imputation, centroids


def long_cells(df: DataFrame, keep: Sequence[str], x: str = "x") -> DataFrame:
    return df.select(*keep, F.posexplode_outer(x).alias("j", "v")).withColumn("v", F.when(is_finite(F.col("v")), F.col("v")))


def fit_medians(train: DataFrame, x: str = "x") -> list[float]:
    """Train-only median per feature position; p numbers."""
    cells = long_cells(train, [], x)
    rows = {r["j"]: r["m"] for r in medians(cells, ["j"], "v", "m").collect()}
    size = train.agg(F.max(F.size(x))).first()[0]
    return [rows.get(j, 0.0) for j in range(size)]


def impute(x: str | Column, fill: Sequence[float]) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.zip_with(c, F.array(*[F.lit(float(v)) for v in fill]), lambda a, m: F.when(a.isNotNull() & ~F.isnan(a), a).otherwise(m))


@dataclass(frozen=True)
class Centroids:
    fill: list[float]
    mean: list[float]
    spread: list[float]
    centers: dict

    def distances(self, x: str) -> dict:
        lit = lambda vs: F.array(*[F.lit(float(v)) for v in vs])
        z = F.zip_with(F.zip_with(impute(x, self.fill), lit(self.mean), lambda a, m: a - m), lit(self.spread), lambda a, s: a / s)
        p = len(self.fill)
        return {
            c: F.aggregate(F.zip_with(z, lit(v), lambda a, m: (a - m) * (a - m)), F.lit(0.0), lambda acc, e: acc + e) / p
            for c, v in self.centers.items()
        }

    def predict(self, df: DataFrame, x: str = "x", guess: str = "y_pred") -> DataFrame:
        """Nearest centroid by mean squared distance, ties to the smallest label; narrow."""
        arr = F.array(*[F.struct(d.alias("d"), F.lit(c).alias("c")) for c, d in self.distances(x).items()])
        return df.withColumn("_best", F.array_min(arr)).select("*", F.col("_best.c").alias(guess), F.col("_best.d").alias("distance")).drop("_best")


def fit_centroids(train: DataFrame, label: str, x: str = "x") -> Centroids:
    """Train-only median fill, z-score and class centres: p x (3 + classes) numbers."""
    fill = fit_medians(train, x)
    cells = train.select(F.col(label).alias("_c"), F.posexplode(impute(x, fill)).alias("j", "v"))
    stats = {r["j"]: r for r in cells.groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}
    mean = [stats[j]["m"] for j in range(len(fill))]
    spread = [stats[j]["s"] if stats[j]["s"] >= 1e-9 else 1.0 for j in range(len(fill))]
    centers: dict = {}
    for r in cells.groupBy("_c", "j").agg(F.avg("v").alias("m")).collect():
        centers.setdefault(r["_c"], [0.0] * len(fill))[r["j"]] = (r["m"] - mean[r["j"]]) / spread[r["j"]]
    return Centroids(fill, mean, spread, dict(sorted(centers.items())))


# ---------------------------------------------------------------- calibration


@dataclass(frozen=True)
class Platt:
    labels: tuple
    slope: tuple[float, ...]
    offset: tuple[float, ...]

    def apply(self, probs: Column) -> Column:
        raw = F.array(*[
            1 / (1 + F.exp(-(F.lit(a) * F.element_at(probs, i + 1) + F.lit(o)))) for i, (a, o) in enumerate(zip(self.slope, self.offset))
        ])
        total = F.aggregate(raw, F.lit(0.0), lambda acc, v: acc + v)
        return F.transform(raw, lambda p: p / total)


def fit_platt(calibration: DataFrame, label: str, labels: Sequence, probs: str = "probs") -> Platt:
    """One sigmoid per class on held-out scores, with Platt's smoothed targets as weighted row pairs."""
    rows = calibration.persist()
    slope, offset = [], []
    for i, c in enumerate(labels):
        n = rows.agg(F.count_if(F.col(label) == c).alias("p"), F.count_if(F.col(label) != c).alias("q")).first()
        hi, lo = (n["p"] + 1.0) / (n["p"] + 2.0), 1.0 / (n["q"] + 2.0)
        target = F.when(F.col(label) == c, hi).otherwise(lo)
        pairs = rows.select(
            array_to_vector(F.array(F.element_at(probs, i + 1))).alias("f"),
            F.explode(F.array(F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - target).alias("w")))).alias("_t"),
        ).select("f", "_t.y", "_t.w")
        m = LogisticRegression(featuresCol="f", labelCol="y", weightCol="w", regParam=0.0, maxIter=100).fit(pairs)
        slope.append(float(m.coefficients[0]))
        offset.append(float(m.intercept))
    rows.unpersist()
    return Platt(tuple(labels), tuple(slope), tuple(offset))


# ---------------------------------------------------------------- feature groups, grids, hierarchies


def input_groups(features: Sequence[str], leakage: DataFrame, initial: DataFrame, feature: str = "feature") -> dict[str, list[str]]:
    """A all, B without leakage-flagged, C without initial-condition-flagged features (names on the driver)."""
    leak = {r[0] for r in leakage.where("potential_label_leakage").select(feature).distinct().collect()}
    ini = {r[0] for r in initial.where("initial_condition_flag").select(feature).distinct().collect()}
    return {
        "A": list(features), "B": [f for f in features if f not in leak], "C": [f for f in features if f not in leak and f not in ini],
    }


def screen_features(
    cells: DataFrame, severity: str, label: str, value: str = "v", variable: str = "variable", statistic: str = "statistic",
    limit: float = 0.7, keep: int = 4,
) -> DataFrame:
    """Drop variables that follow severity but separate classes no better than the median variable.

    If fewer than `keep` would remain, the `keep` strongest class signals stay instead.
    """
    k = [variable, statistic]
    dep = agg.spearman_abs(cells, k, value, severity)
    sig = agg.between_class_share(cells, k, label, value)
    per = attach(dep, sig, k).groupBy(variable).agg(F.max("spearman_abs").alias("dependency"), F.max("between_share").alias("class_signal"))
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(1))  # one row per variable
    rule = (F.col("dependency") >= limit) & (F.col("class_signal") <= F.col("signal_median"))
    out = per.withColumn("signal_median", F.median("class_signal").over(w)).withColumn("_rule", rule)
    out = out.withColumn("_left", F.sum((~F.col("_rule")).cast("int")).over(w)).withColumn(
        "_pos", F.row_number().over(w.orderBy(F.col("class_signal").desc(), variable)))
    removed = F.when(F.col("_left") >= keep, F.col("_rule")).otherwise(F.col("_pos") > keep)
    return out.withColumn("removed", removed).drop("_rule", "_left", "_pos")


Fit = Callable[[DataFrame], Classifier]


def evaluate_grid(rows: DataFrame, splits: Sequence[str], models: Mapping[str, Fit], keep: Sequence[str], workers: int = 4) -> DataFrame:
    """Fit every (split, model) cell on its train rows and predict validation and test rows.

    `rows` holds split_id, partition and x. Cells are independent jobs, submitted from a
    small thread pool; the result is one long prediction table.
    """
    cells = [(s, m) for s in splits for m in models]
    rows = cut_lineage(rows)  # every fit reads its rows many times

    def run(cell: tuple[str, str]) -> DataFrame:
        s, m = cell
        part = rows.where(F.col("split_id") == s)
        fitted = models[m](part.where("partition = 'train'"))
        held = part.where(F.col("partition").isin("validation", "test"))
        out = fitted.predict(held).withColumn("model", F.lit(m)).select("split_id", "partition", "model", *keep, "y_pred", "probs")
        out = cut_lineage(out)  # a plan of all cells would carry all their models to every task
        if isinstance(fitted, GrownForest):
            fitted.release()
        return out

    with ThreadPoolExecutor(workers) as pool:
        return reduce(lambda a, c: a.unionByName(c), list(pool.map(run, cells)))


@dataclass(frozen=True)
class Constant:
    """One answer for every row."""

    answer: object

    def predict(self, df: DataFrame, x: str = "x", guess: str = "y_pred") -> DataFrame:
        return df.withColumn(guess, F.lit(self.answer))


def fit_heaviest_class(train: DataFrame, label: str, weight: str = "weight") -> Constant:
    """The class with the largest sum of weights (to nine digits), ties to the smallest label."""
    per = train.groupBy(label).agg(F.round(F.sum(weight), 9).alias("w")).orderBy(F.desc("w"), label)
    return Constant(per.first()[label])


MODES = ("unweighted", "class_balanced")


def evaluation_grid(
    features: DataFrame, assignments: DataFrame, models: Mapping[str, Callable[[DataFrame], object]], label: str, modes: Sequence[str] = MODES,
    axes: Sequence[str] = ("window_s", "input_group"), id: str = "sample_id", workers: int = 4,
) -> DataFrame:
    """Predictions of every cell split x axes x mode x model for its validation and test rows, as one long table.

    `features` has one row for each id and value of the axes, with x and the label; `assignments` gives each id its partition in
    each split.  Both are joined and staged once; every cell reads its rows from there.  Cells are independent
    jobs from a small thread pool.  A model is fitted on train rows that carry `weight` (1, or N / (K n_c) in the balanced mode) and has
    `predict`.  The grid's cells are named on the driver, no row is.
    """
    rows = cut_lineage(features.join(assignments.select(id, "split_id", "partition"), id))
    if rows.groupBy(id, "split_id", *axes).count().where("count > 1").head(1):
        raise ValueError("more than one row for an id in a cell")
    cells = [(tuple(c), mode, name) for c in rows.select("split_id", *axes).distinct().collect() for mode in modes for name in models]

    def run(cell) -> DataFrame:
        where, mode, name = cell
        part = rows
        for column, value in zip(("split_id", *axes), where, strict=True):
            part = part.where(F.col(column) == value)
        train = part.where("partition = 'train'")
        train = agg.balanced_weights(train, label) if mode == "class_balanced" else train.withColumn("weight", F.lit(1.0))
        held = models[name](train).predict(part.where(F.col("partition").isin("validation", "test")))
        return held.select("split_id", *axes, F.lit(mode).alias("mode"), F.lit(name).alias("model"), "partition", id, label, "y_pred")

    with ThreadPoolExecutor(workers) as pool:
        return reduce(lambda a, c: a.unionByName(c), list(pool.map(run, cells)))


def fit_two_stage(train: DataFrame, family: str, label: str, fit: Callable[[DataFrame, str, Sequence], Classifier], min_rows: int = 20, min_class: int = 5):
    """Family model plus one subtype model per family with enough data; otherwise the family's majority class."""
    counts = train.groupBy(family, label).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per class
    fams: dict = {}
    for r in counts:
        fams.setdefault(r[family], {})[r[label]] = r["n"]
    top = fit(train, family, sorted(fams))
    subs: dict = {}
    for f, c in sorted(fams.items()):
        if len(c) > 1 and sum(c.values()) >= min_rows and min(c.values()) >= min_class:
            subs[f] = fit(train.where(F.col(family) == f), label, sorted(c))
        else:
            subs[f] = min(c, key=lambda v: (-c[v], v))
    return top, subs


def predict_two_stage(df: DataFrame, top: Classifier, subs: Mapping, x: str = "x") -> DataFrame:
    """Rows are routed by predicted family; each branch scores only its own rows."""
    routed = top.predict(df, x, "family_probs", "family_pred")
    parts = []
    for f, sub in subs.items():
        mine = routed.where(F.col("family_pred") == f)
        if isinstance(sub, Classifier):
            parts.append(sub.predict(mine, x, "_p", "y_pred").drop("_p").withColumn("subtype_status", F.lit("model")))
        else:
            parts.append(mine.withColumn("y_pred", F.lit(sub)).withColumn("subtype_status", F.lit("fallback_majority")))
    return reduce(lambda a, c: a.unionByName(c), parts)


def gated_label(probs: Column, labels: Sequence, threshold: float = 0.6, unknown: str = "Unknown") -> Column:
    """Label of the largest probability, Unknown below the threshold."""
    return F.when(F.array_max(probs) >= threshold, argmax_label(probs, labels).cast("string")).otherwise(unknown)


def importance_table(spark, model: Classifier | GrownForest | PipelineModel, names: Sequence[str], top: int = 20) -> DataFrame:
    """Impurity importance or mean |coefficient| per feature, largest first."""
    if isinstance(model, GrownForest):
        return _largest(spark, names, model.forest.importances(), top)
    parts = [m.stages[-1] for m in (model.models if isinstance(model, Classifier) and model.votes else model.models[:1] if isinstance(model, Classifier) else [model])]
    last = parts[0]
    if hasattr(last, "featureImportances"):
        votes = getattr(model, "votes", ()) or (1,)
        values = sum(p.featureImportances.toArray() * v for p, v in zip(parts, votes, strict=True)) / sum(votes)
    else:
        values = np.abs(last.coefficientMatrix.toArray()).mean(axis=0)
    return _largest(spark, names, values, top)


def _largest(spark, names: Sequence[str], values: np.ndarray, top: int) -> DataFrame:
    order = sorted(range(len(names)), key=lambda i: (-values[i], names[i]))[:top]
    return spark.createDataFrame([(r + 1, names[i], float(values[i])) for r, i in enumerate(order)], "rank long, feature string, importance double")


def save_bundle(model: Classifier, params: DataFrame, path: str) -> None:
    """Models and parameter table below one folder."""
    for i, m in enumerate(model.models):
        m.write().overwrite().save(f"{path}/model_{i}")
    params.coalesce(1).write.mode("overwrite").json(f"{path}/params")  # a few parameter rows


def load_bundle(path: str, labels: Sequence, count: int = 1, votes: Sequence[int] = ()) -> Classifier:
    return Classifier(tuple(labels), tuple(PipelineModel.load(f"{path}/model_{i}") for i in range(count)), tuple(votes))
