"""Fixtures for the findings of round 4."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import learn, trees


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("width", [6, 400])  # sums of all classes, rows sorted by bin
def test_splits_of_a_level_as_brute_force(monkeypatch, weighted, width):
    monkeypatch.setattr(trees, "SLOTS", 5 * width)  # two parts
    rng = np.random.default_rng(5)
    rows, k, classes, leaf = 240, 8, 3, 2
    x, y, node = rng.integers(0, 6, (rows, 5)).astype(np.uint8), rng.integers(0, classes, rows), np.r_[np.arange(k), rng.integers(0, k, rows - k)]
    order = np.lexsort((y, node))
    y, node, n = y[order], node[order], rng.integers(1, 4, rows).astype(float)
    w = n * rng.random(rows) if weighted else n
    total, chosen = np.bincount(node * classes + y, w, k * classes).reshape(k, classes), trees._chosen(k, 5, 3, rng)
    best, feature, cut = trees._in_parts(x, np.arange(rows), node, y, n, w, total, np.bincount(node, n), chosen, width, leaf)
    for v in range(k):
        mine, found = node == v, {}
        for j in chosen[v]:
            for c in range(5):
                sides = [mine & (x[:, j] <= c), mine & (x[:, j] > c)]
                if all(n[s].sum() >= leaf for s in sides):
                    found[j, c] = sum((np.bincount(y[s], w[s], classes) ** 2).sum() / w[s].sum() for s in sides)
        assert best[v] == pytest.approx(max(found.values())) == found[feature[v], cut[v]]


def _points(spark, rows=900):
    """Three classes over values in steps, so that thresholds are exact; one feature says nothing, one is constant."""
    rng = np.random.default_rng(6)
    data = [(i, int(i % 3), [*np.round(rng.normal(i % 3 * 1.5, 1, 2) * 2).clip(-9, 9).tolist(), float(rng.integers(0, 9)), 1.0], float(1 + i % 2)) for i in range(rows)]
    return spark.createDataFrame(data, "sample_id long, label int, x array<double>, w double")


def _by_hand(model, x):
    """Mean shares of the leaves that a row's values reach, tree by tree."""
    out = np.zeros(model.forest.classes)
    for r in model.forest.trees.collect():
        feature, cut, sizes = np.frombuffer(r["feature"], np.int16), np.frombuffer(r["cut"], np.uint8), np.frombuffer(r["sizes"], np.uint16)
        v = 0
        while feature[v] >= 0:
            left = 2 * (feature[: v + 1] >= 0).sum() - 1
            v = left + int(x[feature[v]] > model.forest.edges[feature[v]][cut[v]])
        leaf = (feature[:v] < 0).sum()
        part = slice(sizes[:leaf].sum(), sizes[: leaf + 1].sum())
        out[np.frombuffer(r["classes"], np.uint16)[part]] += np.frombuffer(r["shares"], np.float32)[part]
    return out / model.forest.count


@pytest.mark.parametrize("weight", [None, "w"])
def test_forest_grown_in_tasks_is_a_forest(spark, monkeypatch, weight):
    """No model reaches the driver; rows get the mean of their leaves, a label without a train row keeps its place, and MLlib's forest says the same."""
    df = _points(spark)
    train, held = df.where("sample_id % 4 > 0").persist(), df.where("sample_id % 4 = 0")
    fit = lambda: learn.fit_forest(train, "label", [7, 0, 1, 2], trees=30, weight=weight)
    reports = {}
    for name, bounds in (("grown", (0, 1 << 27)), ("mllib", learn.GROWN)):
        monkeypatch.setattr(learn, "GROWN", bounds)
        model = fit()
        reports[name] = model.predict(held).orderBy("sample_id").collect()
        if name == "grown":
            assert isinstance(model, learn.GrownForest) and model.forest.trees.count() == 30 and model.forest.edges[3] == ()
            assert [e[0] for e in model.forest.edges[:3]] == [train.agg(F.min(F.get("x", F.lit(j)))).first()[0] for j in range(3)]
            for r in reports[name][:25]:
                assert r["probs"] == pytest.approx(_by_hand(model, r["x"]).tolist()) and r["probs"][0] == 0
    assert len(reports["grown"]) == 225
    right = {k: sum(r["label"] == r["y_pred"] for r in v) for k, v in reports.items()}
    assert abs(right["grown"] - right["mllib"]) <= 12 and right["grown"] > 160
    far = [abs(a["probs"][a["label"] + 1] - c["probs"][c["label"] + 1]) for a, c in zip(reports["grown"], reports["mllib"], strict=True)]
    assert np.mean(far) < 0.08


def test_trees_do_not_depend_on_the_order_of_rows(spark, monkeypatch):
    """What an executor loses is grown again from rows in another order; many blocks, and several parts to score."""
    for name, value in (("BLOCK", 16), ("CHUNK", 400), ("TASKS", 3)):
        monkeypatch.setattr(trees, name, value)
    monkeypatch.setattr(learn, "GROWN", (0, 1 << 27))
    df = _points(spark, 400)
    got = []
    for train in (df.repartition(1), df.orderBy(F.desc("sample_id")).repartition(5)):
        out = learn.fit_forest(train, "label", [0, 1, 2], trees=7).predict(df).orderBy("sample_id").collect()
        got.append([(r["sample_id"], r["probs"], r["y_pred"]) for r in out])
    assert got[0] == got[1] and len(got[0]) == 400


@pytest.mark.parametrize("x, label", [([1.0], 0), ([1.0, None, 2.0, 3.0], 0), (None, 0), ([1.0, 2.0, 3.0, 4.0], None), ([1.0, 2.0, 3.0, 4.0], 9)])
def test_rows_that_do_not_fit_a_forest_fail(spark, monkeypatch, x, label):
    monkeypatch.setattr(learn, "GROWN", (0, 1 << 27))
    odd = spark.createDataFrame([(-1, label, x, 1.0)], "sample_id long, label int, x array<double>, w double")
    with pytest.raises(Exception, match="a row has|a feature is null"):
        learn.fit_forest(_points(spark, 60).unionByName(odd), "label", [0, 1, 2], trees=2)


def test_importances_of_a_forest_grown_in_tasks(spark, monkeypatch):
    """Shares of the falls of impurity, the mean over the trees; near those of MLlib's forest, nothing for a constant."""
    df = _points(spark).persist()
    tables = []
    for bounds in ((0, 1 << 27), learn.GROWN):
        monkeypatch.setattr(learn, "GROWN", bounds)
        model = learn.fit_forest(df, "label", [0, 1, 2], trees=30)
        assert isinstance(model, learn.GrownForest) == (bounds[0] == 0)
        tables.append(learn.importance_table(spark, model, list("abcd")).collect())
        if isinstance(model, learn.GrownForest):
            per = np.array([r["importance"] for r in model.forest.trees.collect()])
            assert per.shape == (30, 4) and per.sum(1) == pytest.approx(np.ones(30)) and per[:, 3].max() == 0
            assert {r["feature"]: r["importance"] for r in tables[0]} == pytest.approx(dict(zip("abcd", per.mean(0), strict=True)))
            assert [r["feature"] for r in learn.importance_table(spark, model, list("abcd"), 2).collect()] == [r["feature"] for r in tables[0][:2]]
    mine, other = ({r["feature"]: r["importance"] for r in t} for t in tables)
    assert {tables[0][0]["feature"], tables[0][1]["feature"]} == {"a", "b"} and mine == pytest.approx(other, abs=0.08)


def test_grid_grows_each_forest_once(spark, monkeypatch, tmp_path):
    """Beside other fits that cache the same rows, every tree is grown once; nothing stays cached, and every held row has one answer of each model."""
    monkeypatch.setattr(learn, "GROWN", (0, 1 << 27))
    monkeypatch.setattr(trees, "TASKS", 3)
    made, folder = trees._grower, str(tmp_path)

    def noted(*args):
        run = made(*args)

        def again(key, table):
            import tempfile

            tempfile.mkstemp(dir=folder)
            return run(key, table)

        return again

    monkeypatch.setattr(trees, "_grower", noted)
    seeds = spark.createDataFrame([("s0",), ("s1",)], "split_id string")
    rows = _points(spark, 300).crossJoin(seeds).withColumn("partition", F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))), F.col("sample_id").cast("int") % 5 % 3 + 1))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    fits = {"logistic": lambda t: learn.fit_logistic(t, "label", [0, 1, 2], iterations=5), "forest": lambda t: learn.fit_forest(t, "label", [0, 1, 2], trees=8)}
    out = learn.evaluate_grid(rows, ["s0", "s1"], fits, ["sample_id", "label"])
    assert len(list(tmp_path.iterdir())) == 2 * 3 and spark.sparkContext._jsc.getPersistentRDDs().size() == before
    held = rows.where("partition <> 'train'").count()
    counts = {(r["split_id"], r["model"]): (r["n"], r["ids"]) for r in out.groupBy("split_id", "model").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("ids")).collect()}
    assert counts == {(s, m): (held // 2, held // 2) for s in ("s0", "s1") for m in fits}
    right = {r["model"]: r["right"] for r in out.groupBy("model").agg(F.avg((F.col("y_pred") == F.col("label")).cast("int")).alias("right")).collect()}
    assert min(right.values()) > 0.6
    forest = out.where("model = 'forest'")
    pairs = forest.groupBy("sample_id").agg(F.count_distinct("y_pred", "probs").alias("n")).agg(F.max("n")).first()[0]
    assert pairs == 1  # the same rows in both splits give the same forest
