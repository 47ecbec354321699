"""Threshold pairs, direction tables, the evaluation grid and stability under a perturbation, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import directional, explain, learn, metrics


def _f1(rows, labels):
    out = []
    for c in labels:
        tp, s, p = (sum(1 for t, g in rows if f(t, g)) for f in (lambda t, g: t == c == g, lambda t, g: t == c, lambda t, g: g == c))
        out.append(2 * tp / (s + p) if s + p else 0.0)
    return float(np.mean(out))


def test_thresholds_come_from_validation_only(spark):
    rng = random.Random(1)
    make = lambda n, shift: [(rng.choice("ab"), rng.choice("ab"), round(rng.random() + shift, 3), None if i % 19 == 0 else round(rng.random(), 3)) for i in range(n)]
    val, test = make(60, 0.0), make(45, 0.2)
    df = lambda rows: spark.createDataFrame(rows, "y_true string, y_pred string, good double, bad double")
    targets = [0.5, 0.8, 0.9]
    got = metrics.fitted_combination(df(val), df(test), ["a", "b"], "good", "bad", targets, 0.6).collect()
    assert len(got) == 18 and sum(r.chosen for r in got) == 2
    goods, bads = sorted(r[2] for r in val), sorted(r[3] for r in val if r[3] is not None)
    lower = [goods[int(np.floor(round((1 - t) * (len(goods) - 1), 9)))] for t in targets]
    upper = [bads[int(np.ceil(round(t * (len(bads) - 1), 9)))] for t in targets]
    ranks = []
    for i, g in enumerate(lower):
        for j, h in enumerate(upper):
            for name, rows in (("validation", val), ("test", test)):
                taken = [(t, p) for t, p, a, b in rows if a >= g and b is not None and b <= h]
                r = next(x for x in got if (x.partition, x.good_target, x.bad_target) == (name, targets[i], targets[j]))
                assert (r.good_threshold, r.bad_threshold, r.n_accepted, r.n_total) == (g, h, len(taken), len(rows))
                if taken:
                    assert np.isclose(r.selective_macro_f1, _f1(taken, "ab")) and np.isclose(r.selective_accuracy, np.mean([t == p for t, p in taken]))
                if name == "validation":
                    ranks.append((round(abs(len(taken) / len(rows) - 0.6), 12), -round(r.selective_macro_f1, 12), -round(r.selective_accuracy, 12), i, j))
    best = sorted(ranks)[0]
    assert all((r.good_target, r.bad_target) == (targets[best[3]], targets[best[4]]) and r.position == 1 for r in got if r.chosen)


def test_recall_by_gap_and_summary(spark):
    rows = []
    for part in (0, 1):
        for i in range(30):
            c = "ab"[i % 2]
            rows.append((f"{part}-{i}", part, "up", c, float(i * i % 37), "train" if i % 3 else "test", c if (i + part) % 5 else "b"))
    rows += [("x", 0, "up", "c", 3.0, "test", "c"), ("y", 1, "up", "c", 3.0, "train", "c")]
    df = spark.createDataFrame(rows, "sample_id string, part int, direction string, class string, severity double, partition string, y_pred string")
    got = {(r.part, r.bin): r for r in directional.recall_by_gap(df, [0, 1, 4], ["direction", "part"]).collect()}
    want = Counter()
    for s, part, _, c, v, p, g in rows:
        if p == "test":
            near = [abs(v - x[4]) for x in rows if x[1] == part and x[3] == c and x[5] == "train"]
            b = -1 if not near else sum(e <= min(near) for e in (0, 1, 4)) - 1
            want[(part, b)] += 1
            want[(part, b, "hit")] += c == g
    assert len(got) == 8 and got[(0, -1)].n == 1 and got[(0, 2)].gap_to is None
    for (part, b), r in got.items():
        assert (r.n, r.hits) == (want[(part, b)], want[(part, b, "hit")]) and (r.recall is None) == (r.n == 0)
    errors = directional.directional_errors(df, ["a", "b", "c", "d"], ["direction", "part"]).persist()
    out = {r.label: r for r in directional.direction_summary(errors).collect()}
    per = {(r.part, r.label): r for r in errors.collect()}
    assert out["a"].n_splits == 2 and np.isclose(out["a"].recall_mean, np.mean([per[(p, "a")].recall for p in (0, 1)]))
    assert np.isclose(out["a"].recall_std, np.std([per[(p, "a")].recall for p in (0, 1)], ddof=1)) and out["a"].main_confusion_target == "b"
    assert (out["c"].n_splits, out["c"].recall_std, out["c"].main_confusion_target) == (1, 0.0, None) and (out["d"].n_splits, out["d"].recall_mean) == (0, None)


class _Near:
    def __init__(self, train, seen):
        seen.append(sorted((r.sample_id, round(r.weight, 6)) for r in train.collect()))
        self.mid = train.agg(F.avg(F.get("x", F.lit(0)))).first()[0]

    def predict(self, df):
        return df.withColumn("y_pred", F.when(F.get("x", F.lit(0)) > self.mid, "b").otherwise("a"))


def test_grid_fits_every_cell_on_its_train_rows(spark):
    rows = [(i, w, g, [float(i * (1 if g == "A" else -1)) + w], "ab"[i >= 4]) for i in range(12) for w in (6, 12) for g in "AB"]
    features = spark.createDataFrame(rows, "sample_id long, window_s int, input_group string, x array<double>, class string")
    part = lambda i, k: ("test", "validation", "train", "train")[(i + k) % 4]
    assigned = spark.createDataFrame([(i, f"s{k}", part(i, k)) for i in range(12) for k in range(2)], "sample_id long, split_id string, partition string")
    seen = []
    pred = learn.evaluation_grid(features, assigned, {"near": lambda t: _Near(t, seen), "top": lambda t: learn.fit_heaviest_class(t, "class")}, "class", workers=1).persist()
    assert pred.count() == 2 * 2 * 2 * 2 * 2 * 6 and pred.select("split_id", "window_s", "input_group", "mode", "model").distinct().count() == 32
    assert pred.where("partition = 'train'").count() == 0 and len(seen) == 16
    for s in seen:
        ids = [i for i, _ in s]
        assert ids in ([i for i in range(12) if part(i, k) == "train"] for k in range(2))
        n = Counter("ab"[i >= 4] for i in ids)
        weights = {round(w, 6) for _, w in s}
        assert weights == {1.0} or weights == {round(len(ids) / (2 * c), 6) for c in n.values()}
    top = {r["mode"]: r.y for r in pred.where("model = 'top'").groupBy("mode").agg(F.concat_ws(",", F.collect_set("y_pred")).alias("y")).collect()}
    assert top == {"unweighted": "b", "class_balanced": "a"}  # balanced weights tie, the smallest label wins
    per = metrics.classification(pred, ["split_id", "window_s", "input_group", "mode", "model", "partition"], ["a", "b"], "class")
    chosen = metrics.select_setting(per, ["split_id", "window_s"], ["input_group", "mode", "model"]).collect()
    table = {(r.split_id, r.window_s, r.input_group, r["mode"], r.model, r.partition): r for r in per.collect()}
    for r in chosen:
        mine = [k for k in table if k[:2] == (r.split_id, r.window_s) and k[5] == "validation"]
        best = min(mine, key=lambda k: (-round(table[k].macro_f1_fixed, 9), -round(table[k].accuracy, 9), k[2:5]))
        assert best[2:5] == (r.input_group, r["mode"], r.model) and r.candidates == 8
        assert r.test_accuracy == table[(*best[:5], "test")].accuracy and r.validation_macro_f1_fixed == table[best].macro_f1_fixed
    with pytest.raises(ValueError):
        learn.evaluation_grid(features.unionByName(features), assigned, {}, "class")


def test_stability_decides_the_moved_series_again(spark):
    raw = spark.createDataFrame([(i, float(t), float(i), 1.0) for i in range(4) for t in range(4)], "sample_id long, t double, p double, q double")
    scales = spark.createDataFrame([(10.0, 0.0)], "p_scale double, q_scale double")
    calls = []

    def run(df):
        calls.append(sorted(df.groupBy("sample_id").agg(F.sum("p").alias("s")).collect()))
        m = df.groupBy("sample_id").agg(F.avg("p").alias("p"), F.avg("q").alias("q"))
        cells = m.unpivot(["sample_id"], ["p", "q"], "feature", "contribution")
        return m.select("sample_id", F.when(F.col("p") > 2.5, "high").otherwise("low").alias("status"), F.col("p").alias("score")), cells

    got = {r.sample_id: r for r in explain.perturbation_stability(raw, scales, ["p", "q"], 0.5, run, ["sample_id"], 0.1, k=1).collect()}
    assert [r.s for r in calls[1]] == [i * 4 + 3.0 for i in range(4)]  # rows before the injection stay
    assert {i: (r.status, r.perturbed_status, r.status_changed) for i, r in got.items()} == {
        0: ("low", "low", False), 1: ("low", "low", False), 2: ("low", "high", True), 3: ("high", "high", False)}
    assert all(np.isclose(r.score_change, 0.75) for r in got.values())
    assert got[0].jaccard == 0.0 or got[0].common == 1
    assert [got[i].jaccard for i in (2, 3)] == [1.0, 1.0]
