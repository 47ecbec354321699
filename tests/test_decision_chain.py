"""Calibrators across folds, the sealed bundle, the gated second model and the distance explanation."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import bundle, calibrate, decide, explain, learn

LABELS = ["u", "v", "w"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 150)
    x = rng.normal(size=(150, 4)) @ (np.eye(4) + 0.3) + y[:, None] * np.array([1.5, -1.0, 0.0, 0.5])
    rows = [(i, v.tolist(), LABELS[c], float(3 * v[0] - v[1] + 0.01 * i % 1)) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "sample_id long, x array<double>, c string, size double").repartition(3).persist()


def _fit(rows):
    return learn.fit_logistic(rows, "c", LABELS)


def _sigmoid(p, hit):
    """The same sigmoid by plain gradient steps with numpy."""
    n1, n0 = hit.sum(), (~hit).sum()
    t = np.where(hit, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    x = np.c_[p, np.ones(len(p))]
    for _ in range(200):
        s = 1 / (1 + np.exp(-x @ a))
        a -= np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (s - t))
    return a


def test_sigmoids_are_the_smoothed_fit(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(2):
        for i in range(120):
            p = rng.dirichlet([1 + g, 1, 2])
            rows.append((g, LABELS[int(rng.choice(3, p=(p + 0.2) / 1.6))], p.tolist()))
    rows += [(0, "u", [0.2, 0.3, 0.5])]
    got = calibrate.fit_sigmoids(spark.createDataFrame(rows, "g int, c string, probs array<double>"), "g", 2, "c", LABELS)
    for g in range(2):
        for k, c in enumerate(LABELS):
            mine = [(r[2][k], r[1] == c) for r in rows if r[0] == g]
            want = _sigmoid(np.array([p for p, _ in mine]), np.array([h for _, h in mine]))
            assert np.allclose([got[g].slope[k], got[g].offset[k]], want, atol=1e-6)


def test_every_fold_is_scored_by_a_model_that_has_not_seen_it(points):
    seen = []

    def fit(rows):
        seen.append({r[0] for r in rows.select("sample_id").collect()})
        return _fit(rows)

    model = calibrate.fit_calibrated(points, "c", LABELS, fit, workers=1)
    every = {r[0] for r in points.select("sample_id").collect()}
    assert model.folds == 3 and model.status == "train_only_sigmoid_cv" and len(model.members) == 3
    held = [every - s for s in seen]
    assert set.union(*held) == every and sum(map(len, held)) == len(every)
    per = points.groupBy("c").count().collect()
    for h in held:
        got = points.where(F.col("sample_id").isin(list(h))).groupBy("c").count().collect()
        assert all(abs(a["count"] - b["count"] / 3) < 1 for a in got for b in per if a["c"] == b["c"])
    out = model.predict(points).collect()
    assert all(abs(sum(r.probs) - 1) < 1e-9 for r in out) and np.mean([r.y_pred == r.c for r in out]) > 0.7


@pytest.mark.parametrize("most,folds,status", [(2, 2, "train_only_sigmoid_cv"), (1, 0, "uncalibrated_min_class_support"), (0, 3, "train_only_sigmoid_cv")])
def test_small_classes_bound_the_folds(points, most, folds, status):
    first = [r[0] for r in points.where("c = 'w'").select("sample_id").orderBy("sample_id").collect()][:most]
    few = points.where((F.col("c") != "w") | F.col("sample_id").isin(first))
    model = calibrate.fit_calibrated(few, "c", LABELS, _fit)
    assert (model.folds, model.status) == (folds, status)
    assert all(abs(sum(r.probs) - 1) < 1e-9 for r in model.predict(points).collect())


def test_one_class_is_the_answer(points):
    model = calibrate.fit_calibrated(points.where("c = 'v'"), "c", LABELS, _fit)
    assert (model.folds, model.status) == (0, "uncalibrated_single_class_fallback")
    assert {(r.y_pred, tuple(r.probs)) for r in model.predict(points).collect()} == {("v", (0.0, 1.0, 0.0))}


@pytest.fixture(scope="module")
def fitted(points):
    part = F.col("sample_id") % 3 == 0
    return decide.fit_bundle(points.where(~part), points.where(part), "c", LABELS, {"u": "Tier A", "v": "Tier B"}, target="size", target_label="u")


def _decisions(rows, which):
    out = decide.decide_rows(rows.select("sample_id", "x"), which)
    return sorted(((r.sample_id, r.y_pred, r.status, r.tier, tuple(r.conformal_set), r.severity_status, r.confidence, r.distance, r.estimate) for r in out.collect()))


def test_bundle_round_trip_and_refusal(spark, points, fitted, tmp_path):
    path = str(tmp_path / "b")
    bundle.save(spark, fitted, path)
    again = bundle.load(spark, path)
    assert _decisions(points, again) == _decisions(points, fitted)
    assert again.classifier.status == "train_only_sigmoid_cv" and again.cutoff == fitted.cutoff
    policy = glob.glob(f"{path}/artifacts/policy/part-*")[0]
    text = open(policy).read()
    for changed in (text.replace("Tier B", "Tier A"), text + " "):
        open(policy, "w").write(changed)
        with pytest.raises(ValueError):  # the reader's own checksum file may notice it first
            bundle.load(spark, path)
    import os

    for side in glob.glob(f"{path}/artifacts/policy/.*.crc"):
        os.remove(side)
    with pytest.raises(ValueError, match="policy/part-.*changed"):
        bundle.load(spark, path)
    open(policy, "w").write(text)
    assert bundle.load(spark, path).labels == tuple(LABELS)
    open(f"{path}/artifacts/more.txt", "w").write("x")
    with pytest.raises(ValueError, match="more.txt: extra"):
        bundle.load(spark, path)


def test_estimate_only_behind_the_gate(points, fitted):
    ran = []

    def estimate(rows):
        ran.append(rows.count())
        return rows.withColumn("estimate", fitted.regressor.predict(F.col("x")))

    plain = decide.Bundle(*(getattr(fitted, f) for f in ("labels", "classifier", "cutoff", "distance", "distance_limit", "tiers")))
    rows = decide.decide_rows(points.unionByName(points), plain).persist()  # ids twice: nothing may be dropped
    out = decide.gated_estimate(rows, decide.gate_open("u"), estimate).collect()
    opened = [r for r in out if r.status == "accepted" and r.y_pred == "u" and r.tier == "Tier A"]
    assert len(out) == 300 and ran == [len(opened)] and 0 < len(opened) < 300
    assert all((r.estimate is not None) == (r in opened) for r in out)
    assert all(r.severity_status == ("available_exploratory" if r in opened else "not_run_due_to_gating") for r in out)
    assert np.mean([abs(r.estimate - r["size"]) for r in opened]) < 1.0
    unknown = rows.withColumn("status", F.lit(None).cast("string"))
    assert decide.gated_estimate(unknown, decide.gate_open("u"), estimate).where("estimate is null").count() == 300


def test_distance_shares_and_residual_add_up(points):
    rows = points.withColumn("guess", F.when(F.col("sample_id") % 7 == 0, "none").otherwise(F.col("c")))
    model = decide.fit_class_distance(points, "c", LABELS)
    names = ["p__mean", "p__slope", "q__mean", "q__last"]
    features = explain.distance_explanation(rows, model, names, ["sample_id", "guess"], guess="guess").persist()
    got = {}
    for r in features.collect():
        got.setdefault(r.sample_id, {})[r.feature] = r
    x = {r.sample_id: (np.array(r.x), r.guess) for r in rows.collect()}
    assert set(got) == {i for i, (_, g) in x.items() if g != "none"}
    for i, cells in got.items():
        v, g = x[i]
        d = (v - model.mean) / model.scale - model.centers[g]
        p = model.precisions[g]
        assert np.isclose(cells[names[0]].distance, d @ p @ d)
        assert np.isclose(sum(c.contribution for c in cells.values()) + cells[names[0]].cross_term_residual, d @ p @ d)
        assert np.isclose(sum(c.fraction for c in cells.values()), 1)
        assert np.allclose([cells[n].contribution for n in names], d * d * np.diag(p)) and np.allclose([cells[n].displacement for n in names], d)
        assert all(cells[n].direction == ("above_class_center" if k > 0 else "below_class_center") for n, k in zip(names, d))
    score = {r.sample_id: r.s for r in rows.where("guess <> 'none'").select("sample_id", model.score("x", "guess").alias("s")).collect()}
    assert all(np.isclose(score[i], c[names[0]].distance) for i, c in got.items())
    rolled = explain.distance_variables(features, ["sample_id"]).where("sample_id = 1").collect()
    assert {r.variable: r.features for r in rolled} == {"p": 2, "q": 2}
    for r in rolled:
        mine = [got[1][n] for n in names if n.startswith(r.variable)]
        assert np.isclose(r.contribution, sum(c.contribution for c in mine)) and np.isclose(r.weighted_displacement, sum(c.contribution * c.displacement for c in mine))
