"""Family tiers, cases after each start, deviation from the start, and attribution of an estimate, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import anomaly, explain, learn, metrics
from tracewell.operators import windows as win


def test_tiers_of_classes_and_families(spark):
    rows = [("a", "f", True, 25, 6, 7), ("b", "f", True, 3, 1, 0), ("c", "g", True, 30, 9, 9), ("d", "g", True, 0, 8, 8), ("e", "g", False, 0, 0, 0),
            ("h", "k", False, 40, 9, 9), ("i", "k", False, 0, 0, 0), ("j", "m", True, 0, 0, 0), ("l", "n", True, 19, 9, 9), ("o", "p", True, 20, 4, 9)]
    df = spark.createDataFrame(rows, "class string, family string, expected boolean, matched long, low_support long, high_support long")
    assert {r["class"]: r.tier[-1] for r in metrics.capability_tiers(df).collect()} == dict(zip("abcdehijlo", "ABACCACCBB"))
    got = {r.family: r for r in metrics.family_tiers(df).collect()}
    assert {f: (r.tier[-1], r.status) for f, r in got.items()} == {
        "f": ("A", "supported"), "g": ("B", "exploratory"), "k": ("A", "supported"), "m": ("C", "not-supported"), "n": ("B", "exploratory"), "p": ("B", "exploratory")}
    assert tuple(got["g"])[1:8] == ("c;d;e", "c;d", "c", "d", 30, 9, 9)  # support of a member without a match does not count


def test_cases_start_after_each_injection(spark):
    scores = {1: [9, 9, 9, 0, 9, 9, 0, 9], 2: [0, 9, 9, 9, 0, 0, 0, 0], 3: [9, 9, 0, 0, 0, 0, 0, 0]}
    long = spark.createDataFrame([(i, float(t), "m", float(s), 5.0) for i, v in scores.items() for t, s in enumerate(v)], "sample_id long, t double, method string, score double, `limit` double")
    events = spark.createDataFrame([(1, 4.5), (2, 2.5)], "sample_id long, first_protection_s double")
    starts = spark.createDataFrame([(1, 1.0), (3, 1.0)], "sample_id long, injection_s double")
    got = {r.sample_id: r for r in anomaly.detector_cases(long, events, starts, 2, 3.0).collect()}
    assert (got[1].first_alarm_s, got[1].points, got[1].points_above, got[1].detected_before_event, got[1].delay_s) == (5.0, 6, 4, False, 4.0)
    assert (got[2].start_s, got[2].first_alarm_s, got[2].points_above, got[2].lead_time_s, got[2].detected_before_event) == (0.0, 2.0, 3, 0.5, True)
    assert (got[3].first_alarm_s, got[3].points_above, got[3].detected) == (None, 0, False)


def test_deviation_from_start(spark):
    ref = spark.createDataFrame([(0, 0.0, -4.0, 0.0), (0, 1.0, 2.0, 5.0)], "sample_id long, t double, p double, q double")
    df = spark.createDataFrame([(7, 1.0, 6.0, 9.0, 2.0, 5.0)], "sample_id long, t double, p double, q double, p_ref double, q_ref double")
    got = win.deviation_from_start(df, ref, ["p", "q"]).first()
    assert (got.p__score, got.q__score) == (1.0, 4.0)


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6))
    y = x @ np.array([5.0, -3.0, 2.0, 0.5, 0.1, 0.0]) + 7
    df = spark.createDataFrame([(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, y))], "sample_id long, x array<double>, y double").repartition(3).persist()
    model = learn.fit_ridge(df, "x", "y", 10.0)
    return df, x, model


def test_drivers_of_an_estimate(linear):
    df, x, model = linear
    center = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]
    w = model.weights / model.scale
    got = explain.value_drivers(df, model.predict, center, [f"f{j}" for j in range(6)], ["sample_id"]).collect()
    assert len(got) == 360
    for r in got:
        j = int(r.feature[1])
        assert np.isclose(r.contribution, w[j] * (x[r.sample_id, j] - center[j])) and np.isclose(r.estimate, (x[r.sample_id] - model.mean) @ w + model.intercept)


def test_removing_the_strongest_moves_the_estimate_most(linear):
    df, x, model = linear
    center, w = np.zeros(6), model.weights / model.scale
    got = explain.value_faithfulness(df, model.predict, center.tolist(), k=2, draws=15).collect()  # 15 draws of 15 pairs
    assert len(got) == 60
    for r in got:
        parts = w * x[r.sample_id]
        top = sorted(np.argsort(-np.abs(parts))[:2].tolist())
        assert list(r.top_features) == top and np.isclose(r.top_k_effect, parts[top].sum())
        assert np.isclose(r.difference, r.top_k_effect - r.random_k_effect) and r.random_k_std >= 0 and r.top_exceeds_random == (r.difference > 0)
        assert abs(r.random_k_effect) <= np.abs(parts).sum()


def test_importance_has_a_spread_and_rolls_up(linear):
    df, _, _ = linear
    rows = df.withColumn("c", F.when(F.get("x", F.lit(0)) > 0, "u").otherwise("v"))
    model = learn.fit_logistic(rows, "c", ["u", "v"])
    names = ["p__mean", "p__last", "q__mean", "q__last", "q__std", "q__slope"]
    got = {r.feature: r for r in explain.permutation_importance(rows, model, "c", names, repeats=3).collect()}
    assert max(got, key=lambda n: got[n].importance) == "p__mean" and all(r.repeats == 3 and r.delta_std >= 0 for r in got.values())
    assert got["p__mean"].importance >= abs(got["p__mean"].delta_log_loss)
    rolled = {r.variable: r for r in explain.importance_variables(explain.permutation_importance(rows, model, "c", names, repeats=3)).collect()}
    assert {v: r.features for v, r in rolled.items()} == {"p": 2, "q": 4}
    assert np.isclose(rolled["p"].importance, got["p__mean"].importance + got["p__last"].importance)


@pytest.mark.parametrize("per", [2, 10_000])
def test_ordered_text(spark, per):
    from tracewell.operators import aggregates as agg

    rng = np.random.default_rng(1)
    rows = [("ab"[i % 5 == 0], float(rng.integers(0, 9)), None if i % 11 == 0 else "xyz"[int(rng.integers(0, 3))]) for i in range(60)] + [("c", 1.0, None), (None, 2.0, "q")]
    df = spark.createDataFrame(rows, "k string, o double, v string").repartition(4)
    got = {r.k: (r.text, r.n) for r in agg.ordered_text(df, ["k"], "v", "o", ";", rows_per_bucket=per).collect()}
    sets = {r.k: r.text for r in agg.ordered_text(df, ["k"], "v", "o", distinct=True, rows_per_bucket=per).collect()}
    assert set(got) == {"a", "b", None}
    for k in got:
        mine = sorted((o, v) for g, o, v in rows if g == k and v is not None)
        assert got[k] == (";".join(v for _, v in mine), len(mine))
        first = {}
        for o, v in mine:
            first.setdefault(v, o)
        assert sets[k] == ",".join(v for v, _ in sorted(first.items(), key=lambda x: (x[1], x[0])))
