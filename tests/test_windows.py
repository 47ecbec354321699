"""Edge semantics of window features, persistence and alignment."""

import math

import pytest
from pyspark.sql import functions as F

from tracewell.operators import aggregates as agg
from tracewell.operators import align, audit
from tracewell.operators import windows as win


def frame(spark, values, id=1):
    return spark.createDataFrame([(id, float(i), v) for i, v in enumerate(values)], "sample_id long, t double, s double")


def alarm(spark, values, **kw):
    return win.persistent_alarm(frame(spark, values), "s", 1.0, 3, 2.0, **kw).first()["first_alarm_s"]


def test_strict_and_legacy_runs_differ_by_one(spark):
    v = [0.0, 2.0, 2.0, 2.0, 0.0]
    assert alarm(spark, v) == 3.0
    assert alarm(spark, v, semantics="legacy_off_by_one") == 2.0
    # at the start of the series there is no low row in front, so both agree
    assert alarm(spark, [2.0, 2.0, 2.0]) == alarm(spark, [2.0, 2.0, 2.0], semantics="legacy_off_by_one") == 2.0


def test_missing_scores(spark):
    gap = [2.0, 2.0, None, 2.0, 0.0]
    assert alarm(spark, gap) is None
    assert alarm(spark, gap, semantics="legacy_off_by_one") == 3.0
    assert alarm(spark, [2.0, float("nan"), 2.0, 2.0, 2.0]) == 4.0
    assert alarm(spark, [2.0, 2.0, 2.0, 2.0], start_after=0.0) == 3.0


def test_window_summary_last_baseline_and_degenerate_slope(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.4, 2.0), (1, 10.0, 5.0), (2, 0.0, 1.0), (2, 3.0, 1.0)], "sample_id long, t double, f double")
    out = {r["sample_id"]: r for r in win.window_summary(df, ["f"], [10.0], 0.5).collect()}
    assert set(out) == {1}  # the second trajectory is shorter than the window
    r = out[1]
    assert (r["f__last"], r["f__delta_t0"], r["f__slope"], r["f__std"], r["n_points"]) == (5.0, 3.0, 0.0, 0.0, 1)


def test_rolling_slope_needs_a_full_span(spark):
    df = frame(spark, [0.0, 1.0, 2.0, 3.0, 8.0])
    got = [r[-1] for r in win.rolling_slopes(df, ["s"], [2.0], 1.0, 2.0).orderBy("t").collect()]
    assert got[:2] == [None, None] and got[2:4] == pytest.approx([1.0, 1.0]) and got[4] == pytest.approx(3.0)


def test_describe_single_value_and_empty(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", None)], "k string, v double")
    got = {r["k"]: r for r in agg.describe(df, ["k"], "v").collect()}
    assert (got["a"]["n"], got["a"]["std"], got["a"]["ci95_low"]) == (1, 0.0, 2.0)
    assert (got["b"]["n"], got["b"]["mean"], got["b"]["std"]) == (0, None, None)


def test_baseline_scale_below_floor_is_missing(spark):
    df = spark.createDataFrame([("f", 0.0), ("f", 0.0), ("g", 100.0), ("g", 100.0)], "feature string, x double")
    assert {r["feature"]: r["scale"] for r in agg.baseline_scale(df).collect()} == {"f": None, "g": pytest.approx(1.0)}


def test_interpolation_inside_the_range_only(spark):
    ref = spark.createDataFrame([(0.0, 0.0), (4.0, 8.0), (5.0, 0.0)], "t double, f double")
    df = spark.createDataFrame([(1, x, 1.0) for x in (-1.0, 0.0, 1.0, 4.0, 4.5, 5.0, 6.0)], "sample_id long, t double, f double")
    got = {r["t"]: r["f_ref"] for r in align.interpolate_reference(df, ref, ["f"], 1.0).collect()}
    assert got == {0.0: 0.0, 1.0: 2.0, 4.0: 8.0, 4.5: 4.0, 5.0: 0.0}
    exact = align.join_reference(df, ref, ["f"])
    assert sorted(r["t"] for r in exact.collect()) == [0.0, 4.0, 5.0]


def test_nearest_train_ties_take_the_lower_value(spark):
    rows = [("s", "c", 1, 10, "train"), ("s", "c", 2, 12, "test"), ("s", "c", 3, 14, "train"), ("s", "c", 4, 30, "test"), ("s", "d", 5, 1, "test")]
    df = spark.createDataFrame(rows, "split_id string, class string, sample_id long, severity long, partition string")
    got = {r["sample_id"]: (r["nearest_train"], r["gap"]) for r in align.nearest_in_train(df, rows_per_bucket=1).collect()}
    assert got == {2: (10.0, 2.0), 4: (14.0, 16.0), 5: (None, None)}


def test_duplicate_event_rows_fail(spark):
    df = frame(spark, [1.0])
    ev = spark.createDataFrame([(1, 5.0), (1, 6.0)], "sample_id long, e double")
    with pytest.raises(Exception, match="more than one event row"):
        align.join_events(df, ev).collect()


def test_gate_codes(spark):
    def codes(values):
        df = spark.createDataFrame([(1, t, x) for t, x in values], "sample_id long, t double, p double")
        return audit.input_gate(df, ["p"], 0.5, 120.0, 10.0, 1.0, 50.0).first()["errors"]

    good = [(float(t), 1.0) for t in range(0, 130, 10)]
    assert codes(good) == ""
    assert codes(good[:5]) == "window_too_short"
    assert "p_contains_NaN_or_Inf" in codes([*good[:3], (30.0, math.nan), *good[4:]])
    assert "p_contains_NaN_or_Inf" in codes([*good[:3], (30.0, math.inf), *good[4:]])
    assert "time_not_strictly_increasing_or_duplicate" in codes([*good, (120.0, 1.0)])
    assert "baseline_at_or_before_injection_missing" in codes(good[1:] + [(130.0, 1.0)])
    df = spark.createDataFrame([(1, t, None) for t, _ in good], "sample_id long, t double, p double")
    assert audit.input_gate(df, ["p"], 0.5, 120.0, 10.0, 1.0, 50.0).first()["errors"] == "missing_required_columns:p"


def test_results_do_not_depend_on_partitioning(spark):
    rows = [(k, float(i), float((i * 7 + k) % 11)) for k in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "sample_id long, t double, s double")
    run = lambda d: sorted(map(tuple, win.persistent_alarm(d, "s", 4.0, 2, 7.0).collect()))
    base = run(df)
    assert run(df.repartition(1)) == base == run(df.repartition(8).withColumn("unused", F.lit(1)))
    half = df.where("t < 20").unionByName(df.where("t >= 20"))
    assert run(half) == base
