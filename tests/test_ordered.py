"""Bucketed order operators against plain Python, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import align, ordered
from tracewell.operators.ordered import BUCKET
from tracewell.operators.quantiles import average_ranks, medians, order_statistics, quantiles


def series(seed=3):
    rng = random.Random(seed)
    out = []
    for key, n in (("hot", 120), ("a", 7), ("b", 1), ("c", 20)):
        for i in rng.sample(range(300), n):
            out.append((key, float(i), rng.choice([None, 0.0, 1.0, 2.0, 5.0]), rng.random() < 0.6))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def data(spark):
    raw = series()
    df = spark.createDataFrame(raw, "k string, t double, x double, flag boolean").repartition(4)
    by = {}
    for r in raw:
        by.setdefault(r[0], []).append(r)
    for k in by:
        by[k].sort(key=lambda r: r[1])
    return df, by


def collect(df, *cols):
    return {(r["k"], r["t"]): tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("width", [10.0, 64.0, 1000.0])
def test_neighbours_fills_and_sums(data, width):
    df, by = data
    b = ordered.time_bucket(df, "t", width)
    prev = collect(ordered.neighbour(b, ["k"], ["t"], {"p": "t"}), "p")
    nxt = collect(ordered.neighbour(b, ["k"], ["t"], {"p": "t"}, "next"), "p")
    both = collect(ordered.fill_both(b, ["k"], ["t"], "x", "lo", "hi"), "lo", "hi")
    fwd = collect(ordered.fill(b, ["k"], ["t"], {"f": "x"}), "f")
    cum = collect(ordered.running_sum(b, ["k"], ["t"], {"s": F.coalesce("x", F.lit(0.0))}), "s")
    num = collect(ordered.row_numbers(b, ["k"], ["t"], "rn", "n"), "rn", "n")
    for k, rs in by.items():
        total = 0.0
        for i, r in enumerate(rs):
            at = (k, r[1])
            total += r[2] or 0.0
            assert prev[at] == (rs[i - 1][1] if i else None,)
            assert nxt[at] == (rs[i + 1][1] if i + 1 < len(rs) else None,)
            before = [q[2] for q in rs[: i + 1] if q[2] is not None]
            after = [q[2] for q in rs[i:] if q[2] is not None]
            assert both[at] == (before[-1] if before else None, after[0] if after else None)
            assert fwd[at] == (before[-1] if before else None,)
            assert cum[at][0] == pytest.approx(total)
            assert num[at] == (i + 1, len(rs))


@pytest.mark.parametrize("width", [5.0, 50.0, 1000.0])
def test_run_lengths(data, width):
    df, by = data
    got = collect(ordered.run_lengths(ordered.time_bucket(df, "t", width), ["k"], ["t"], "flag", "run", "broken"), "run", "broken")
    for k, rs in by.items():
        run, broken = 0, False
        for r in rs:
            run = run + 1 if r[3] else 0
            broken = broken or not r[3]
            assert got[(k, r[1])] == (run, broken)


@pytest.mark.parametrize("per", [3, 10, 10_000])
def test_quantile_bucket_is_monotone(data, per):
    df, by = data
    placed = ordered.quantile_bucket(df, ["k"], "t", per)
    got = {(r["k"], r["t"]): r[BUCKET] for r in placed.collect()}
    for k, rs in by.items():
        seq = [got[(k, r[1])] for r in rs]
        assert seq == sorted(seq)
    hot = len({v for (k, _), v in got.items() if k == "hot"})
    assert hot == 1 if per == 10_000 else hot > 5


@pytest.mark.parametrize("per", [8, 16, 1024])
def test_exact_quantiles_match_numpy(data, per):
    df, by = data
    for method in ("linear", "lower", "higher"):
        got = {r["k"]: r for r in quantiles(df, ["k"], "t", {"q1": 0.1, "q5": 0.5, "q995": 0.995}, method, per).collect()}
        for k, rs in by.items():
            v = [r[1] for r in rs]
            for n, p in (("q1", 0.1), ("q5", 0.5), ("q995", 0.995)):
                assert got[k][n] == pytest.approx(np.quantile(v, p, method=method))
    overall = medians(df, [], "t", "m", per).first()["m"]
    assert overall == pytest.approx(np.median([r[1] for rs in by.values() for r in rs]))


def test_quantiles_skip_missing_and_handle_repeats(spark):
    df = spark.createDataFrame([("a", 1.0)] * 50 + [("a", None), ("a", float("nan")), ("a", 9.0), ("b", None)], "k string, v double")
    got = {r["k"]: r["m"] for r in medians(df, ["k"], "v", "m", 2).collect()}
    assert got == {"a": 1.0}
    top = order_statistics(df, ["k"], "v", {"last": F.col("n") - 1, "clamped": F.lit(10**6)}, 2).first()
    assert (top["n"], top["last"], top["clamped"]) == (51, 9.0, 9.0)


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", v) for v in [3.0, 1.0, 3.0, 2.0, 3.0]], "k string, v double")
    assert {r["v"]: r["rank"] for r in average_ranks(df, ["k"], "v", rows_per_bucket=1).collect()} == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 1.0)], "k string, t double")
    out = ordered.row_numbers(ordered.time_bucket(df, "t", 1.0), ["k"], ["t"])
    assert out.count() == 3


def test_large_keys_are_cut_beyond_the_sketch(spark, monkeypatch):
    monkeypatch.setattr("tracewell.operators.quantiles.ROWS_PER_STEP", 7)
    values = [float(v) for v in np.random.default_rng(3).integers(-50, 50, 900)] + [float("inf"), float("-inf"), 0.25]
    df = spark.createDataFrame([("k", v) for v in values] + [("one", 2.0), ("none", None)], "k string, v double")
    got = {r["k"]: r for r in order_statistics(df, ["k"], "v", {"a": F.lit(0), "b": F.floor(F.col("n") / 3), "c": F.col("n") - 1}, cells=8).collect()}
    s = sorted(values)
    assert (got["k"]["a"], got["k"]["b"], got["k"]["c"], got["one"]["b"]) == (s[0], s[len(s) // 3], s[-1], 2.0)
    placed = ordered.quantile_bucket(df, ["k"], "v", rows_per_bucket=5, side=2).where("k = 'k'")
    spans = placed.groupBy("_bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_bucket").collect()
    assert len(spans) > 4 and all(a["hi"] < b["lo"] for a, b in zip(spans[:-1], spans[1:], strict=True))


@pytest.mark.parametrize("what", ["medians", "quantile_bucket", "row_numbers"])
def test_one_key_with_most_rows_is_split(spark, what):
    """With nothing small enough to broadcast, the rows of a key that has nearly all of them still spread over tasks."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(40_000).selectExpr("IF(id % 10 = 0, concat('k', id % 70), 'hot') AS k", "id AS sample_id", "cast((id * 7919) % 40009 AS double) AS v").repartition(8)
        if what == "medians":
            out = medians(df, ["k"], "v", "m")
        else:
            out = ordered.quantile_bucket(df, ["k"], "v", 1000)
            out = ordered.row_numbers(out, ["k"], ["v"]) if what == "row_numbers" else out.groupBy("k", ordered.BUCKET).count()
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in plan
    if what == "medians":
        assert np.isclose({r["k"]: r["m"] for r in rows}["hot"], np.median([(i * 7919) % 40009 for i in range(40_000) if i % 10]))
    elif what == "row_numbers":
        assert sorted(r["rn"] for r in rows if r["k"] == "hot") == list(range(1, 36_001))


@pytest.mark.parametrize("per", [3, 20, 10_000])
def test_ties_are_split_by_id(spark, per):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.choice([1.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 3.5, None]), rng.choice(["train", "test"])) for i in range(400)]
    df = spark.createDataFrame(rows, "class string, sample_id long, severity double, partition string").repartition(5)
    placed = ordered.split_ties(ordered.quantile_bucket(df, ["class"], "severity", per), ["class"], "severity", "sample_id", per)
    if per < 100:
        assert placed.groupBy("class", BUCKET).count().agg(F.max("count")).first()[0] <= 4 * per
    got = {r["sample_id"]: (r["rn"], r["n"]) for r in ordered.row_numbers(placed, ["class"], ["severity", "sample_id"], "rn", "n").collect()}
    for c in "ab":
        mine = sorted([r for r in rows if r[0] == c], key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        assert [got[r[1]] for r in mine] == [(i + 1, len(mine)) for i in range(len(mine))]
    known = [r for r in rows if r[2] is not None]
    near = align.nearest_in_train(df.where("severity is not null").withColumn("split_id", F.lit("s")), rows_per_bucket=per).collect()
    assert len(near) == sum(r[3] == "test" for r in known)
    for r in near:
        train = [x[2] for x in known if x[0] == r["class"] and x[3] == "train"]
        assert r["gap"] == min(abs(v - r["test_value"]) for v in train) and abs(r["nearest_train"] - r["test_value"]) == r["gap"]
