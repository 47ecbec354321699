"""Edge semantics of metrics, splits and policy against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import scalars as sc
from tracewell.operators import decide, metrics, splits


def preds(spark, pairs):
    return spark.createDataFrame([(g, y, p, s) for g, y, p, s in pairs], "g string, y_true string, y_pred string, s double")


def test_macro_f1_counts_absent_labels_as_zero(spark):
    df = preds(spark, [("x", "A", "A", 0.9), ("x", "A", "B", 0.8), ("x", "B", "B", 0.7)])
    r = metrics.classification(df, ["g"], ["A", "B", "C"]).first()
    assert r["accuracy"] == pytest.approx(2 / 3) and r["balanced_accuracy"] == pytest.approx(0.75)
    f = 2 / 3
    assert r["macro_f1_fixed"] == pytest.approx(2 * f / 3) and r["macro_f1_observed"] == pytest.approx(f)
    assert r["macro_f1_support_ge_3"] is None
    per = {x["label"]: x for x in metrics.per_class(df, ["g"], ["A", "B", "C"]).collect()}
    assert per["C"]["support"] == 0 and per["C"]["recall"] is None


def test_nothing_accepted_gives_missing_quality(spark):
    df = preds(spark, [("x", "A", "A", 0.9)])
    r = metrics.selective(df, ["g"], ["A"], F.col("s") > 1).first()
    assert (r["coverage"], r["selective_accuracy"], r["risk"], r["reject_rate"]) == (0.0, None, None, 1.0)


def test_ranking_quality_against_pairs(spark):
    rng = random.Random(1)
    rows = [("x", rng.choice("PN"), "P", float(rng.randrange(6))) for _ in range(60)]
    df = preds(spark, rows).withColumn("pos", F.col("y_true") == "P")
    r = metrics.ranking_quality(df, ["g"], "s", "pos", rows_per_bucket=1).first()
    p = [x[3] for x in rows if x[1] == "P"]
    q = [x[3] for x in rows if x[1] == "N"]
    auc = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(p, q)) / (len(p) * len(q))
    ap, seen = 0.0, 0
    for v in sorted({x[3] for x in rows}, reverse=True):
        tp, n = sum(a >= v for a in p), sum(x[3] >= v for x in rows)
        ap += (tp - seen) / len(p) * tp / n
        seen = tp
    assert r["auroc"] == pytest.approx(auc) and r["average_precision"] == pytest.approx(ap)
    one = metrics.ranking_quality(df.where("pos"), ["g"], "s", "pos").first()
    assert one["auroc"] is None and one["average_precision"] is None


def test_constant_target_has_zero_r2(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "y double, p double")
    r = metrics.regression(df, [], "y", "p").first()
    assert (r["mae"], r["rmse"], r["r2"]) == (1.0, 1.0, 0.0)


def test_conformal_index_is_clamped(spark):
    df = spark.createDataFrame([(0.9,), (0.5,)], "p double")
    r = metrics.conformal_cutoffs(df, [], "p", {"a01": 0.01, "a90": 0.9}).first()
    assert r["a01"] == pytest.approx(0.5) and r["a90"] == pytest.approx(0.9)


def test_policy_order(spark):
    cases = [(0, False, "Tier A", "unknown"), (2, False, "Tier A", "requires_review"), (1, True, "Tier C", "requires_review"),
             (1, False, "Tier C", "unknown"), (1, False, "Tier B", "requires_review"), (1, False, "Tier A", "accepted")]
    df = spark.createDataFrame(cases, "n int, ood boolean, tier string, want string")
    out = df.withColumn("got", decide.status_policy(F.col("n"), F.col("ood"), F.col("tier")))
    assert out.where("got <> want").count() == 0


def test_low_cutoff_makes_multi_label_sets(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.2],)], "p array<double>")
    r = df.select(sc.label_set(F.col("p"), ["A", "B", "C"], 0.25).alias("a"), sc.label_set(F.col("p"), ["A", "B", "C"], 0.871).alias("b")).first()
    assert r["a"] == ["A", "B"] and r["b"] == []


def test_probability_alignment(spark):
    df = spark.createDataFrame([([0.2, 0.6],), ([0.0, 0.0],)], "p array<double>")
    got = [r[0] for r in df.select(sc.align_probabilities(F.col("p"), ["B", "Z"], ["A", "B"])).collect()]
    assert got == [[0.0, 1.0], [0.5, 0.5]]


def entities(spark, sizes):
    rows, i = [], 0
    for c, n in sizes.items():
        for s in range(n):
            rows.append((i, c, float(s)))
            i += 1
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, "sample_id long, class string, severity double"), rows


def block_oracle(rows, block):
    """Partition of every entity for one severity block, by list positions."""
    out = {}
    for c in sorted({r[1] for r in rows}):
        ids = [r[0] for r in sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[0]))]
        n = len(ids)
        if n < 6:
            continue
        k = math.ceil(n / 5)
        start = {"low_block": 0, "high_block": n - k, "middle_block": (n - k) // 2}[block]
        held = set(range(start, start + k))
        guard = {start - 1, start + k} & set(range(n))
        rest = [i for i in range(n) if i not in held | guard]
        nv = max(1, round(0.2 * len(rest)))
        for i in range(n):
            out[ids[i]] = "test" if i in held else "gap_excluded" if i in guard else "validation" if i in rest[-nv:] else "train"
    return out


@pytest.mark.parametrize("n", [6, 7, 10, 13, 23])
def test_severity_blocks(spark, n):
    df, rows = entities(spark, {"a": n, "b": 5, "c": 2 * n + 1})
    got = splits.severity_blocked(df, "class", "severity", "sample_id").collect()
    for block in ("low_block", "middle_block", "high_block"):
        assert {r["sample_id"]: r["partition"] for r in got if r["split_id"] == block} == block_oracle(rows, block)


def test_repeated_splits_cover_every_entity_once(spark):
    df, rows = entities(spark, {"a": 10, "b": 25, "c": 3})
    got = splits.repeated_stratified(df, "class", "sample_id", [1, 2]).collect()
    assert len(got) == 2 * len(rows) and len({(r["seed"], r["sample_id"]) for r in got}) == len(got)
    share = [r["partition"] for r in got if r["class"] == "b" and r["seed"] == 1]
    assert (share.count("test"), share.count("validation"), share.count("train")) == (5, 5, 15)


def test_overlap_audit_lists_every_pair(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("z", 9)], "set string, sample_id long")
    got = {(r["left_set"], r["right_set"]): r["overlap"] for r in splits.overlap_audit(df).collect()}
    assert got == {("x", "y"): 1, ("x", "z"): 0, ("y", "z"): 0}
