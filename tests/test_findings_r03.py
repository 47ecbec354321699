"""Fixtures for the findings of round 3."""

import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators.quantiles import quantiles


def test_order_statistics_of_values_that_wobble(spark):
    """Sums of doubles come out a little different when a second pass adds them up in another order."""
    moved = F.udf(lambda x: x * (1 + random.choice([-1, 0, 1]) * 4e-16), "double")  # anew for each pass
    df = spark.range(200).select((F.col("id") % 40).alias("k"), moved(F.col("id") * 0.37 + 100.1).alias("v"))
    got = {r["k"]: (r["low"], r["mid"], r["high"]) for r in quantiles(df, ["k"], "v", {"low": 0.0, "mid": 0.5, "high": 1.0}).collect()}
    assert len(got) == 40
    for k, found in got.items():
        assert found == pytest.approx([(k + 40 * i) * 0.37 + 100.1 for i in (0, 2, 4)], rel=1e-12)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_rows_of_few_keys_are_not_sorted_by_key(spark, threshold):
    """The brackets of a few keys are broadcast if the session allows it, and the rows are joined once."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        out = quantiles(spark.range(30_000).selectExpr("id % 3 AS k", "cast(id * 7919 % 30011 AS double) AS v"), ["k"], "v", {"q": 0.9})
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = {r["k"]: r["q"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == {k: pytest.approx(np.quantile([i * 7919 % 30011 for i in range(k, 30_000, 3)], 0.9)) for k in range(3)}
    assert ("BroadcastHashJoin [coalesce(k#" in plan) == (threshold == "10m")


@pytest.mark.parametrize("bits", [3, 20])
def test_no_frequent_pair_is_left(monkeypatch, bits):
    """Re-Pair ends when no pair is frequent, however many there are and wherever they are counted."""
    from collections import Counter

    from tracewell.llm import token_files

    monkeypatch.setattr(token_files, "_HASH", bits)
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 3000, rng.integers(2, 90)) for _ in range(300)]
    docs = [np.r_[np.concatenate([words[i] for i in rng.zipf(1.3, 40) % 300]), np.full(rng.integers(0, 300), 9), 2] for _ in range(700)]
    ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    left, right, span, body = token_files.compress(ids, ends, 3001)
    assert (token_files.expand(body, left, right, 3001) == ids).all()
    assert span.tolist() == [len(token_files.expand(np.array([3001 + k], np.int32), left, right, 3001)) for k in range(len(span))]
    at = np.cumsum(np.r_[np.ones(3001, np.int64), span][body])
    assert set(ends.tolist()) <= set(at.tolist())
    inside = ~np.isin(at[:-1], ends)
    pairs = Counter(zip(body[:-1][inside].tolist(), body[1:][inside].tolist(), strict=True))
    assert max(pairs.values()) < token_files.MIN_PAIR


def test_forest_in_parts_is_one_forest(spark, monkeypatch):
    """Trees grown in parts, over several partitions, vote as one forest; a label without a train row keeps its place."""
    from tracewell.operators import learn

    monkeypatch.setattr(learn, "CELLS_PER_PARTITION", 200)
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 3), [float(v) for v in rng.normal(i % 3 * 3, 1, 4)]) for i in range(240)]
    df = spark.createDataFrame(rows, "sample_id long, label int, x array<double>")
    model = learn.fit_forest(df.where("sample_id % 4 > 0"), "label", [0, 1, 2, 7], trees=10, batch=4)
    assert model.votes == (4, 4, 2) and sum(m.stages[-1].getNumTrees for m in model.models) == 10
    got = model.predict(df.where("sample_id % 4 = 0")).collect()
    assert sum(r["label"] == r["y_pred"] for r in got) >= 55
    for r in got:
        votes = np.zeros(4)
        for m in model.models:
            from pyspark.ml.linalg import Vectors

            votes[:3] += m.stages[-1].predictProbability(Vectors.dense(r["x"])).toArray() * m.stages[-1].getNumTrees
        assert r["probs"] == pytest.approx((votes / 10).tolist())
    table = learn.importance_table(spark, model, list("abcd")).collect()
    assert sum(r["importance"] for r in table) == pytest.approx(1.0)


def test_grid_leaves_no_model_in_its_plan(spark):
    """The predictions of a grid are staged cell by cell; a plan of all cells would send every model to every task."""
    from tracewell.operators import learn

    df = spark.range(120).selectExpr("id AS sample_id", "cast(id % 2 AS int) AS y", "array(cast(id % 2 AS double), 1.0D) AS x", "'s' AS split_id", "element_at(array('train', 'validation', 'test'), cast(id % 3 AS int) + 1) AS partition")
    out = learn.evaluate_grid(df, ["s"], {"forest": lambda t: learn.fit_forest(t, "y", [0, 1], trees=4, batch=2)}, ["sample_id", "y"])
    assert "UDF" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["y"], r["y_pred"]) for r in out.collect()} == {(0, 0), (1, 1)} and out.count() == 80


def test_file_errors_with_events_of_no_user(spark, tmp_path):
    """A null or negative id has no expected folder; it neither fails the report nor changes it."""
    from tracewell.plans.sections import audits

    events = spark.createDataFrame(
        [(u, f"2024-01-0{1 + i % 5} 00:00:00", "click", 1.5 * i) for i, u in enumerate([None, -3, 1, 2, 7, 7, 18])], "user_id long, ts string, event_type string, value double")
    report = []
    for name, df in (("all", events), ("users", events.where("user_id >= 0"))):
        df.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / name / "events.parquet"))
        report.append(sorted(map(tuple, audits.aud_02b(spark, str(tmp_path / name)).collect())))
    assert len(report[0]) == 20 and report[0] == report[1]


def test_forest_over_cells_is_a_forest(spark):
    """Trees grown from sums of cells estimate as well as MLlib's on the same rows, and no model of theirs is on the driver."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    from tracewell.operators import binned, learn

    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 3))
    y = 3 * (x[:, 0] > 0.3) + np.sin(2 * x[:, 1]) + 0.1 * rng.normal(size=4000)
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "sample_id long, a double, b double, c double, y double")
    df = df.select("sample_id", F.array("a", "b", "c").alias("x"), "y")
    train, test = df.where("sample_id % 4 > 0").persist(), df.where("sample_id % 4 = 0")
    mine = learn.fit_forest_regressor(train, "y", trees=20)
    assert isinstance(mine, binned.BinnedForest) and mine.trees.count() == 20 and max(mine.bins.dims) == 32
    other = RandomForestRegressor(featuresCol="_features", labelCol="y", numTrees=20, minInstancesPerNode=2, featureSubsetStrategy="0.7", maxDepth=30, seed=7)
    other = other.fit(train.withColumn("_features", array_to_vector("x")))
    error = [learn.regress(m, test).agg(F.avg((F.col("y") - F.col("estimate")) ** 2)).first()[0] for m in (mine, other)]
    assert error[0] == pytest.approx(error[1], rel=0.15)
    assert learn.regress(mine, test).count() == test.count()


def test_one_tree_splits_as_brute_force():
    """The first split and its two leaves are the best of all, and each side keeps the rows it must."""
    from tracewell.operators import binned

    rng = np.random.default_rng(4)
    at, n = rng.integers(0, 6, (40, 2)), rng.integers(1, 4, 40).astype(float)
    s = n * (at[:, 0] > 2) * 5.0 + rng.normal(size=40)
    feature, cut, left, value = binned.grow(at, n, s, (6, 6), 1, 9, 2, np.random.default_rng(0))
    best = max(
        (sum(s[m].sum() ** 2 / n[m].sum() for m in (at[:, j] <= c, at[:, j] > c)), j, c)
        for j in range(2) for c in range(5) if min(n[at[:, j] <= c].sum(), n[at[:, j] > c].sum()) >= 9)
    assert (feature[0], cut[0], left[0]) == (best[1], best[2], 1) and len(value) == 3
    low = at[:, best[1]] <= best[2]
    assert value.tolist() == pytest.approx([s.sum() / n.sum(), s[low].sum() / n[low].sum(), s[~low].sum() / n[~low].sum()])


def test_boosting_cells_is_boosting_rows(spark):
    """Weighted means of cells give the trees that all rows give, if the bins are the same; leaves keep three rows."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    from tracewell.operators import learn

    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, (900, 2)) ** 2  # few values, so that every value is a bin in both
    rows = [(i, [float(v) for v in a], float(a[0] * 2 - a[1] + rng.normal())) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "sample_id long, x array<double>, y double").persist()
    mine = learn.fit_boosted_regressor(df, "y", iterations=8)
    other = GBTRegressor(featuresCol="_features", labelCol="y", maxIter=8, stepSize=0.03, maxDepth=2, minInstancesPerNode=3, lossType="squared", seed=7)
    other = other.fit(df.withColumn("_features", array_to_vector("x")))
    got, want = ({r["sample_id"]: r["estimate"] for r in learn.regress(m, df).collect()} for m in (mine, other))
    assert got == {k: pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in want.items()}


def test_effects_are_computed_once_for_each_row(spark):
    """The work for each row grows with the square of the features, and small rows are dealt over all tasks."""
    from tracewell.operators import explain

    df = spark.range(8, numPartitions=1).select(F.col("id").alias("sample_id"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda j: (F.col("id") * j).cast("double")).alias("x"))
    out = explain.value_faithfulness(df, lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v), [0.0] * 6, k=2, draws=3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("get(_abs" not in line for line in plan.splitlines()) and out.rdd.getNumPartitions() == 4
    for r in out.collect():
        assert r.estimate == 21.0 * r.sample_id and r.top_k_effect == 11.0 * r.sample_id
        assert r.random_k_effect <= r.top_k_effect and r.top_exceeds_random == (r.random_k_effect < r.top_k_effect)


def test_boosted_labels_grow_side_by_side(spark, monkeypatch):
    """Each label's model is a job of its own over rows packed by size, and the models keep the order of the labels."""
    from threading import Barrier

    from tracewell.operators import learn

    df = spark.range(300, numPartitions=40).select("id", (F.col("id") % 3).alias("label"), F.array((F.col("id") % 3).cast("double"), (F.col("id") % 7).cast("double")).alias("x"))
    meet, real, parts = Barrier(3, timeout=60), learn.Pipeline, []

    class Meeting(real):
        def fit(self, rows):
            meet.wait()
            parts.append(rows.rdd.getNumPartitions())
            return super().fit(rows)

    monkeypatch.setattr(learn, "Pipeline", Meeting)
    model = learn.fit_boosted(df, "label", [0, 1, 2], iterations=2, depth=2)
    assert parts == [1, 1, 1]
    assert model.predict(df).where("label <> y_pred").count() == 0


def test_ids_of_pieces_are_those_of_whole_texts(monkeypatch):
    """Marks and line feeds are cut off where the tokenizer cuts, also when the worker forgets; frequent pieces are not encoded again."""
    from tracewell.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    enc, rng = tokens.Encoder(tokens.default_path()), random.Random(3)
    bits = ["one", "two,", "é", ". ", "a.", ",b", "...", "3.5", " ", "\n", "\t", "<|endoftext|>", "'s", " 's", "!", "\x1c", "ß.", "中.", " .", " \n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(3000)]
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    got = [x for i in range(0, len(texts), 50) for x in enc(texts[i : i + 50])]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in got] == want

    for i in range(20):
        enc(["often " + " ".join(f"w{i}x{j} often" for j in range(20))])
    enc.tok = None
    assert len(enc(["often often often"])) == 1


def test_rounds_count_only_what_may_be_frequent(monkeypatch):
    """Re-Pair counts every pair once; later rounds look at pairs that were frequent or hold a new symbol."""
    from tracewell.llm import token_files

    seen, count = [], token_files.frequent
    monkeypatch.setattr(token_files, "frequent", lambda *a: seen.append(len(a[0])) or count(*a))
    rng = np.random.default_rng(2)
    rare = rng.integers(100, 3000, 40_000)
    ids = np.concatenate([rare, np.tile(rng.integers(0, 100, 500), 80)])
    left, right, _, body = token_files.compress(ids, np.array([len(ids)]), 3000)
    assert (token_files.expand(body, left, right, 3000) == ids).all()
    assert len(seen) > 5 and max(seen[2:]) < len(rare)


def test_lists_pair_documents_by_their_rarer_tokens(spark, monkeypatch):
    """Copies of 17 shingles with 3 of their own never link; the shared ones lie behind the first n - t + 1, so no pair is made. Texts are not staged."""
    from tracewell.llm import jaccard_join

    rows, columns, stage = {}, set(), jaccard_join.stage

    def counted(df, name, *a):
        out = stage(df, name, *a)
        rows[name] = out.count()
        columns.update(out.columns)
        return out

    monkeypatch.setattr(jaccard_join, "stage", counted)
    passage = " ".join(f"w{k}" for k in range(21))
    docs = spark.createDataFrame([(i, f"{passage} a{i} b{i} c{i}") for i in range(100)], "doc_id long, text string")
    got = jaccard_join.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(i, 20, i) for i in range(100)]
    assert rows["outside"] >= 100 and rows["seeds"] == 0 and "text" not in columns


@pytest.mark.parametrize("words", [1, 64])
def test_chains_of_loose_copies_link_as_by_brute_force(spark, monkeypatch, words):
    """Classes that only meet by a second pairing, documents of several texts; the filter of moved texts may let others through."""
    from tracewell.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "FILTER_WORDS", words)
    draw, rows = random.Random(words), []
    for g in range(3):
        text = [f"g{g}w{k}" for k in range(40 + 20 * g)]
        for i in range(60):
            text = list(text)
            for _ in range(draw.randint(0, 2)):
                text[draw.randrange(len(text))] = f"x{g}y{i}z{draw.randrange(9)}"
            rows.append((draw.randrange(150), " ".join(text[: draw.randint(len(text) - 8, len(text))])))
    sets = [(d, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for d, t in rows for w in [t.split()]]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if 100 * len(s & t) >= 75 * len(s | t) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == sorted((d, len(s), find(d)) for d, s in sets)
    assert 3 <= len({find(d) for d, _ in sets}) < len(root)


#: Encodes a batch of 24 MB of text, a third of its words new, as a worker does; prints its threads and the MB it took at most and holds.
_ENCODE_A_BATCH = r"""
import os, re, resource
import numpy as np, pyarrow as pa
from tracewell.llm import packing, tokens

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

path, rng = tokens.default_path(), np.random.default_rng(5)
words = np.array([f"w{i % 997}o{i}" for i in range(300_000)])
texts = [" ".join(words[np.r_[rng.integers(0, 3000, 200), rng.integers(0, len(words), 100)]]) for _ in range(10_000)]
batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
del words, texts
tokens.encoder(path).whole("a b")
before, threads, top = held(), len(os.listdir("/proc/self/task")), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
n = sum(len(x) for x in packing._encode(iter([batch]), path, 1))
print(n, len(os.listdir("/proc/self/task")) - threads, round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024 - top), round(held() - before))
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory is read from Linux's /proc")
def test_encoding_takes_little_memory():
    """The workers of an executor share what its heap leaves: no threads for each core, small parts, and what is no longer needed goes back."""
    out = subprocess.run([sys.executable, "-c", _ENCODE_A_BATCH], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[1], timeout=300)
    rows, threads, peak, kept = map(int, out.stdout.split())
    assert rows == 10_000
    assert threads <= 1 and peak < 120 and kept < 60, out.stdout
