"""Fixtures for faults found in review: manifest paths, NULL parity, centred reconstruction error."""

import os

import numpy as np

from tracewell.operators import anomaly, metrics
from tracewell.sources import sinks


def test_manifest_tells_nested_files_apart(spark, tmp_path):
    for part in ("a", "b"):
        os.makedirs(tmp_path / part)
        (tmp_path / part / "same.txt").write_text(part)
    before = spark.createDataFrame(sinks.file_manifest(spark, str(tmp_path)).collect())
    assert {r.file for r in before.collect()} == {"a/same.txt", "b/same.txt"}
    (tmp_path / "a" / "same.txt").write_text("other")
    (tmp_path / "b" / "new.txt").write_text("new")
    got = {r.file: r.status for r in sinks.verify_manifest(before, sinks.file_manifest(spark, f"file://{tmp_path}/")).collect()}
    assert got == {"a/same.txt": "changed", "b/same.txt": "ok", "b/new.txt": "extra"}


def test_parity_with_nulls(spark):
    e = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "x", 1.0), (4, None, float("nan"))], "id int, c string, v double")
    a = spark.createDataFrame([(1, "x", None), (2, "x", 5.0), (3, "x", 1.0), (4, None, float("nan"))], "id int, c string, v double")
    got = {r.id: (r.max_delta, r.passed) for r in metrics.parity(e, a, ["id"], ["c"], ["v"]).collect()}
    assert got == {1: (0.0, True), 2: (None, False), 3: (0.0, True), 4: (0.0, True)}


def test_reconstruction_error_is_centred(spark):
    rng = np.random.default_rng(4)
    x = rng.exponential(size=300)
    rows = [(i, float(i), float(a), float(2 * a + 7 + b)) for i, (a, b) in enumerate(zip(x, rng.normal(scale=0.05, size=300)))]
    df = spark.createDataFrame(rows, "sample_id int, t double, p double, q double")
    model = anomaly.fit_reference(df, ["p", "q"], share=0.9)
    z = np.array([[(r[2] - model.center["p"]) / model.scale["p"], (r[3] - model.center["q"]) / model.scale["q"]] for r in rows])
    c = z - z.mean(axis=0)
    v = np.linalg.eigh(c.T @ c)[1][:, -1:]
    want = np.sqrt(((c - c @ v @ v.T) ** 2).mean(axis=1))
    got = [r.pca_error for r in anomaly.score_rows(df, model).orderBy("sample_id").collect()]
    assert np.allclose(got, want, atol=1e-6)
