"""Linear-algebra core, learning operators, sources and streaming on small inputs."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import events, explain, gram, learn
from tracewell.operators import windows as win
from tracewell.sources import readers, sinks


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 3)) @ np.array([[2.0, 0.3, 0.0], [0.0, 1.0, 0.2], [0.0, 0.0, 0.1]])
    y = np.array(["u" if v > 0 else "w" for v in x[:, 0]])
    df = spark.createDataFrame([(i, v.tolist(), str(c)) for i, (v, c) in enumerate(zip(x, y))], "sample_id long, x array<double>, c string")
    return df.repartition(5), x, y


def test_moments_and_shrinkage(points):
    df, x, y = points
    m = gram.fit_moments(df, F.col("x"))
    assert np.allclose(m.gram, x.T @ x) and m.n == 90 and m.quartic == pytest.approx(((x**2).sum(1) ** 2).sum())
    lw = gram.ledoit_wolf(m)
    # definition of the intensity by looping over rows
    s = x.T @ x / len(x)
    mu = np.trace(s) / 3
    d2 = ((s - mu * np.eye(3)) ** 2).sum() / 3
    b2 = sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / 3 / len(x) ** 2
    assert lw.shrinkage == pytest.approx(min(b2, d2) / d2)
    assert np.allclose(lw.precision @ lw.covariance, np.eye(3))
    by = gram.fit_moments_by(df, "c", F.col("x"))
    assert np.allclose(by["u"].gram, x[y == "u"].T @ x[y == "u"]) and set(by) == {"u", "w"}
    q = {r["sample_id"]: r["d"] for r in df.select("sample_id", gram.quadratic_form(F.col("x"), lw.precision).alias("d")).collect()}
    assert q[7] == pytest.approx(x[7] @ lw.precision @ x[7])


def test_principal_axes_reconstruct(points):
    df, x, _ = points
    full = gram.principal_axes(gram.fit_moments(df, F.col("x")), 1.0)
    err = df.select(gram.reconstruction_rmse(F.col("x"), full).alias("e")).agg(F.max("e")).first()[0]
    assert err < 1e-9
    assert gram.principal_axes(gram.fit_moments(df, F.col("x")), 0.5).shape[1] == 1


def test_ridge_matches_normal_equations(points):
    df, x, _ = points
    y = x @ np.array([1.0, -2.0, 0.5]) + 3
    rows = df.withColumn("y", F.aggregate(F.zip_with("x", F.array(F.lit(1.0), F.lit(-2.0), F.lit(0.5)), lambda a, w: a * w), F.lit(3.0), lambda s, v: s + v))
    m = learn.fit_ridge(rows, "x", "y", 10.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
    got = {r["sample_id"]: r["p"] for r in rows.select("sample_id", m.predict(F.col("x")).alias("p")).collect()}
    assert got[4] == pytest.approx(y.mean() + z[4] @ w)


def test_median_fill_uses_train_rows_only(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, [3.0, 4.0]), (3, [100.0, float("nan")])], "sample_id long, x array<double>")
    fill = learn.fit_medians(df.where("sample_id < 3"))
    assert fill == [2.0, 4.0]
    assert df.where("sample_id = 3").select(learn.impute("x", fill)).first()[0] == [100.0, 4.0]


def test_majority_is_by_count(spark):
    df = spark.createDataFrame([("z",), ("z",), ("a",)], "c string")
    assert learn.majority_class(df, "c").first()["majority"] == "z"  # not the alphabetically first class


def test_leave_one_out_and_permutation(points):
    df, _, _ = points
    m = learn.fit_logistic(df, "c", ["u", "w"])
    imp = {r["feature"]: r["importance"] for r in explain.permutation_importance(df, m, "c", ["f0", "f1", "f2"], 2).collect()}
    assert max(imp, key=imp.get) == "f0"
    loo = explain.leave_one_out(df, m, [0.0, 0.0, 0.0], ["f0", "f1", "f2"], ["sample_id"])
    assert loo.count() == 270
    partner = explain.shuffled_partner(df.select("sample_id", "x"), "sample_id", 1, 0).collect()
    assert sorted(tuple(r["x"]) for r in partner) == sorted(tuple(r["_other"]) for r in partner)


def test_event_parsing(spark):
    lines = ["junk", "  5.5 sec, Malfunction #1 Fraction 0.2", "3 sec, Malfunction # 2 Fraction 1", "9 sec, HPI Pump #1 Position Change: 100%",
             "8 sec, reactor  scram", "8 sec, Turbine Position Change: 0 %", "2 sec Reactor Scram"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "sample_id long, line_no long, line string")
    r = events.report_table(df).first()
    assert r["report_line_count"] == 7 and r["injection_s"] == 5.5
    assert (r["first_protection_s"], r["first_protection_category"]) == (8.0, "reactor_scram")
    assert r["protection_match_count"] == 3 and r["protection_categories"] == "hpi_pump_start;reactor_scram;turbine_trip"


def test_csv_scan_takes_ids_from_paths_and_keeps_bad_lines(spark, tmp_path):
    for c, case, body in (("CLS", "2", "0,1\n10,bad\n"), ("CLS", "10", "0,5\n"), ("RW", "1", "0,1,9,9\n")):
        os.makedirs(tmp_path / c, exist_ok=True)
        (tmp_path / c / f"{case}.csv").write_text("TIME,P\n" + body)
    df = readers.numeric_order(readers.scan_trajectories(spark, str(tmp_path), ["TIME", "P"]))
    got = [(r["class"], r["case_number"], r["t"], r["P"]) for r in df.orderBy("class", "case_number", "t").collect()]
    assert got == [("CLS", 2, 0.0, 1.0), ("CLS", 2, 10.0, None), ("CLS", 10, 0.0, 5.0), ("RW", 1, 0.0, 1.0)]
    assert df.cache().where(F.col(readers.CORRUPT).isNotNull()).count() == 1


def test_manifest_notices_changes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one")
    (tmp_path / "b.bin").write_bytes(b"two")
    want = sinks.file_manifest(spark, str(tmp_path)).collect()
    listed = spark.createDataFrame(want)
    (tmp_path / "b.bin").write_bytes(b"TWO")
    (tmp_path / "c.bin").write_bytes(b"new")
    got = {r["file"]: r["status"] for r in sinks.verify_manifest(listed, sinks.file_manifest(spark, str(tmp_path))).collect()}
    assert got == {"a.bin": "ok", "b.bin": "changed", "c.bin": "extra"}


def test_worker_functions_do_not_need_the_package(tmp_path):
    """Python workers started outside the repository must still run the Arrow functions."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from tracewell.session import build_session\n"
        "from tracewell.operators import gram\n"
        "from pyspark.sql import functions as F\n"
        "s = build_session('workers', 'local[2]', **{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'})\n"
        "df = s.range(10).select('id', (F.col('id') % 2).alias('k'), F.array(F.col('id') * 1.0, F.lit(1.0)).alias('x'))\n"
        "assert gram.fit_moments(df, F.col('x')).gram[0][0] == 285.0\n"
        "assert sorted(gram.fit_moments_by(df, 'k', F.col('x'))) == [0, 1]\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=200)
