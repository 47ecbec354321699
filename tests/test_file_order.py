"""Time checks in the order of the source, and scans that report what they could not read."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import audit, ordered
from tracewell.sources import readers


def _rows(spark, times, ordinal="ord"):
    return spark.createDataFrame([("a", i, float(t), 1.0) for i, t in enumerate(times)], f"sample_id string, {ordinal} long, t double, x double").repartition(3)


@pytest.mark.parametrize("size", [1, 2, 3, 10_000])
def test_falling_times_are_seen_across_buckets(spark, size, monkeypatch):
    real = ordered.ordinal_bucket
    monkeypatch.setattr(ordered, "ordinal_bucket", lambda df, o, rows=size: real(df, o, rows))
    for times in ([0, 2, 1, 3], [0, 1, 1, 2], [3, 0, 1, 2], [0, 1, 2, 1]):
        got = audit.time_metrics(_rows(spark, times), 10.0, ordinal="ord").first()
        diffs = [b - a for a, b in zip(times, times[1:])]
        assert not got["time_strictly_increasing"]
        assert (got["time_start_s"], got["time_end_s"], got["sampling_min_s"], got["sampling_max_s"]) == (times[0], times[-1], min(diffs), max(diffs))
        assert got["time_duplicate_count"] == len(times) - len(set(times))
    good = audit.time_metrics(_rows(spark, [0, 1, 2, 3]), 10.0, ordinal="ord").first()
    assert good["time_strictly_increasing"] and good["nonuniform_sampling_intervals"] == 0


def test_gate_in_file_order(spark):
    gate = lambda times, **more: audit.input_gate(_rows(spark, times), ["x"], 0.0, 3.0, 1.0, 0.1, 10.0, id="sample_id", ordinal="ord", **more).first()
    assert gate([0, 1, 2, 3])["valid"]
    swapped = gate([0, 2, 1, 3])
    assert swapped["errors"].split(";") == ["time_not_strictly_increasing_or_duplicate", "sampling_interval_off"]
    assert (swapped["sampling_interval_median_s"], swapped["sampling_interval_max_deviation_s"]) == (2.0, 2.0)
    header = lambda *names: spark.createDataFrame([("a", n) for n in names], "sample_id string, column string")
    assert gate([0, 1, 2, 3], header=header("t", "x"))["valid"]
    extra = gate([0, 1, 2, 3], header=header("t", "x", "note", "more"))
    assert extra["valid"] and extra["extra_columns"] == "more;note"
    assert gate([0, 1, 2, 3], header=header("t", "x", "x"))["errors"] == "duplicate_column_names"
    assert gate([0, 1, 2, 3], header=header("t", "y"))["errors"] == "missing_required_columns:x"


def test_rows_of_a_file_keep_their_order(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.csv").write_text("TIME,P\n" + "".join(f"{t},{t}\n" for t in range(500, 0, -1)))
    (tmp_path / "c" / "2.csv").write_text("TIME,P\n" + "".join(f"{t},{t}\n" for t in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # each file is read in several splits
    try:
        df = readers.scan_trajectories(spark, str(tmp_path), ["TIME", "P"], ordinal="place")
        assert df.rdd.getNumPartitions() > 2
        got = {r["case_id"]: r for r in audit.time_metrics(df, 10.0, id="case_id", ordinal="place").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert not got["1"]["time_strictly_increasing"] and got["1"]["sampling_max_s"] == -1 and got["1"]["time_start_s"] == 500
    assert got["2"]["time_strictly_increasing"] and got["2"]["rows"] == 500


def test_damaged_files_become_rows(spark, tmp_path):
    import bz2
    import gzip

    body = "TIME,P,Q\n" + "".join(f"{i},{i}.5,-{i}\n" for i in range(1, 2001))
    (tmp_path / "whole.csv").write_text(body)
    (tmp_path / "zero.csv").write_bytes(b"")
    (tmp_path / "head.csv").write_text("TIME,P,Q\n")
    (tmp_path / "mixed.csv").write_text('Q,"TIME",P,P\r\n1,2,3,4\r\n\n5,6\n7,x,"8",9\n,10,11,12\n"1,5",2,3,4\n')
    (tmp_path / "lacks.csv").write_text("TIME,Z\n1,2\n")
    (tmp_path / "good.csv.gz").write_bytes(gzip.compress(body.encode()))
    (tmp_path / "cut.csv.gz").write_bytes(gzip.compress(body.encode())[:-500])
    (tmp_path / "cut.csv.bz2").write_bytes(bz2.compress(body.encode())[:-20])
    (tmp_path / "junk.csv.gz").write_bytes(b"this was never compressed")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows, faults = readers.scan_checked(spark, str(tmp_path), ["TIME", "P", "Q"])
        name = F.element_at(F.split("file", "/"), -1)
        got = sorted((r["file"], r["line"], r["error"], r["detail"]) for r in faults.withColumn("file", name).collect())
        n = {r["file"]: r["n"] for r in rows.groupBy(name.alias("file")).agg(F.count("*").alias("n")).collect()}
        mixed = [tuple(r) for r in rows.where(name == "mixed.csv").orderBy("place").select("line", "TIME", "P", "Q").collect()]
        whole = rows.where(name == "whole.csv").agg(F.min("line"), F.max("line"), F.count_if(F.col("line") != F.col("TIME") + 1), F.sum("Q")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    errors = {(f, e) for f, _, e, _ in got}
    assert {("zero.csv", "empty"), ("head.csv", "empty"), ("junk.csv.gz", "unreadable"), ("cut.csv.gz", "unreadable"), ("cut.csv.bz2", "unreadable")} <= errors
    assert not any(f in ("whole.csv", "good.csv.gz") for f, _ in errors)
    assert [g[1:] for g in got if g[0] == "mixed.csv"] == [(1, "repeated_columns", None), (4, "cells", "2 of 4"), (5, "number", "TIME"), (7, "number", "Q")]
    assert mixed == [(2, 2.0, 3.0, 1.0), (5, None, 8.0, 7.0), (6, 10.0, 11.0, None), (7, 2.0, 3.0, None)]
    assert [g[1:] for g in got if g[0] == "lacks.csv"] == [(1, "missing_columns", "P;Q")]
    assert tuple(whole) == (2, 2001, 0, -2001000.0) and n["good.csv.gz"] == 2000
    report = {r["file"]: r for r in audit.file_report(
        spark.createDataFrame([("whole.csv",), ("gone.csv",), ("junk.csv.gz",)], "file string"), rows.withColumn("file", name), faults.withColumn("file", name), "file").collect()}
    assert report["gone.csv"]["status"] == "missing" and report["whole.csv"]["error"] is None and report["whole.csv"]["rows"] == 2000
    assert report["junk.csv.gz"]["status"] == "present" and report["junk.csv.gz"]["unreadable"] == 1 and report["mixed.csv"]["status"] == "extra"
    assert report["mixed.csv"]["error"] == "repeated_columns in line 1"
