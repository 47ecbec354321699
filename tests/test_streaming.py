"""Streams against their batch forms: rows out of order, late rows, corrections, repeated batches, ending state."""

import glob
import random
import time

import numpy as np
from pyspark.sql import functions as F

from tracewell.operators import windows as win
from tracewell.streaming import online

SCHEMA = "sample_id long, t double, score double, ts timestamp"


def _write(spark, rows, path):
    df = spark.createDataFrame([(k, float(t), s) for k, t, s in rows], "sample_id long, t double, score double")
    df.withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.02)  # files are taken by the time they were written


def _alarms(spark, folder, out, k=3, lateness="100 seconds", keep="1 day"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    online.drain(online.persistent_alarm_stream(stream, 4.0, k, "ts", lateness, keep=keep), out)
    return spark.read.schema(online.ALARM_SCHEMA).parquet(f"{out}/data")


def test_first_run_end():
    rng = np.random.default_rng(0)
    for _ in range(300):
        above, k, carried = rng.random(rng.integers(0, 15)) < 0.6, int(rng.integers(1, 5)), int(rng.integers(0, 3))
        run, hit = carried, -1
        for i, a in enumerate(above):
            run = run + 1 if a else 0
            if run >= k and hit < 0:
                hit = i
        assert online.first_run_end(above, k, carried) == (hit, run)


def test_rows_in_any_order_give_the_batch_alarm(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, i, float("nan") if (i + k) % 17 == 0 else float("inf") if i % 29 == 0 else None if i % 31 == 5 else rng.random() * 8) for k in range(8) for i in range(240)]
    arrival = sorted(rows, key=lambda r: r[1] + rng.random() * 80)
    for lo in range(0, len(arrival), 400):
        _write(spark, arrival[lo : lo + 400], str(tmp_path / "in"))
    told = _alarms(spark, str(tmp_path / "in"), str(tmp_path / "out")).persist()
    batch = win.persistent_alarm(spark.createDataFrame([(k, float(t), s) for k, t, s in rows], "sample_id long, t double, score double"), "score", 4.0, 3, 10.0)
    want = {r["sample_id"]: r["first_alarm_s"] for r in batch.collect() if r["first_alarm_s"] is not None}
    got = online.current_alarms(told).collect()
    assert {r["sample_id"]: r["first_alarm_s"] for r in got} == want and len(want) == 8
    assert all(r["late_rows"] == 0 for r in got) and told.where("kind = 'late'").count() == 0
    assert len(glob.glob(f"{tmp_path}/out/_state/commits/*")) >= 5


def test_answers_are_corrected_and_late_rows_come_out(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write(spark, [(1, 10, 9.0), (1, 30, 9.0), (1, 40, 9.0)], src)  # an alarm at 40 unless a low row comes between
    _write(spark, [(1, 35, 0.0)], src)
    _write(spark, [(1, 500, 9.0), (2, 500, 0.0)], src)
    _write(spark, [(2, 501, 0.0)], src)  # the timer judges the rows before the watermark
    _write(spark, [(1, 36, 9.0), (1, 501, 9.0)], src)  # 36 is behind the watermark, its neighbours are judged
    _write(spark, [(1, 502, 9.0)], src)
    told = _alarms(spark, src, out).collect()
    alarms = sorted((r["version"], r["first_alarm_s"], r["confirmed"]) for r in told if r["kind"] == "alarm")
    assert [a for _, a, _ in alarms][:2] == [40.0, None] and alarms[-1][1] == 501.0
    assert [(r["sample_id"], r["t"], r["score"]) for r in told if r["kind"] == "late"] == [(1, 36.0, 9.0)]


def test_state_ends(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write(spark, [(1, 0, 9.0), (1, 1, 9.0), (2, 0, 0.0)], src)
    _write(spark, [(2, 1000, 0.0)], src)
    _write(spark, [(2, 9000, 0.0)], src)
    _write(spark, [(2, 9001, 0.0)], src)
    _write(spark, [(1, 9100, 9.0), (2, 9100, 0.0)], src)
    # with the state kept, the row at 9100 is the third in a row; it ended long before
    assert online.current_alarms(_alarms(spark, src, out, keep="50 minutes")).count() == 0
    assert [r["first_alarm_s"] for r in online.current_alarms(_alarms(spark, src, str(tmp_path / "kept"))).collect()] == [9100.0]


def test_windows_are_listed_at_once_and_corrected(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rng = random.Random(8)
    rows = sorted([(i % 3, i, rng.random()) for i in range(300)], key=lambda r: r[1] + rng.random() * 60)
    for lo in range(0, 300, 100):
        _write(spark, rows[lo : lo + 100], src)
    ref = spark.createDataFrame([(k, 0.5, 0.1 + k) for k in range(3)], "sample_id long, center double, scale double")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    scored = online.windowed_score_stream(stream, ref, ["sample_id"], "score", "ts", "1 minute", "100 seconds")
    scored = scored.select("sample_id", F.unix_seconds("window.start").alias("start"), "n", "mean_score", "peak_score")
    online.upsert(scored, out)
    schema = "sample_id long, start long, n long, mean_score double, peak_score double"
    table = spark.createDataFrame([(k, float(t), s) for k, t, s in rows], "sample_id long, t double, score double").join(ref, "sample_id")
    z = (F.col("score") - F.col("center")) / F.col("scale")
    want = table.groupBy("sample_id", (F.floor(F.col("t") / 60) * 60).alias("start")).agg(F.count("t").alias("n"), F.avg(z).alias("m"), F.max(F.abs(z)).alias("p"))

    def cells(df):
        return sorted((*r[:3], round(r[3], 9), round(r[4], 9)) for r in map(tuple, df.collect()))

    written = spark.read.parquet(f"{out}/data")
    assert written.groupBy("sample_id", "start").count().where("count > 1").count() > 0
    assert cells(online.current(spark, out, schema, ["sample_id", "start"])) == cells(want) and want.count() == 15
    online.compact(spark, out, schema, ["sample_id", "start"], str(tmp_path / "small"))
    assert cells(online.current(spark, str(tmp_path / "small"), schema, ["sample_id", "start"])) == cells(want)
    batch = spark.read.parquet(f"{out}/data/batch=1")  # a batch that runs again replaces itself
    kept = batch.collect()
    spark.createDataFrame(kept, batch.schema).write.mode("overwrite").parquet(f"{out}/data/batch=1")
    assert cells(online.current(spark, out, schema, ["sample_id", "start"])) == cells(want)
