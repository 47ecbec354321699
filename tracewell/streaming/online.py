"""Online forms of the alarm and of windowed scoring, and a sink that keeps one current row for each key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALARM_SCHEMA = "sample_id long, kind string, version long, first_alarm_s double, confirmed boolean, t double, score double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_run_end(above: np.ndarray, k: int, carried: int = 0) -> tuple[int, int]:
    """Place of the first row that ends a run of k true ones (-1: none), and the run open at the end; `carried` is open at the start."""
    if not len(above):
        return -1, carried
    at = np.arange(1, len(above) + 1)
    cut = np.maximum.accumulate(np.where(above, 0, at))
    run = at - cut + np.where(cut == 0, carried, 0)
    hits = np.flatnonzero(above & (run >= k))
    return (int(hits[0]) if len(hits) else -1), int(run[-1])


class _Alarm(StatefulProcessor):
    """Rows wait in the state until the watermark has passed them and are then judged in event-time order."""

    def __init__(self, threshold: float, k: int, keep_ms: int):
        self.threshold, self.k, self.keep_ms = threshold, k, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at array<long>, t array<double>, score array<double>")
        # until: time of the last row judged; known: the alarm last told, final once confirmed; due: the timer that is set
        self.state = handle.getValueState("state", "run long, until long, known double, confirmed boolean, version long, seen long, due long")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, until, known, confirmed, version, seen, due = self._load()
        for chunk in rows:
            late = (chunk["at"] < until).to_numpy()
            if late.any():
                old = chunk[late]
                yield self._out(key, len(old), "late", version, t=old["t"].to_numpy(), score=old["score"].to_numpy())
                chunk = chunk[~late]
            if len(chunk):
                seen = max(seen, int(chunk["at"].max()))
                self.waiting.appendValue(tuple(chunk[c].tolist() for c in ("at", "t", "score")))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), (run, until, known, confirmed, version, seen, due))

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, state = timerValues.getCurrentWatermarkInMs(), self._load()
        state = (*state[:-1], -1)  # this timer is gone
        if mark > state[5] + self.keep_ms and not self.waiting.exists():
            self.state.clear()
        else:
            yield from self._advance(key, mark, state)

    def close(self) -> None:
        pass

    def _load(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else (0, np.iinfo(np.int64).min, None, False, 0, np.iinfo(np.int64).min, -1)

    def _advance(self, key: tuple[Any, ...], mark: int, state: tuple) -> Iterator[pd.DataFrame]:
        run, until, known, confirmed, version, seen, due = state
        chunks = list(self.waiting.get()) if self.waiting.exists() else []
        at, t, score = (np.concatenate([np.array(c[i], kind) for c in chunks]) if chunks else np.empty(0, kind) for i, kind in enumerate((np.int64, float, float)))
        order = np.lexsort((t, at))
        at, t, score = at[order], t[order], score[order]
        done = int(np.searchsorted(at, mark, side="right"))
        with np.errstate(invalid="ignore"):
            above = (score > self.threshold) & (score != np.inf)
        hit, run = first_run_end(above[:done], self.k, run)
        if done:
            until = int(at[done - 1])
        told, found = (known, confirmed), known
        if not confirmed:
            if hit >= 0:
                found, confirmed = float(t[hit]), True
            else:
                open_hit, _ = first_run_end(above[done:], self.k, run)
                found = float(t[done + open_hit]) if open_hit >= 0 else None
        if (found, confirmed) != told:
            version += 1
            yield self._out(key, 1, "alarm", version, first_alarm_s=found, confirmed=confirmed)
        if done:
            if done < len(at):
                self.waiting.put([(at[done:].tolist(), t[done:].tolist(), score[done:].tolist())])
            else:
                self.waiting.clear()
        wanted = int(at[done]) + 1 if done < len(at) else seen + self.keep_ms + 1
        if wanted != due:
            if due >= 0:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(max(wanted, mark + 1))
            due = max(wanted, mark + 1)
        self.state.update((run, until, found, confirmed, version, seen, due))

    @staticmethod
    def _out(key: tuple[Any, ...], n: int, kind: str, version: int, **cells) -> pd.DataFrame:
        row = {"sample_id": [key[0]] * n, "kind": [kind] * n, "version": [version] * n}
        for c, dtype in (("first_alarm_s", "float64"), ("confirmed", "object"), ("t", "float64"), ("score", "float64")):
            v = cells.get(c)
            row[c] = pd.Series(v if isinstance(v, np.ndarray) else [v] * n, dtype=dtype)
        return pd.DataFrame(row)


def persistent_alarm_stream(
    stream: DataFrame, threshold: float, k: int, event_time: str, lateness: str, id: str = "sample_id", keep: str = "30 days"
) -> DataFrame:
    """First time at which an entity's score has exceeded the threshold on k consecutive rows, from rows in any order.

    `stream` has the id, an event-time column, `t` (seconds) and `score`.  A row waits in the entity's state until the
    watermark has passed it; an event-time timer then judges the waiting rows in order, so rows that come out of order
    within `lateness` change nothing.  A missing or infinite score breaks the run.

    The output has versioned rows of kind `alarm`: the newest version for an id is its answer, `confirmed` once no row within the lateness
    can change it, before that the answer if no earlier row came any more (NULL takes one back).  A row older than the
    last one judged comes out as it is with kind `late`.  The state of an entity without rows waiting ends `keep` after its last row;
    rows after that start anew.  It holds the rows of one span of `lateness` and a few numbers.

    Needs the RocksDB state store, which `drain` sets for its query.
    """
    keep_ms = int(stream.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {keep}) AS ms").first()["ms"])
    # Without the event-time column itself, rows behind the watermark reach the state instead of being dropped unseen.
    rows = stream.withWatermark(event_time, lateness).select(
        F.col(id).cast("long").alias("sample_id"), F.unix_millis(event_time).alias("at"), F.col("t").cast("double").alias("t"), F.col("score").cast("double").alias("score"))
    return rows.where("at is not null").groupBy("sample_id").transformWithStateInPandas(
        _Alarm(threshold, k, keep_ms), ALARM_SCHEMA, "append", "EventTime")


def current_alarms(told: DataFrame) -> DataFrame:
    """The newest answer for each entity that has an alarm, with the number of its late rows."""
    newest = F.max_by(F.struct("first_alarm_s", "confirmed"), F.when(F.col("kind") == "alarm", F.col("version")))
    out = told.groupBy("sample_id").agg(newest.alias("_now"), F.count_if(F.col("kind") == "late").alias("late_rows"))
    return out.select("sample_id", "_now.first_alarm_s", "_now.confirmed", "late_rows").where("first_alarm_s is not null")


def windowed_score_stream(
    stream: DataFrame, reference: DataFrame, on: list[str], value: str, event_time: str, span: str, lateness: str, id: str = "sample_id"
) -> DataFrame:
    """Per (entity, tumbling window): mean score against a frozen reference table with center and scale.

    The reference joins statically; the planner broadcasts it only if it is small enough.  Meant for the update mode: a window's row
    comes out whenever it has changed, so write it with `upsert`.
    """
    joined = stream.withWatermark(event_time, lateness).join(reference, on)
    z: Column = (F.col(value) - F.col("center")) / F.col("scale")
    return joined.groupBy(F.col(id), F.window(event_time, span)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(z).alias("mean_score"), F.max(F.abs(z)).alias("peak_score"))


# ---------------------------------------------------------------- sinks


def drain(df: DataFrame, path: str, mode: str = "append") -> None:
    """Run the stream over what is available now into Parquet files below `path`, with its own checkpoint."""
    _run(df, df.writeStream.format("parquet").option("path", f"{path}/data"), path, mode)


def upsert(df: DataFrame, path: str) -> None:
    """Run the stream in update mode over what is available now, keeping each batch's changed rows for `current`.

    A batch is one folder named by its number, so a batch that runs again after a failure replaces itself.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    _run(df, df.writeStream.foreachBatch(write), path, "update")


def current(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key that `upsert` and `compact` have written below `path`."""
    names = [f.name for f in _schema(spark, schema)]
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/data").parquet(f"{path}/data")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("_now"))
    return newest.select("_now.*")


def compact(spark: SparkSession, path: str, schema: str, keys: Sequence[str], into: str) -> None:
    """Write the newest row of every key to the folder `into` as its batch 0, from which another stream may go on."""
    current(spark, path, schema, keys).write.mode("overwrite").parquet(f"{into}/data/batch=0")


def _schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def _run(df: DataFrame, writer, path: str, mode: str) -> None:
    conf = df.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)  # fixed for the query when it starts
    try:
        query = writer.outputMode(mode).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, before)
