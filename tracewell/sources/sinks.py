"""Result tables, JSON summaries, exports and content manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.scalars import json_safe


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_trajectories(df: DataFrame, path: str, partition_by: Sequence[str], sort: Sequence[str]) -> None:
    """Files sorted by (id, time) inside each task, so time filters skip row groups."""
    df.sortWithinPartitions(*sort).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def json_rows(df: DataFrame, keys: Sequence[str], out: str = "json") -> DataFrame:
    """One JSON text per row; NaN and infinities become null, which to_json leaves out."""
    safe = [json_safe(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema if f.name not in keys]
    return df.select(*keys, F.to_json(F.struct(*safe)).alias(out))


def diagnosis_export(df: DataFrame, id: str, quality: Sequence[str], diagnosis: Sequence[str], version: str = "1", out: str = "json") -> DataFrame:
    """Diagnosis per trajectory as JSON text, input figures but no raw rows."""
    body: list[Column] = [
        F.lit(version).alias("schema_version"), F.struct(F.col(id).cast("string").alias("source"), *quality).alias("input"), F.struct(*diagnosis).alias("diagnosis"),
    ]
    return df.select(id, F.to_json(F.struct(*body)).alias(out))


def file_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path relative to `path`, size and SHA-256 of every file below it; a file is held whole while it is hashed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    root = "/" + path.split("://")[-1].removeprefix("file:").strip("/") + "/"  # listed paths spell the scheme in their own way
    relative = F.col("path").substr(F.instr(F.col("path"), root) + len(root), F.length("path"))
    return files.select(relative.alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Every listed or found file with ok / changed / missing / extra."""
    e = expected.select("file", F.col("sha256").alias("_want"))
    a = actual.select("file", F.col("sha256").alias("_got"))
    status = (
        F.when(F.col("_got").isNull(), "missing").when(F.col("_want").isNull(), "extra").when(F.col("_want") == F.col("_got"), "ok").otherwise("changed")
    )
    return e.join(a, "file", "full_outer").select("file", status.alias("status"))


def set_digest(df: DataFrame, id: str, keys: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """SHA-256 of a set of ids of any size.

    Ids are spread over buckets by the first hex digits of their own digest; each bucket hashes its
    sorted ids, and the result hashes the bucket digests in bucket order. More digits give smaller buckets.
    """
    ids = df.select(*keys, F.col(id).cast("string").alias("_id")).distinct()
    slot = F.substring(F.sha2("_id", 256), 1, digits)
    per = ids.groupBy(*keys, slot.alias("_slot")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("_id")), ","), 256).alias("_d"), F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*keys).agg(
        F.sum("_n").alias("ids"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_slot", "_d"))), lambda s: s["_d"]), ","), 256).alias("sha256"),
    )  # at most 16 ** digits bucket digests
