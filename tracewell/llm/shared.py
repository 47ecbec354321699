"""Staging on shared storage, connected components, and key ranges for compact exchanges."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import shared_dir


#: Paths staged in the open scratch blocks, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratch", default=())


def stage(df: DataFrame, name: str, outer: int = 0) -> DataFrame:
    """Write `df` once to the shared folder and go on from the files; survives lost executors.

    Inside `scratch` the files leave with the block, or with the one `outer` blocks further out.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    if len(_OPEN.get()) > outer:
        _OPEN.get()[-1 - outer].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is staged inside the block leaves the shared folder when it ends, also by an error.

    Gives a function that stages a result which outlives the block; it must not read the block's files any more.
    """
    paths: list[str] = []
    token = _OPEN.set((*_OPEN.get(), paths))
    try:
        yield lambda df, name: stage(df, name, outer=1)
    finally:
        _OPEN.reset(token)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Labelled documents that a model is fitted on at most: the ids with the smallest hashes.  They are broadcast, 16 bytes each.
LABELLED = 1 << 17


def labelled(labels: DataFrame, value: str, most: int = LABELLED) -> DataFrame:
    """(doc_id, value) of at most `most` labelled documents, to be broadcast; the largest value counts where a document has several."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull()).groupBy("doc_id").agg(F.max(value).alias(value))
    return F.broadcast(stage(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled"))


def key_ranges(spark: SparkSession) -> int:
    """Number of hash ranges of an exchange: a few for each shuffle partition, so that tasks even out."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_slices(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut sorted uint64 keys at the range edges: range numbers that hold keys, and their bounds."""
    r = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cut = np.flatnonzero(np.diff(r)) + 1
    return r[np.r_[0, cut]].astype(np.int64) if len(keys) else r.astype(np.int64), np.r_[0, cut, len(keys)]


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 as byte planes of their differences, compressed."""
    d = np.diff(keys, prepend=keys[:1])
    planes = np.ascontiguousarray(d).view(np.uint8).reshape(-1, 8).T.tobytes()
    return np.array([len(keys), keys[0] if len(keys) else 0], dtype=np.uint64).tobytes() + pa.compress(planes, "zstd", asbytes=True)


def unpack_sorted(blob: bytes) -> np.ndarray:
    n, first = np.frombuffer(blob[:16], dtype=np.uint64)
    if not n:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(pa.decompress(blob[16:], int(n) * 8, "zstd", asbytes=True), dtype=np.uint8)
    d = np.ascontiguousarray(planes.reshape(8, int(n)).T).view(np.uint64).ravel()
    return np.cumsum(d, dtype=np.uint64) + first


def pack_plain(values: np.ndarray) -> bytes:
    """Fixed-width numbers as compressed byte planes; the caller knows the type."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return np.uint64(len(values)).tobytes() + pa.compress(planes, "zstd", asbytes=True)


def unpack_plain(blob: bytes, dtype) -> np.ndarray:
    n, dt = int(np.frombuffer(blob[:8], dtype=np.uint64)[0]), np.dtype(dtype)
    if not n:
        return np.empty(0, dt)
    planes = np.frombuffer(pa.decompress(blob[8:], n * dt.itemsize, "zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(dt.itemsize, n).T).view(dt).ravel()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (id, component) for each vertex, the smallest id naming it.

    Alternates the large-star and small-star steps until the edges stand still; the number of
    rounds grows with the logarithm of the longest chain.  Each round is staged, only the result stays.
    """
    with scratch(edges.sparkSession) as keep:
        e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        seen = None
        while True:
            mark = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
            if mark == seen:
                break
            seen = mark
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = large.where("a <> b").distinct()
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            down = large.join(low, "a")
            small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
            e = stage(small.where("a <> b").distinct(), "edges")
        out = e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        return keep(out, "components")
