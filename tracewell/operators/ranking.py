"""Sorting, best-per-group selection, top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str | None = None) -> DataFrame:
    """First row of each group under a tie-break chain.

    Spark pushes a per-partition limit below the shuffle for `row_number() = 1`
    (window group limit), so a large group sends one row per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    best = df.withColumn(out or "_rn", F.row_number().over(w)).where(F.col(out or "_rn") == 1)
    return best if out else best.drop("_rn")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, out: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("long")).where(F.col(out) <= k)


def held_out_row(selected: DataFrame, held_out: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Held-out rows of the selected settings; a setting without exactly one row fails the job."""
    n = held_out.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*held_out.columns)).alias("_row"))
    hit = selected.select(*keys).join(n, list(keys), "left")
    sure = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit("selected setting needs exactly one held-out row")))
    return hit.select(sure.alias("_row")).select("_row.*")


def extreme_rows(df: DataFrame, value: str, k: int, ties: Sequence[str], largest: bool = True) -> DataFrame:
    """k largest or smallest rows of the whole table (TakeOrderedAndProject)."""
    first = F.col(value).desc_nulls_last() if largest else F.col(value).asc_nulls_last()
    return df.orderBy(first, *ties).limit(k)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def consistent_entities(df: DataFrame, id: str, attributes: Sequence[str]) -> DataFrame:
    """One row per id; ids whose attributes disagree are marked instead of silently picked."""
    pack = F.struct(*attributes)
    out = df.groupBy(id).agg(F.min(pack).alias("_a"), (F.min(pack) == F.max(pack)).alias("consistent"))
    return out.select(id, *[F.col(f"_a.{c}").alias(c) for c in attributes], "consistent")
