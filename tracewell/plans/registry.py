"""Query registry: each entry pairs a Spark plan with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(col: str | Column, digits: int = 6) -> Column:
    """Comparable double: rounded, without negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, leave the rest as it is."""
    return df.select(*[r6(f"`{f.name}`", digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema])


def q6(expr: str, digits: int = 6) -> str:
    """SQL twin of `r6`."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
