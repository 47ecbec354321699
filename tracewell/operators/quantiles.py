"""Exact order statistics and ranks for groups of any size.

`percentile` keeps every distinct value of a group in one buffer.  Here a mergeable sketch
only proposes a bracket around each wanted rank; a second pass counts exactly what lies
below the bracket and lists the distinct values inside it, about 3/1024 of a large group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordered import BUCKET, attach, even_shares, quantile_bucket, running_sum, value_slot
from tracewell.session import cut_lineage

CELLS = 1024  # grid of the sketch; its rank error is a tenth of one cell
WOBBLE = 1e-12  # by this share of the largest magnitude a value may differ between the two passes
ROWS_PER_STEP = 1 << 22  # rows of a key for each step that a bracket is cut into


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column], cells: int = CELLS) -> DataFrame:
    """Per key: `n` and, for each name, the value at a zero-based rank given in terms of `n`.

    Rank expressions may use the column `n` (non-null, non-NaN values of the key).  The
    bracket is one grid cell wider than needed on both sides, ten times the rank error that the sketch
    guarantees at any size; the check at the end fails the job instead of returning a wrong value.  It is also wider by `WOBBLE` of
    the largest magnitude: sums of doubles that are computed anew for the second pass, in another order, differ in their last digits.
    A large key's bracket is cut into steps of the value, so that no task sorts it alone.
    """
    keyed = df if keys else df.withColumn("_every", F.lit(1))
    keys = list(keys) or ["_every"]
    names = list(ranks)
    v = F.col("_v")
    clean = keyed.select(*keys, F.col(value).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    grid = clean.groupBy(*keys).agg(
        F.percentile_approx(v, even_shares(cells), cells * 10).alias("_g"), F.count(F.lit(1)).alias("n"),
        F.min(v).alias("_min"), F.max(v).alias("_max"),
    )
    at = lambda i: F.get("_g", i.cast("int") - 1)
    span = F.greatest(F.abs("_min"), F.abs("_max")) * WOBBLE
    pad = F.when(span < float("inf"), span).otherwise(0.0)
    cols = []
    for j, name in enumerate(names):
        k = F.least(F.greatest(ranks[name].cast("long"), F.lit(0)), F.col("n") - 1)
        place = F.lit(float(cells)) * (k + 1) / F.col("n")
        low, high = F.floor(place) - 1, F.ceil(place) + 1
        cols += [
            k.alias(f"_k{j}"),
            (F.when(low >= 1, at(low)).otherwise(F.col("_min")) - pad).alias(f"_lo{j}"),
            (F.when(high <= cells - 1, at(high)).otherwise(F.col("_max")) + pad).alias(f"_hi{j}"),
        ]
    brackets, few = _staged(grid.select(*keys, "n", *cols))
    inside = [(v >= F.col(f"_lo{j}")) & (v <= F.col(f"_hi{j}")) for j in range(len(names))]
    some = inside[0]
    for c in inside[1:]:
        some = some | c
    steps = F.ceil(F.col("n") / F.lit(ROWS_PER_STEP))
    # A slot never falls with the value, so neither does the sum of the slots in all brackets.
    slot = value_slot(v, F.col("_lo0"), F.col("_hi0"), steps)
    for j in range(1, len(names)):
        slot = slot + value_slot(v, F.col(f"_lo{j}"), F.col(f"_hi{j}"), steps)
    placed = attach(clean, brackets, keys, small=few or keys == ["_every"])
    # n and the ranks belong to the key.  Grouped by, they stay in the exchange, so that both readers of the counts share one.
    fixed = ["n", *[f"_k{j}" for j in range(len(names))]]
    counts = placed.groupBy(*keys, *fixed, F.when(some, v).alias("_w"), F.when(some, slot).otherwise(F.lit(-1)).alias(BUCKET)).agg(
        *[F.count_if(inside[j]).alias(f"_in{j}") for j in range(len(names))],
        *[F.count_if(v < F.col(f"_lo{j}")).alias(f"_below{j}") for j in range(len(names))],
    )
    # All that lies below a bracket comes before it, outside values first.
    ends = running_sum(counts, keys, ["_w"], {f"_end{j}": F.col(f"_below{j}") + F.col(f"_in{j}") for j in range(len(names))})
    found = []
    for j, name in enumerate(names):
        k, end, width = F.col(f"_k{j}"), F.col(f"_end{j}"), F.col(f"_in{j}")
        hit = F.max(F.when((width > 0) & (k < end) & (k >= end - width), F.col("_w")))
        found.append(F.coalesce(hit, F.raise_error(F.lit(f"rank {name} outside its bracket")).cast("double")).alias(name))
    return ends.groupBy(*keys).agg(F.max("n").alias("n"), *found).drop("_every")


def _staged(brackets: DataFrame) -> tuple[DataFrame, bool]:
    """The brackets, one short row for each key, written once, and whether they are below the session's limit for broadcasts.

    The planner does not broadcast a side of few keys, since most of its partitions are empty; all rows of a key would then be sorted in one task.
    """
    spark = brackets.sparkSession
    brackets = cut_lineage(brackets)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if limit.startswith("-"):
        return brackets, False
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit)
    return brackets, brackets.count() * 32 * len(brackets.columns) <= most


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    method: str = "linear",
    cells: int = CELLS,
) -> DataFrame:
    """Exact quantiles per key: method linear, lower or higher (NumPy's meaning)."""
    pos = {n: F.round(F.lit(float(p)) * (F.col("n") - 1), 9) for n, p in probs.items()}
    ranks: dict[str, Column] = {}
    for n, x in pos.items():
        if method in ("linear", "lower"):
            ranks[f"_lo_{n}"] = F.floor(x)
        if method in ("linear", "higher"):
            ranks[f"_hi_{n}"] = F.ceil(x)
    stats = order_statistics(df, keys, value, ranks, cells)
    out = [F.col("n")]
    for n, x in pos.items():
        lo, hi = F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        if method == "lower":
            out.append(lo.alias(n))
        elif method == "higher":
            out.append(hi.alias(n))
        else:
            out.append((lo + (hi - lo) * (x - F.floor(x))).alias(n))
    return stats.select(*keys, *out)


def medians(df: DataFrame, keys: Sequence[str], value: str, out: str = "median", cells: int = CELLS) -> DataFrame:
    return quantiles(df, keys, value, {out: 0.5}, "linear", cells).drop("n")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank", rows_per_bucket: int = 10_000) -> DataFrame:
    """(keys, value) -> average rank (ties share the mean rank); one row per distinct value."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_sum(quantile_bucket(counts, keys, value, rows_per_bucket), keys, [value], {"_cum": F.col("_c")})
    return cum.select(*keys, value, (F.col("_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(out))
