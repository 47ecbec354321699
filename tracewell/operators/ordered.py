"""Order-dependent building blocks that never put a whole key into one task.

A trajectory, class or source may hold a large share of all rows, so a plain
`Window.partitionBy(key)` would sort that share in a single task.  Everything here
works on (key, bucket) groups instead, where the bucket is monotone in the sort
order, and carries a one-row summary per bucket from each bucket to the next:

* time buckets       - `floor(t / width)`, no extra pass over the data;
* quantile buckets   - per-key equi-depth bounds from a mergeable sketch.

Only bucket summaries are windowed by the bare key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"
_FIRST = Window.unboundedPreceding
_LAST = Window.unboundedFollowing


def time_bucket(df: DataFrame, t: str, width: float, out: str = BUCKET) -> DataFrame:
    return df.withColumn(out, F.floor(F.col(t) / F.lit(float(width))))


def ordinal_bucket(df: DataFrame, ordinal: str, rows: int = 10_000, out: str = BUCKET) -> DataFrame:
    """Buckets of at most `rows` rows of a key in the order of distinct whole numbers, or of (block, row) places in a file."""
    kind = df.schema[ordinal].dataType
    if isinstance(kind, T.StructType):
        *outer, last = [F.col(f"{ordinal}.{f.name}") for f in kind]
        return df.withColumn(out, F.struct(*outer, F.floor(last / F.lit(rows)).alias("row")))
    return df.withColumn(out, F.floor(F.col(ordinal) / F.lit(rows)))


def attach(df: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Equi-join in which NULL keys match each other, keeping one copy of the keys.

    `small` is for sides whose row count is fixed by construction (one row, or one row per
    requested rank); all other sides are left to the planner, which measures them.
    """
    renamed = side.select(*[F.col(c).alias(f"_rhs_{c}" if c in on else c) for c in side.columns])
    if small:
        renamed = F.broadcast(renamed)
    cond = None
    for c in on:
        one = df[c].eqNullSafe(renamed[f"_rhs_{c}"])
        cond = one if cond is None else cond & one
    return df.join(renamed, cond, how).drop(*[f"_rhs_{c}" for c in on])


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of an ungrouped aggregate, which has exactly one row, to every row."""
    return attach(df.withColumn("_one", F.lit(1)), row.withColumn("_one", F.lit(1)), ["_one"], small=True).drop("_one")


def even_shares(n: int) -> Column:
    """1/n ... (n-1)/n as one foldable expression; a literal per share would swell the plan."""
    text = ",".join(repr(i / n) for i in range(1, n))
    return F.expr(f"cast(split('{text}', ',') as array<double>)")


def value_slot(v: Column, low: Column, high: Column, parts: Column) -> Column:
    """Which of `parts` equal steps from low to high a value lies in; never falls with the value, 0 below, parts - 1 above."""
    step = F.floor((v - low) / F.nullif(high - low, F.lit(0.0)) * parts)
    return F.when(v >= high, parts - 1).when(v <= low, F.lit(0)).otherwise(F.least(F.greatest(step, F.lit(0)), parts - 1)).cast("long")


def quantile_bucket(
    df: DataFrame, keys: Sequence[str], value: str, rows_per_bucket: int = 10_000, side: int = 32, out: str = BUCKET
) -> DataFrame:
    """Equi-depth bucket of a numeric column within `keys`; exact order, approximate size.

    A key gets about n / rows_per_bucket buckets, so small keys stay in one bucket and a key with a
    large share of all rows is cut into many.  A sketch gives the bounds of up to side * side of them, found
    in two steps of `side` comparisons each; where a key needs more, each of these is cut into
    equal steps of the value.
    """
    if not keys:
        return quantile_bucket(df.withColumn("_all", F.lit(1)), ["_all"], value, rows_per_bucket, side, out).drop("_all")
    most = side * side
    v = F.col(value).cast("double")
    want = F.greatest(F.ceil(F.col("_n") / F.lit(rows_per_bucket)), F.lit(1))
    step = F.greatest(F.lit(1), F.ceil(F.lit(most) / want))
    bounds = (
        df.groupBy(*keys).agg(
            F.percentile_approx(v, even_shares(most), most * 10).alias("_b"), F.count(F.lit(1)).alias("_n"),
            F.min(v).alias("_min"), F.max(v).alias("_max"),
        )
        .withColumn("_parts", F.ceil(want / F.lit(most)))
        .withColumn("_step", step)
        .withColumn("_b", F.filter("_b", lambda b, i: (i + 1) % F.col("_step") == 0))
        .withColumn("_coarse", F.filter("_b", lambda b, i: i % side == side - 1))
        .select(*keys, "_b", "_coarse", "_parts", "_min", "_max")
    )
    passed = F.size(F.filter("_coarse", lambda b: b < v))
    fine = F.size(F.filter(F.slice("_b", passed * side + 1, side), lambda b: b < v))
    near, parts = F.col("_near"), F.col("_parts")
    low = F.coalesce(F.when(near > 0, F.get("_b", near - 1)), F.col("_min"))
    high = F.coalesce(F.get("_b", near), F.col("_max"))
    return (
        attach(df, bounds, keys, small=list(keys) == ["_all"])
        .withColumn("_near", (passed * side + fine).cast("int"))
        .withColumn(out, F.coalesce(near * parts + value_slot(v, low, high, parts), F.lit(-1)).cast("long"))
        .drop("_b", "_coarse", "_parts", "_min", "_max", "_near")
    )


def split_ties(df: DataFrame, keys: Sequence[str], value: str, tie: str, rows_per_bucket: int = 10_000) -> DataFrame:
    """Finer buckets where many rows of a key share one value; the rows' order by (value, tie) stays that of the buckets.

    Needs a BUCKET column that is monotone in `value`.  A value with more than `rows_per_bucket` rows is cut into equal steps of the
    numeric column `tie`, and its bucket into one part for each of its values; all other buckets stay whole.
    """
    groups = [*keys, BUCKET, value]
    t = F.col(tie).cast("double")
    hot = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.min(t).alias("_t0"), F.max(t).alias("_t1")).where(F.col("_n") > rows_per_bucket)
    mixed = hot.select(*keys, BUCKET).distinct().withColumn("_mixed", F.lit(True))
    placed = attach(attach(df, hot, groups, "left"), mixed, [*keys, BUCKET], "left")
    slot = F.when(F.col("_n").isNotNull(), value_slot(t, F.col("_t0"), F.col("_t1"), F.ceil(F.col("_n") / F.lit(rows_per_bucket)))).otherwise(F.lit(0).cast("long"))
    part = F.struct(F.col(BUCKET).alias("bucket"), F.when(F.col("_mixed"), F.col(value).cast("double")).alias("value"), slot.alias("slot"))
    return placed.withColumn(BUCKET, part).drop("_n", "_t0", "_t1", "_mixed")


def hash_bucket(df: DataFrame, hex_digest: str, digits: int = 4, out: str = BUCKET) -> DataFrame:
    """Leading hex digits of a digest: uniform and monotone in the digest's order; each digit more makes 16 times the buckets."""
    return df.withColumn(out, F.conv(F.substring(hex_digest, 1, digits), 16, 10).cast("long"))


def _bucket_window(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(BUCKET)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, Column]
) -> DataFrame:
    """Inclusive running sums over `order` within `keys`; needs a BUCKET column."""
    keyed = df if keys else df.withColumn("_all", F.lit(1))
    keys = list(keys) or ["_all"]
    inner = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(_FIRST, 0)
    before = _bucket_window(keys).rowsBetween(_FIRST, -1)
    totals = keyed.groupBy(*keys, BUCKET).agg(*[F.sum(c).alias(f"_tot_{n}") for n, c in sums.items()])
    offsets = totals.select(
        *keys, BUCKET, *[F.coalesce(F.sum(f"_tot_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums]
    )
    out = attach(keyed, offsets, [*keys, BUCKET])
    for n, c in sums.items():
        out = out.withColumn(n, F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(f"_off_{n}"))
    return out.drop("_all", *[f"_off_{n}" for n in sums])


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "rn", size_out: str | None = None
) -> DataFrame:
    """row_number() within `keys` (and optionally the key's size); needs a BUCKET column."""
    inner = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    totals = df.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    cols = [F.coalesce(F.sum("_n").over(_bucket_window(keys).rowsBetween(_FIRST, -1)), F.lit(0)).alias("_off")]
    if size_out:
        cols.append(F.sum("_n").over(Window.partitionBy(*keys)).alias(size_out))
    side = totals.select(*keys, BUCKET, *cols)
    return (
        attach(df, side, [*keys, BUCKET])
        .withColumn(out, (F.row_number().over(inner) + F.col("_off")).cast("long"))
        .drop("_off")
    )


def neighbour(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Mapping[str, str], direction: str = "previous"
) -> DataFrame:
    """lag(1) / lead(1) of columns across bucket borders; needs a BUCKET column."""
    previous = direction == "previous"
    pack = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    edge = F.max_by(pack, F.struct(*order)) if previous else F.min_by(pack, F.struct(*order))
    shift = F.lag if previous else F.lead
    summary = df.groupBy(*keys, BUCKET).agg(edge.alias("_edge"))
    carried = summary.select(*keys, BUCKET, shift("_edge").over(_bucket_window(keys)).alias("_carry"))
    inner = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    out = attach(df, carried, [*keys, BUCKET]).withColumn("_near", F.coalesce(shift(pack).over(inner), F.col("_carry")))
    for n in cols:
        out = out.withColumn(n, F.col(f"_near.{n}"))
    return out.drop("_near", "_carry")


def fill(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Mapping[str, str], direction: str = "forward"
) -> DataFrame:
    """Last (forward) or next (backward) non-null value at or around each row; needs BUCKET."""
    forward = direction == "forward"
    key = F.struct(*order)
    pick = F.max_by if forward else F.min_by
    base = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    inner = base.rowsBetween(_FIRST, 0) if forward else base.rowsBetween(0, _LAST)
    wb = _bucket_window(keys)
    outer = wb.rowsBetween(_FIRST, -1) if forward else wb.rowsBetween(1, _LAST)
    take = F.last if forward else F.first
    summary = df.groupBy(*keys, BUCKET).agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(f"_s_{n}") for n, c in cols.items()]
    )
    carried = summary.select(
        *keys, BUCKET, *[take(f"_s_{n}", ignorenulls=True).over(outer).alias(f"_c_{n}") for n in cols]
    )
    out = attach(df, carried, [*keys, BUCKET])
    for n, c in cols.items():
        out = out.withColumn(n, F.coalesce(take(c, ignorenulls=True).over(inner), F.col(f"_c_{n}")))
    return out.drop(*[f"_c_{n}" for n in cols])


def fill_both(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, before: str, after: str) -> DataFrame:
    """Last non-null value at or before and next one at or after each row, from one set of bucket summaries."""
    key = F.when(F.col(col).isNotNull(), F.struct(*order))
    base, wb = Window.partitionBy(*keys, BUCKET).orderBy(*order), _bucket_window(keys)
    carried = df.groupBy(*keys, BUCKET).agg(F.max_by(col, key).alias("_hi"), F.min_by(col, key).alias("_lo")).select(
        *keys, BUCKET,
        F.last("_hi", ignorenulls=True).over(wb.rowsBetween(_FIRST, -1)).alias("_cb"),
        F.first("_lo", ignorenulls=True).over(wb.rowsBetween(1, _LAST)).alias("_ca"),
    )
    return attach(df, carried, [*keys, BUCKET]).select(
        *df.columns,
        F.coalesce(F.last(col, ignorenulls=True).over(base.rowsBetween(_FIRST, 0)), F.col("_cb")).alias(before),
        F.coalesce(F.first(col, ignorenulls=True).over(base.rowsBetween(0, _LAST)), F.col("_ca")).alias(after),
    )


def run_lengths(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, out: str = "run", broken: str | None = None
) -> DataFrame:
    """Length of the run of true `flag` rows ending at each row; needs a BUCKET column.

    `broken`, if given, names an output telling whether any false row came before.
    """
    inner = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    upto = inner.rowsBetween(_FIRST, 0)
    marked = df.withColumn("_rn", F.row_number().over(inner)).withColumn(
        "_cut", F.max(F.when(~F.col(flag), F.col("_rn"))).over(upto)
    )
    summary = marked.groupBy(*keys, BUCKET).agg(
        F.max("_rn").alias("_n"), F.max("_cut").alias("_last_cut")
    ).withColumn("_tail", F.col("_n") - F.coalesce("_last_cut", F.lit(0)))
    wb = _bucket_window(keys)
    groups = summary.withColumn(
        "_grp", F.coalesce(F.sum(F.col("_last_cut").isNotNull().cast("int")).over(wb.rowsBetween(_FIRST, 0)), F.lit(0))
    )
    tails = groups.withColumn(
        "_open", F.sum("_tail").over(Window.partitionBy(*keys, "_grp").orderBy(BUCKET).rowsBetween(_FIRST, 0))
    )
    carried = tails.select(
        *keys,
        BUCKET,
        F.coalesce(F.lag("_open").over(wb), F.lit(0)).alias("_carry"),
        (F.coalesce(F.lag("_grp").over(wb), F.lit(0)) > 0).alias("_was_broken"),
    )
    res = attach(marked, carried, [*keys, BUCKET]).withColumn(
        out, F.when(F.col("_cut").isNull(), F.col("_rn") + F.col("_carry")).otherwise(F.col("_rn") - F.col("_cut"))
    )
    if broken:
        res = res.withColumn(broken, F.col("_was_broken") | F.col("_cut").isNotNull())
    return res.drop("_rn", "_cut", "_carry", "_was_broken")


def with_halo(df: DataFrame, t: str, width: float, halo: float) -> DataFrame:
    """Time buckets whose trailing `halo` is repeated in the following bucket(s).

    Trailing row frames that span at most `halo` on a regular grid can then be
    evaluated inside a bucket; keep the rows with `_core` afterwards.
    """
    own = F.floor(F.col(t) / F.lit(float(width)))
    upto = F.floor((F.col(t) + F.lit(float(halo))) / F.lit(float(width)))
    return df.withColumn(BUCKET, F.explode(F.sequence(own, upto))).withColumn("_core", F.col(BUCKET) == own)
