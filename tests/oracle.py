"""Side-by-side run of a registered query and its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v).lower())
    if isinstance(v, float):
        return (2, repr(v))
    return (2, repr(float(v))) if not isinstance(v, (str, bytes)) and hasattr(v, "__float__") and not isinstance(v, int) else (
        (3, str(v)) if not isinstance(v, int) else (4, str(v))
    )


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(_cell(r[i]) for i in order) for r in rows])


def compare(spark_df, con, sql) -> tuple[bool, str]:
    cols, got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    ocols, want = canonical([c[0] for c in cur.description], cur.fetchall())
    if cols != ocols:
        return False, f"columns {cols} != {ocols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, e.g.\n  {[x[1] for x in bad[0][0]]}\n  {[x[1] for x in bad[0][1]]}\n  cols {cols}"
    return True, f"{len(got)} rows"
