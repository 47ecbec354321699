"""Second moments in one pass, and the small matrices the driver derives from them.

Each task adds up X'X of its Arrow batches and emits one row; partial sums are added in two
levels on the executors.  The driver sees one p x p matrix (p up to a few hundred).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANIN = 256
_PART = "part long, n double, q double, g array<double>"


@dataclass(frozen=True)
class Moments:
    """n rows, sum of |x|^4, and X'X."""

    n: float
    quartic: float
    gram: np.ndarray


def vector(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, q, g = 0.0, 0.0, None
    part = 0
    for pdf in batches:
        if not len(pdf):
            continue
        part = int(pdf["part"].iloc[0])
        x = np.vstack(pdf["x"].to_numpy())
        n += len(x)
        q += float(np.square(np.square(x).sum(axis=1)).sum())
        g = x.T @ x if g is None else g + x.T @ x
    if g is not None:
        yield pd.DataFrame({"part": [part], "n": [n], "q": [q], "g": [g.ravel()]})


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    g = np.sum(np.vstack(pdf["g"].to_numpy()), axis=0)
    return pd.DataFrame({"part": [0], "n": [pdf["n"].sum()], "q": [pdf["q"].sum()], "g": [g]})


def gram_table(df: DataFrame, x: Column) -> DataFrame:
    """One row (n, sum |x|^4, flattened X'X), added up on the executors."""
    rows = df.select((F.spark_partition_id() % FANIN).cast("long").alias("part"), x.alias("x"))
    parts = rows.mapInPandas(_partial, _PART)
    level = parts.groupBy("part").applyInPandas(_combine, _PART)
    cells = level.select("n", "q", F.posexplode("g").alias("pos", "v"))
    return cells.groupBy("pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("q").alias("q"))


def fit_moments(df: DataFrame, x: Column) -> Moments:
    """Moments on the driver: p * p numbers."""
    rows = gram_table(df, x).orderBy("pos").collect()
    if not rows:
        raise ValueError("no rows to fit on")
    p = int(round(len(rows) ** 0.5))
    return Moments(rows[0]["n"], rows[0]["q"], np.array([r["v"] for r in rows]).reshape(p, p))


def fit_moments_by(df: DataFrame, key: str, x: Column) -> dict:
    """Moments per value of a label column (a few labels), all from one pass."""
    labels = df.schema[key].dataType.simpleString()
    keyed = f"key {labels}, {_PART}"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for k, rows in pdf.groupby("key"):
                v = np.vstack(rows["x"].to_numpy())
                n, q, g = sums.get(k, (0.0, 0.0, 0.0))
                sums[k] = (n + len(v), q + float(np.square(np.square(v).sum(axis=1)).sum()), g + v.T @ v)
            part = int(pdf["part"].iloc[0]) if len(pdf) else 0
        for k, (n, q, g) in sums.items():
            yield pd.DataFrame({"key": [k], "part": [part], "n": [n], "q": [q], "g": [g.ravel()]})

    def combine(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _combine(pdf).assign(key=group[0])[["key", "part", "n", "q", "g"]]

    rows = df.select(F.col(key).alias("key"), (F.spark_partition_id() % FANIN).cast("long").alias("part"), x.alias("x"))
    level = rows.mapInPandas(partial, keyed).groupBy("key", "part").applyInPandas(combine, keyed)
    cells = level.select("key", "n", "q", F.posexplode("g").alias("pos", "v")).groupBy("key", "pos").agg(
        F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("q").alias("q"))
    out: dict = {}
    for r in cells.orderBy("key", "pos").collect():
        out.setdefault(r["key"], (r["n"], r["q"], []))[2].append(r["v"])
    return {k: Moments(n, q, np.array(g).reshape(int(round(len(g) ** 0.5)), -1)) for k, (n, q, g) in out.items()}


@dataclass(frozen=True)
class ShrunkCovariance:
    covariance: np.ndarray
    precision: np.ndarray
    shrinkage: float


def ledoit_wolf(m: Moments) -> ShrunkCovariance:
    """Shrunk covariance of centred rows (Ledoit & Wolf 2004, closed form)."""
    p = m.gram.shape[0]
    s = m.gram / m.n
    mu = float(np.trace(s)) / p
    norm = float((s * s).sum())
    delta = (norm - 2 * mu * float(np.trace(s)) + p * mu * mu) / p
    beta = min((m.quartic / m.n - norm) / (p * m.n), delta)
    lam = 0.0 if delta <= 0 else max(beta, 0.0) / delta
    cov = (1 - lam) * s + lam * mu * np.eye(p)
    # two centred rows give no shrinkage and a singular matrix, hence the pseudo-inverse
    return ShrunkCovariance(cov, np.linalg.pinv(cov, hermitian=True), lam)


def principal_axes(m: Moments, share: float = 0.95) -> np.ndarray:
    """Leading eigenvectors (columns) that explain at least `share` of the variance of centred rows."""
    values, vectors = np.linalg.eigh(m.gram / m.n)
    order = np.argsort(values)[::-1]
    explained = np.cumsum(values[order]) / values.sum()
    k = int(np.searchsorted(explained, share - 1e-12) + 1)
    return vectors[:, order[:k]]


def ridge(m: Moments, alpha: float) -> np.ndarray:
    """Weights of the last column on the others, both centred: (X'X + alpha I)^-1 X'y."""
    xx, xy = m.gram[:-1, :-1], m.gram[:-1, -1]
    return np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)


def quadratic_form(x: Column, precision: np.ndarray) -> Column:
    """max(0, x' P x) for an array column; the p x p matrix travels with the function."""
    p = precision

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        v = np.vstack(s.to_numpy()) if len(s) else np.zeros((0, p.shape[0]))
        return pd.Series(np.maximum(np.einsum("ij,jk,ik->i", v, p, v), 0.0))

    return score(x)


def reconstruction_rmse(x: Column, axes: np.ndarray) -> Column:
    """Root mean square distance of an array column to its projection on `axes`."""
    a = axes

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        v = np.vstack(s.to_numpy()) if len(s) else np.zeros((0, a.shape[0]))
        return pd.Series(np.sqrt(np.square(v - v @ a @ a.T).mean(axis=1)))

    return score(x)
