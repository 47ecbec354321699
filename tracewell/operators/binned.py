"""Regression trees over binned features, grown from sums for each cell of bins.

A tree whose thresholds come from a fixed set cannot part two rows of the same cell (one bin of each feature).  So the rows enter once, as
sums for each cell, and what is grown, sent or kept is bounded by the number of cells and does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut_lineage

BINS = 32  # bins of a feature, as in MLlib
MAX_CELLS = 1 << 18  # cells of all features together that are taken; 32,768 for three features
ROWS_PER_TASK = 1 << 15
CHUNK = 2_048  # rows whose draws are held at once


@dataclass(frozen=True)
class Bins:
    """Thresholds of each feature; a value belongs to the first bin whose threshold it does not exceed."""

    edges: tuple[tuple[float, ...], ...]

    @property
    def dims(self) -> tuple[int, ...]:
        return tuple(len(e) + 1 for e in self.edges)

    @property
    def cells(self) -> int:
        return int(np.prod(self.dims))

    def bin(self, x: Column, j: int) -> Column:
        v = F.get(x, F.lit(j))
        return sum(((v > F.lit(e)).cast("int") for e in self.edges[j]), F.lit(0))

    def cell(self, x: Column) -> Column:
        out = F.lit(0).cast("long")
        for j, n in enumerate(self.dims):
            out = out * n + self.bin(x, j)
        return out

    def of_cells(self, cells: np.ndarray) -> np.ndarray:
        return np.stack(np.unravel_index(cells, self.dims), axis=1)


def fit_bins(df: DataFrame, x: str = "x") -> Bins | None:
    """All values but the largest of a feature with few values, else quantiles of all rows; None if there are more than MAX_CELLS cells."""
    p = (df.agg(F.max(F.size(x))).first()[0]) or 0
    if not p or p > np.log(MAX_CELLS) / np.log(2):
        return None
    cols = df.select(*[F.get(x, F.lit(j)).cast("double").alias(f"f{j}") for j in range(p)])
    names = cols.columns
    rare = cols.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first()
    found = cols.approxQuantile(names, [k / BINS for k in range(1, BINS)], 1e-3)
    edges = []
    for name, quantiles in zip(names, found, strict=True):
        if rare[name] <= 2 * BINS:
            values = sorted(r[0] for r in cols.select(name).distinct().limit(4 * BINS).collect())
            quantiles = values[:-1] if len(values) <= BINS else quantiles
        edges.append(tuple(sorted(set(quantiles))))
    bins = Bins(tuple(edges))
    return bins if bins.cells <= MAX_CELLS else None


# ---------------------------------------------------------------- forest

_SUMS = "tree int, cell array<long>, n array<double>, s array<double>"
_TREE = "tree int, feature array<int>, bin array<int>, left array<int>, value array<double>"


def _poisson() -> np.ndarray:
    """Poisson draws with mean 1 by a number of 16 bits."""
    tail = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 12)]))
    return np.searchsorted(tail, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _drawn(trees: int, mean: float, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in the order of their cells -> for each tree the number and the sum of the rows that it draws, by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, table = np.random.default_rng([seed, TaskContext.get().partitionId()]), _poisson()
        cells, counts, sums = np.empty(0, np.int64), np.empty((0, trees)), np.empty((0, trees))

        def out(m: int) -> pa.RecordBatch:
            lists = [pa.array([a[:m]] * trees if a.ndim == 1 else list(a[:m].T), t) for a, t in ((cells, pa.list_(pa.int64())), (counts, pa.list_(pa.float64())), (sums, pa.list_(pa.float64())))]
            return pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), *lists], names=["tree", "cell", "n", "s"])

        for batch in batches:
            all_cells, all_y = batch.column(0).to_numpy(), batch.column(1).to_numpy() - mean
            for at in range(0, len(all_cells), CHUNK):
                cell, y = all_cells[at : at + CHUNK], all_y[at : at + CHUNK, None]
                drawn = table[rng.integers(0, 1 << 16, (len(cell), trees), np.uint16)].astype(np.float64)
                starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                cell, n = cell[starts], np.add.reduceat(drawn, starts)
                s = np.add.reduceat(np.multiply(drawn, y, out=drawn), starts)
                if len(cells) and cells[-1] == cell[0]:
                    counts[-1] += n[0]
                    sums[-1] += s[0]
                    cell, n, s = cell[1:], n[1:], s[1:]
                cells, counts, sums = np.r_[cells, cell], np.r_[counts, n], np.r_[sums, s]
                if len(cells) > CHUNK:
                    yield out(len(cells) - 1)
                    cells, counts, sums = cells[-1:], counts[-1:], sums[-1:]
        if len(cells):
            yield out(len(cells))

    return run


def grow(at: np.ndarray, n: np.ndarray, s: np.ndarray, dims: Sequence[int], depth: int, leaf: int, subset: int, rng: np.random.Generator) -> tuple[list, list, list, list]:
    """One tree, level by level: features (-1 for a leaf), bins of which the smaller ones go left, left children (right ones follow) and means.

    Cells have bins `at`, drawn rows `n` and their sum `s`.  A split has the largest fall of the squared error; each side keeps `leaf` rows.
    """
    features, cuts, lefts, values = [], [], [], []
    node, k = np.zeros(len(n), np.int64), 1
    for level in range(depth + 1):
        total, mass = np.bincount(node, n, k), np.bincount(node, s, k)
        best, feature, cut = np.full(k, -np.inf), np.full(k, -1), np.zeros(k, np.int64)
        asked = rng.random((k, len(dims))).argsort(1).argsort(1) < subset
        for j, d in enumerate(dims) if level < depth else ():
            if d < 2:
                continue
            slot = node * d + at[:, j]
            nl = np.bincount(slot, n, k * d).reshape(k, d)[:, :-1].cumsum(1)
            sl = np.bincount(slot, s, k * d).reshape(k, d)[:, :-1].cumsum(1)
            nr, sr = total[:, None] - nl, mass[:, None] - sl
            fits = (nl >= leaf) & (nr >= leaf) & asked[:, j : j + 1]
            score = np.where(fits, sl * sl / np.maximum(nl, 1) + sr * sr / np.maximum(nr, 1), -np.inf)
            where = score.argmax(1)
            top = score[np.arange(k), where]
            better = top > best
            best[better], feature[better], cut[better] = top[better], j, where[better]
        whole = mass * mass / np.maximum(total, 1)
        split = best > whole + 1e-12 * np.abs(whole)
        first = sum(map(len, features)) + k  # number of the next level's first node
        left = np.where(split, first + 2 * (np.cumsum(split) - 1), -1)
        features.append(np.where(split, feature, -1))
        cuts.append(cut)
        lefts.append(left)
        values.append(mass / np.maximum(total, 1))
        if not split.any():
            break
        goes = split[node]
        at, n, s, node = at[goes], n[goes], s[goes], node[goes]
        node = left[node] - first + (at[np.arange(len(at)), feature[node]] > cut[node])
        k = 2 * int(split.sum())
    return tuple(np.concatenate(part) for part in (features, cuts, lefts, values))


def _grower(bins: Bins, mean: float, depth: int, leaf: int, share: float, seed: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        cell, n, s = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("cell", "n", "s"))
        order = np.lexsort((s, cell))  # sums come out the same in whatever order the parts arrive
        used, place = np.unique(cell[order], return_inverse=True)
        n, s = np.bincount(place, n[order]), np.bincount(place, s[order])
        some = n > 0
        subset = max(1, int(np.ceil(share * len(bins.dims))))
        feature, cut, left, value = grow(bins.of_cells(used[some]), n[some], s[some], bins.dims, depth, leaf, subset, np.random.default_rng([seed, number, 1]))
        lists = [pa.array([a], t) for a, t in ((feature, pa.list_(pa.int32())), (cut, pa.list_(pa.int32())), (left, pa.list_(pa.int32())), (value + mean, pa.list_(pa.float64())))]
        return pa.Table.from_arrays([pa.array([number], pa.int32()), *lists], names=["tree", "feature", "bin", "left", "value"])

    return run


def _scores(bins: Bins):
    """Every cell's estimate by the trees of a batch, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = bins.of_cells(np.arange(bins.cells))
        total, trees = np.zeros(bins.cells), 0
        for batch in batches:
            for i in range(batch.num_rows):
                feature, cut, left, value = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("feature", "bin", "left", "value"))
                node, inner = np.zeros(bins.cells, np.int64), np.arange(bins.cells)
                while len(inner := inner[feature[node[inner]] >= 0]):
                    here = node[inner]
                    node[inner] = left[here] + (at[inner, feature[here]] > cut[here])
                total += value[node]
                trees += 1
        if trees:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(bins.cells)), pa.array(total), pa.array(np.full(bins.cells, trees))], names=["cell", "s", "n"])

    return run


@dataclass(frozen=True)
class BinnedForest:
    """Trees as rows, and the mean of their estimates for every cell."""

    bins: Bins
    trees: DataFrame
    scores: DataFrame

    def transform(self, df: DataFrame, features: str = "_features") -> DataFrame:
        cell = self.bins.cell(vector_to_array(features))
        return df.withColumn("_cell", cell).join(F.broadcast(self.scores.withColumnRenamed("cell", "_cell")), "_cell").drop("_cell")


def fit_forest(rows: DataFrame, bins: Bins, x: str, y: str, trees: int, seed: int, depth: int, leaf: int, share: float) -> BinnedForest:
    """Each tree draws all rows by a Poisson number; its cells meet in one task, which grows it."""
    placed = rows.select(bins.cell(F.col(x)).alias("cell"), F.col(y).cast("double").alias("y"))
    count, mean = placed.agg(F.count("y"), F.avg("y")).first()
    dealt = placed.repartitionByRange(max(1, -(-count // ROWS_PER_TASK)), "cell", "y").sortWithinPartitions("cell", "y")
    sums = dealt.mapInArrow(_drawn(trees, mean, seed), _SUMS).repartition(min(trees, 96), "tree")
    grown = cut_lineage(sums.groupBy("tree").applyInArrow(_grower(bins, mean, depth, leaf, share, seed), _TREE))
    scores = grown.mapInArrow(_scores(bins), "cell long, s double, n long").groupBy("cell").agg((F.sum("s") / F.sum("n")).alias("prediction"))
    return BinnedForest(bins, grown, cut_lineage(scores))


# ---------------------------------------------------------------- boosting


@dataclass(frozen=True)
class BinnedModel:
    """A model over the bins of the features."""

    bins: Bins
    model: object

    def transform(self, df: DataFrame, features: str = "_features") -> DataFrame:
        keep = [c for c in df.columns if c != features]
        x = vector_to_array(features)
        spots = F.array(*[self.bins.bin(x, j).cast("double") for j in range(len(self.bins.dims))])
        return self.model.transform(df.select(*keep, array_to_vector(spots).alias(features)))


def cell_means(rows: DataFrame, bins: Bins, x: str, y: str) -> DataFrame:
    """Bins, rows `n` and mean `y` of every cell that has rows."""
    spots = F.array(*[bins.bin(F.col(x), j).cast("double") for j in range(len(bins.dims))])
    return rows.groupBy(spots.alias("_bins")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col(y).cast("double")).alias(y))
