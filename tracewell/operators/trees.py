"""Classification forests over binned features: each tree grows whole in one task that holds all train rows, one byte for each feature.

The tasks share the trees; the rows are dealt to each task once.  No node's statistics are moved, and neither trees nor rows reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.binned import BINS, _poisson
from tracewell.session import cut_lineage

TASKS = 24  # that share the trees of a forest; each holds all train rows
BLOCK = 1_024  # rows that are moved as one
CHUNK = 1 << 25  # bytes of binned rows that one task scores
SLOTS = 1 << 18  # bins of a level's nodes that are looked at together
NOISE = 1e-9  # share of a node's weight below which a fall of impurity counts as rounding

_TREES = "group int, tree int, feature binary, cut binary, sizes binary, classes binary, shares binary, importance array<double>"


def _keys(spark: SparkSession, n: int) -> list[int]:
    """A number for each of `n` hash partitions, so that no two groups share one."""
    found: dict[int, int] = {}
    start = 0
    while len(found) < n:
        ids = ", ".join(f"({i}L)" for i in range(start, start + 16 * n))
        start += 16 * n
        for r in spark.sql(f"SELECT id, pmod(hash(id), {n}) AS part FROM VALUES {ids} AS v(id)").collect():  # worked out on the driver, no job
            found.setdefault(r["part"], r["id"])
    return [found[i] for i in range(n)]


def _dealt(df: DataFrame, keys: Sequence[int], group) -> DataFrame:
    """Rows in the partition of their group."""
    table = F.array(*[F.lit(k).cast("long") for k in keys])
    return df.withColumn("key", F.get(table, group)).repartition(len(keys), "key")


# ---------------------------------------------------------------- rows


def _matrix(lists: pa.Array, p: int) -> np.ndarray:
    values = lists.flatten()
    if lists.null_count or not (np.asarray(lists.value_lengths()) == p).all():
        raise ValueError(f"a row has not {p} features")
    if values.null_count:
        raise ValueError("a feature is null")
    return values.to_numpy(zero_copy_only=False).reshape(-1, p)


def _columns(p: int):
    """Rows -> the values of each feature as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.ascontiguousarray(_matrix(batch.column("x"), p).T)
            yield pa.RecordBatch.from_arrays([pa.array(range(p), pa.int32()), pa.array([v.tobytes() for v in values], pa.binary())], names=["j", "v"])

    return run


def _cutter(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Thresholds of a feature: all values but the largest of one with few, else its quantiles."""
    out = []
    for j in sorted(set(table.column("j").to_pylist())):
        mine = [np.frombuffer(v.as_buffer()) for i, v in zip(table.column("j").to_pylist(), table.column("v"), strict=True) if i == j]
        values = np.sort(np.concatenate(mine))
        values = values[: len(values) - np.isnan(values).sum()]
        edges = np.unique(values)
        if len(edges) > BINS:
            edges = np.unique(np.r_[values[len(values) * np.arange(1, BINS) // BINS], edges[-1]])
        out.append((j, edges[:-1].tolist()))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.list_(pa.float64())), strict=True)], names=["j", "edges"])


def feature_edges(rows: DataFrame, p: int) -> tuple[tuple[float, ...], ...]:
    """Thresholds of the `p` features of x from all rows; a value belongs to the first bin whose threshold it does not exceed."""
    keys = _keys(rows.sparkSession, min(TASKS, p))
    values = _dealt(rows.select("x").mapInArrow(_columns(p), "j int, v binary"), keys, F.col("j") % len(keys))
    found = {r["j"]: r["edges"] for r in values.groupBy("key").applyInArrow(_cutter, "j int, edges array<double>").collect()}  # p lists of numbers
    return tuple(tuple(found[j]) for j in range(p))


def _binned(edges: Sequence[Sequence[float]], others: Sequence[tuple[str, str]]):
    """Rows -> blocks of their bins, one byte for each feature, with the other columns as bytes."""
    edges = [np.array(e) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("x"), len(edges))
            bins = np.empty(values.shape, np.uint8)
            for j, e in enumerate(edges):
                bins[:, j] = np.searchsorted(e, values[:, j])  # NaN comes last
            columns = []
            for name, kind in others:
                if batch.column(name).null_count:
                    raise ValueError(f"a row has no {name}")
                columns.append(batch.column(name).to_numpy(zero_copy_only=False).astype(kind))
            cuts = range(0, batch.num_rows, BLOCK)
            arrays = [pa.array([a[i : i + BLOCK].tobytes() for i in cuts], pa.binary()) for a in (bins, *columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=["bins", *[name for name, _ in others]])

    return run


def _blocks(rows: DataFrame, edges, others: Sequence[tuple[str, str]]) -> DataFrame:
    names = [name for name, _ in others]
    return rows.select("x", *names).mapInArrow(_binned(edges, others), ", ".join(f"{c} binary" for c in ("bins", *names)))


# ---------------------------------------------------------------- growing


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and the places they come from, equal ones in their order."""
    bits = int(len(key)).bit_length()
    both = np.sort(key.astype(np.int64) << bits | np.arange(len(key)))
    return both >> bits, both & ((1 << bits) - 1)


def _starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])


def _chosen(nodes: int, p: int, subset: int, rng: np.random.Generator) -> np.ndarray:
    """`subset` different features for each node."""
    if subset >= p:
        return np.broadcast_to(np.arange(p), (nodes, p))
    return np.concatenate([rng.random((min(BLOCK, nodes - i), p), np.float32).argpartition(subset - 1, 1)[:, :subset].astype(np.int16) for i in range(0, nodes, BLOCK)])


def best_splits(x, at, node, y, n, w, total, count, chosen, width: int, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the best of its chosen features' splits: weight times purity, feature (-1 for none) and the last bin that goes left.

    Rows `at` of `x` lie in the order of node and class, drawn `n` times with weight `w` (the same array without weights).  With few nodes, the
    sums of all classes are held for all bins.  Else the rows of each class are sorted by bin, and each adds to its bin's sum of squares what its
    class has before it.
    """
    m, (k, classes), p = len(at), total.shape, x.shape[1]
    flat, row = x.ravel(), at * p
    mass, square = total.sum(1), (total * total).sum(1)
    best, feature, cut = np.full(k, -np.inf), np.full(k, -1), np.zeros(k, np.int64)
    dense = k * width * classes <= 2 * m

    def upto(slot: np.ndarray, v: np.ndarray, size: tuple[int, ...]) -> np.ndarray:
        """Sums of the bins up to each but the last."""
        h = np.bincount(slot, v, width * k * (classes if len(size) > 2 else 1)).reshape(size)
        for i in range(1, width - 1):
            h[i] += h[i - 1]
        return h[:-1]

    if not dense:
        group = node * classes + y
        first = _starts(group)
        begin = np.repeat(first, np.diff(np.r_[first, m]))
        own, base, plain = w * total[node, y], group * width, w is n
        kind = np.int32 if k * classes * width < 1 << 27 else np.int64
        key = (base << 4 | n.astype(np.int64)).astype(kind) if plain else base
    for s in range(chosen.shape[1]):
        asked = chosen[:, s].astype(np.int64)
        b = flat[row + asked[node]]
        slot = b * np.int64(k) + node
        if dense:
            h = upto(slot * classes + y, w, (width, k, classes))
            r = total - h
            wl, left, right = h.sum(2), np.einsum("bkc,bkc->bk", h, h), np.einsum("bkc,bkc->bk", r, r)
        else:
            if plain:  # draws fit four bits
                both = np.sort(key + (b.astype(kind) << 4))
                placed, wo = both >> 4, (both & 15).astype(np.float64)
            else:
                placed, o = _ranked(key + b)
                wo = w[o]
            before = np.cumsum(wo) - wo
            before -= before[begin]
            wl, left = upto(slot, w, (width, k)), upto((placed - base) * k + node, wo * (2 * before + wo), (width, k))
            right = square - 2 * upto(slot, own, (width, k)) + left
        nl = wl if w is n else upto(slot, n, (width, k))
        wr = mass - wl
        with np.errstate(divide="ignore", invalid="ignore"):
            score = (left * wr + right * wl) / (wl * wr)
        np.copyto(score, -np.inf, where=(np.minimum(nl, count - nl) < leaf) | ~(wl * wr > 0))
        where = score.argmax(0)
        top = score[where, np.arange(k)]
        better = top > best
        best[better], feature[better], cut[better] = top[better], asked[better], where[better]
    return best, feature, cut


def _in_parts(x, at, node, y, n, w, total, count, chosen, width: int, leaf: int) -> tuple[np.ndarray, ...]:
    """`best_splits` for at most SLOTS bins of nodes at once."""
    step = max(1, SLOTS // width)
    if len(total) <= step:
        return best_splits(x, at, node, y, n, w, total, count, chosen, width, leaf)
    parts = []
    for i in range(0, len(total), step):
        rows = slice(*np.searchsorted(node, [i, i + step]))
        own = n[rows]
        parts.append(best_splits(x, at[rows], node[rows] - i, y[rows], own, own if w is n else w[rows], total[i : i + step], count[i : i + step], chosen[i : i + step], width, leaf))
    return tuple(np.concatenate(part) for part in zip(*parts, strict=True))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None, classes: int, width: int, depth: int, leaf: int, subset: int, rng: np.random.Generator):
    """One tree, level by level: features (-1 for a leaf), bins of which the smaller ones go left, sums of the classes, and what each split gains.

    Every row is drawn by a Poisson number.  Children follow their parents in order: those of the i-th split are the nodes 2i + 1 and 2i + 2.  As in
    MLlib, a split whose two leaves have the same class is taken back.
    """
    drawn = _poisson()[rng.integers(0, 1 << 16, len(y), np.uint16)]
    at = np.flatnonzero(drawn)
    at = at[np.argsort(y[at], kind="stable")]
    n, y, x = drawn[at].astype(np.float64), y[at].astype(np.int64), x[at]
    w = n if weight is None else n * weight[at]
    at, node, k = np.arange(len(y)), np.zeros(len(y), np.int64), 1
    levels, features, cuts, sums, gains = [], [], [], [], []
    for level in range(depth + 1):
        total, count = np.bincount(node * classes + y, w, k * classes).reshape(k, classes), np.bincount(node, n, k)
        mass, square = total.sum(1), (total * total).sum(1)
        feature, cut, gain = np.full(k, -1), np.zeros(k, np.int64), np.zeros(k)
        mixed = (count >= 2 * leaf) & (mass * mass - square > NOISE * mass * mass) & (level < depth)
        if mixed.any():
            goes = mixed[node]
            at, node, y, n, w = at[goes], (np.cumsum(mixed) - 1)[node[goes]], y[goes], (kept := n[goes]), kept if w is n else w[goes]
            chosen = _chosen(int(mixed.sum()), x.shape[1], subset, rng)
            best, f, c = _in_parts(x, at, node, y, n, w, total[mixed], count[mixed], chosen, width, leaf)
            fall = best - square[mixed] / mass[mixed]
            split = fall > NOISE * mass[mixed]
            feature[mixed], cut[mixed], gain[mixed] = np.where(split, f, -1), np.where(split, c, 0), np.where(split, fall, 0.0)
        levels.append(k)
        for parts, part in ((features, feature), (cuts, cut), (sums, total), (gains, gain)):
            parts.append(part)
        if not (feature >= 0).any():
            break
        goes = split[node]
        at, node, y, n, w = at[goes], node[goes], y[goes], (kept := n[goes]), kept if w is n else w[goes]
        node = 2 * (np.cumsum(split) - 1)[node] + (x[at, f[node]] > c[node])
        _, o = _ranked(node * classes + y)
        at, node, y, n, w = at[o], node[o], y[o], (kept := n[o]), kept if w is n else w[o]
        k = 2 * int(split.sum())
    feature, cut, total, gain = (np.concatenate(parts) for parts in (features, cuts, sums, gains))
    inner = feature >= 0
    left = np.where(inner, 2 * np.cumsum(inner) - 1, 0)
    guess, ends = total.argmax(1), np.cumsum(levels)
    for end, size in zip(ends[::-1], levels[::-1], strict=True):
        i = end - size + np.flatnonzero(inner[end - size : end])
        a = left[i]
        inner[i[~inner[a] & ~inner[a + 1] & (guess[a] == guess[a + 1])]] = False
    alive = np.zeros(len(inner), bool)
    alive[0] = True
    alive[left[inner]] = alive[left[inner] + 1] = True
    return np.where(inner, feature, -1)[alive], cut[alive], total[alive], np.where(inner, gain, 0.0)[alive]


def _grower(groups: dict[int, int], trees: int, classes: int, width: int, p: int, depth: int, leaf: int, subset: int, weighted: bool, seed: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = groups[key[0].as_py()]
        join = lambda c, kind: np.concatenate([np.frombuffer(v.as_buffer(), kind) for chunk in table.column(c).chunks for v in chunk])
        x, y, weight = join("bins", np.uint8).reshape(-1, p), join("y", np.int32), join("w", np.float64) if weighted else None
        del table
        # The order of the rows is that of their content, so that what is grown again comes out the same, however the rows arrive.
        bytes_ = np.concatenate([x, y.astype(">i4")[:, None].view(np.uint8), *([weight[:, None].view(np.uint8)] if weighted else [])], axis=1)
        order = np.argsort(np.ascontiguousarray(bytes_).view(f"S{bytes_.shape[1]}").ravel(), kind="stable")
        del bytes_
        x, y, weight = x[order], y[order], weight[order] if weighted else None
        out = []
        for tree in range(group, trees, len(groups)):
            feature, cut, total, gain = grow(x, y, weight, classes, width, depth, leaf, subset, np.random.default_rng([seed, tree]))
            inner = feature >= 0
            importance = np.bincount(feature[inner], gain[inner], p)
            shares = total[~inner] / np.maximum(total[~inner].sum(1, keepdims=True), 1e-300)
            shares = np.rint(shares * (1 << 24)) / (1 << 24)  # sums of these are exact, whatever their order
            rows, cols = np.nonzero(shares)
            blobs = [a.tobytes() for a in (
                feature.astype(np.int16), cut.astype(np.uint8), np.bincount(rows, minlength=len(shares)).astype(np.uint16), cols.astype(np.uint16), shares[rows, cols].astype(np.float32))]
            out.append((group, tree, *blobs, (importance / (importance.sum() or 1.0)).tolist()))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.float64())]
        names = ["group", "tree", "feature", "cut", "sizes", "classes", "shares", "importance"]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


# ---------------------------------------------------------------- scoring


def score(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, sizes: np.ndarray, classes: np.ndarray, shares: np.ndarray, total: np.ndarray) -> None:
    """Adds the shares of each row's leaf to `total`."""
    inner = feature >= 0
    left, number = 2 * np.cumsum(inner) - 1, np.cumsum(~inner) - 1
    leaves = np.zeros((len(sizes), total.shape[1]), np.float32)
    leaves[np.repeat(np.arange(len(sizes)), sizes), classes] = shares
    node, on = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(on := on[inner[node[on]]]):
        here = node[on]
        node[on] = left[here] + (x[on, feature[here]] > cut[here])
    total += leaves[number[node]]


def _scorer(p: int, classes: int):
    kinds = (np.int16, np.uint8, np.uint16, np.uint16, np.float32)

    def run(blocks: pa.Table, trees: pa.Table) -> pa.Table:
        forest = [[np.frombuffer(trees.column(c)[i].as_buffer(), kind) for c, kind in zip(("feature", "cut", "sizes", "classes", "shares"), kinds, strict=True)] for i in range(trees.num_rows)]
        rows, sums = [np.empty(0, np.int64)], [np.empty((0, classes))]
        for bins, row in zip(blocks.column("bins"), blocks.column("row"), strict=True):
            x = np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, p)
            rows.append(np.frombuffer(row.as_buffer(), np.int64))
            total = np.zeros((len(x), classes))
            for tree in forest:
                score(x, *tree, total)
            sums.append(total)
        s = np.concatenate(sums)
        return pa.Table.from_arrays([pa.array(np.concatenate(rows)), *[pa.array(np.ascontiguousarray(s[:, k])) for k in range(classes)]], names=["row", *[f"s{k}" for k in range(classes)]])

    return run


@dataclass(frozen=True)
class Trees:
    """A forest as rows, one for each tree."""

    edges: tuple[tuple[float, ...], ...]
    classes: int
    count: int
    trees: DataFrame

    def probabilities(self, df: DataFrame, x: str, out: str) -> DataFrame:
        """Mean of the trees' class shares; every group of trees scores all rows, which then meet by their number."""
        spark, keep = df.sparkSession, df.columns
        staged = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
        groups = min(TASKS, self.count)
        chunks = max(1, -(-staged.count() * len(self.edges) // CHUNK))
        keys = _keys(spark, groups * chunks)
        every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        blocks = _blocks(staged.select(F.col(x).alias("x"), F.col("_row").alias("row")), self.edges, [("row", "int64")])
        blocks = blocks.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")).select("*", every(groups, "group"))
        place = F.col("group") * chunks + F.col("chunk")
        trees = self.trees.drop("importance").select("*", every(chunks, "chunk"))
        scored = _dealt(blocks, keys, place).groupBy("key").cogroup(_dealt(trees, keys, place).groupBy("key")).applyInArrow(
            _scorer(len(self.edges), self.classes), ", ".join(["row long", *[f"s{k} double" for k in range(self.classes)]]))
        sums = scored.groupBy(F.col("row").alias("_row")).agg(F.array(*[F.sum(f"s{k}") / F.lit(float(self.count)) for k in range(self.classes)]).alias(out))
        return staged.join(sums, "_row").select(*keep, out)

    def importances(self) -> np.ndarray:
        """Mean over the trees of each feature's share of all falls of impurity."""
        mean = np.mean([r["importance"] for r in self.trees.select("tree", "importance").orderBy("tree").collect()], axis=0)  # one list for each tree
        return mean / (mean.sum() or 1.0)

    def release(self) -> None:
        self.trees.unpersist()


def fit_forest(rows: DataFrame, p: int, classes: int, trees: int, seed: int, depth: int, leaf: int, weighted: bool) -> Trees:
    """Forest of `rows` (x of `p` features, y as a number from 0 to `classes` - 1 and, if weighted, w); a node looks at the root of `p`, rounded up."""
    edges = feature_edges(rows, p)
    width, groups = max(len(e) for e in edges) + 1, min(TASKS, trees)
    keys = _keys(rows.sparkSession, groups)
    # Cut off from whatever is cached: Spark plans a cached frame anew, and grows all trees again, if one that its plan holds leaves the cache.
    blocks = cut_lineage(_blocks(rows, edges, [("y", "int32"), *([("w", "float64")] if weighted else [])]))
    dealt = _dealt(blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")), keys, F.col("group"))
    grower = _grower({k: i for i, k in enumerate(keys)}, trees, classes, width, p, depth, leaf, int(np.ceil(np.sqrt(p))), weighted, seed)
    # Kept without a copy on shared storage: what an executor loses is grown again and comes out the same.
    forest = Trees(edges, classes, trees, dealt.drop("group").groupBy("key").applyInArrow(grower, _TREES).persist())
    forest.trees.count()
    return forest
