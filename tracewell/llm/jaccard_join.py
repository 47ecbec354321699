"""Near duplicates: Jaccard self-join of word-shingle sets with adaptive multi-match prefixes.

A set's tokens get one order for the whole corpus: ordinary tokens by falling length and hash, then frequent
ones by document frequency.  Two sets of n and m tokens that link share at least t = ceil((n + m) * num / (num + den))
of them, so their prefixes of n - t + l and m - t + l tokens share at least l, for every l.  Each document indexes
its prefix of n - ceil(n * num / den) + l tokens for the l of lowest estimated cost (postings to read plus candidates
to verify, from the document frequencies of its own prefix tokens), up to `MAX_MATCHES`.  A pair of documents uses
the smaller l of the two, with the prefixes of n - t + l and m - t + l tokens that its sizes ask for, and is verified only
if they share that many tokens.  (The largest l that both whole prefixes allow asks for more matches, but then
each pair of a group of loose copies meets in all its common tokens.)

Posting lists of more than `SHORT_LIST` documents (groups of copies, common passages) are never turned
into all pairs.  First every document is compared with the list's smallest document of like size; the
links found merge documents into classes.  Then only documents of different classes are
paired, by the tokens that could be the first of the l they share; the others are counted for these pairs.  This
finds every link that could still merge two classes.  Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import components, key_ranges, pack_plain, pack_sorted, range_slices, scratch, stage, unpack_plain, unpack_sorted
from tracewell.llm.text import shingle_sets

#: From this many documents on a token's frequency is looked up; lower ones order by hash alone.
FREQUENT = 32
#: Most frequent tokens sent to every task (16 bytes each); beyond it the least frequent of them order by hash.
MOST_FREQUENT = 1 << 18
#: Largest number of shared prefix tokens that a document may ask for.
MAX_MATCHES = 4
#: Cost of verifying a candidate, in posting entries read.
VERIFY_COST = 8.0
#: Longest posting list that is paired at once.
SHORT_LIST = 8
#: Words of 64 bits in the filter of documents whose texts are moved; beyond, it only lets more texts through.
FILTER_WORDS = 1 << 19
#: Members that one copy of a pivot's text serves when candidates are verified.
PIVOT_FANOUT = 128


class Similarity(NamedTuple):
    num: int = 75
    den: int = 100
    words: int = 5

    def least(self, n):
        """Smallest overlap that a set of n tokens needs with any set it links to."""
        return -(-n * self.num // self.den)

    def overlap(self, n, m):
        """Smallest overlap of two sets of n and m tokens that link."""
        return -(-(n + m) * self.num // (self.num + self.den))


_COUNT = "r long, kind int, a long, b long, keys binary"
_LIST = "kind int, a long, b long, c int, d int, e int"


def _count_map(batches: Iterator[pa.RecordBatch], ranges: int, width: int) -> Iterator[pa.RecordBatch]:
    """Each batch's tokens (48 bits) by key range; each document's set size under a negative range."""
    for batch in batches:
        sets = list(shingle_sets(batch.column(1), width))
        if not sets:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        sizes = np.array([len(s) for s in sets], np.int64)
        keys = np.sort(np.concatenate(sets) << np.uint64(8))
        r, cut = range_slices(keys, ranges)
        blobs = [pack_sorted(keys[i:j] >> np.uint64(16)) for i, j in zip(cut[:-1], cut[1:], strict=True)] if len(keys) else []
        n, m = len(blobs), len(ids)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[r[:n], -1 - (ids.astype(np.int64) % ranges)], pa.int64()),
                pa.array(np.r_[np.zeros(n, np.int32), np.ones(m, np.int32)], pa.int32()),
                pa.array(np.r_[np.zeros(n, np.int64), ids], pa.int64()), pa.array(np.r_[np.zeros(n, np.int64), sizes], pa.int64()),
                pa.array(blobs + [None] * m, pa.binary()),
            ],
            names=["r", "kind", "a", "b", "keys"],
        )


def _count_reduce(table: pa.Table) -> pa.Table:
    """Frequent tokens of a key range (a: token, b: documents); sizes pass through."""
    names = ["kind", "a", "b"]
    if table.column("kind")[0].as_py() == 1:
        return table.select(names)
    keys = np.sort(np.concatenate([unpack_sorted(x.as_py()) for x in table.column("keys")]))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    n = np.diff(np.r_[first, len(keys)])
    hot = n >= FREQUENT
    return pa.table([pa.array(np.zeros(hot.sum(), np.int32)), pa.array(keys[first][hot].astype(np.int64)), pa.array(n[hot])], names=names)


def pick_prefix(tokens: np.ndarray, keys: np.ndarray, freq: np.ndarray, sim: Similarity) -> np.ndarray:
    """Prefix tokens in corpus order."""
    n = len(tokens)
    extra = n - sim.least(n)
    df = np.zeros(n, np.int64)
    if len(keys):
        k = (tokens << np.uint64(8)) >> np.uint64(16)
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        df = np.where(keys[at] == k, freq[at], 0)
        if df.any():
            order = np.lexsort((tokens, df))
            tokens, df = tokens[order], df[order]
    most = min(MAX_MATCHES, n - extra)
    cost = np.cumsum(np.maximum(df[: extra + most], 1))[extra:]
    ell = np.arange(1, most + 1)
    best = int(np.argmin(cost * (1.0 + VERIFY_COST / ell))) + 1
    return tokens[: extra + best]


def _list_map(batches: Iterator[pa.RecordBatch], ranges: int, sim: Similarity, hot) -> Iterator[pa.RecordBatch]:
    keys, freq = hot.value
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        toks, docs, sizes, place, length = [], [], [], [], []
        for i, s in zip(ids, shingle_sets(batch.column(1), sim.words), strict=True):
            if not len(s):
                continue
            p = pick_prefix(s, keys, freq, sim)
            toks.append(p)
            docs.append(np.full(len(p), i, np.int64))
            sizes.append(np.full(len(p), len(s), np.uint32))
            place.append(np.arange(len(p), dtype=np.uint32))
            length.append(np.full(len(p), len(p), np.uint32))
        if not toks:
            continue
        t = np.concatenate(toks) << np.uint64(8)
        r = (((t >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(r, kind="stable")
        r, t = r[order], t[order]
        d, s, v, e = (np.concatenate(x)[order] for x in (docs, sizes, place, length))
        cut = np.r_[0, np.flatnonzero(np.diff(r)) + 1, len(r)]
        rows = [(int(r[i]), pack_plain(t[i:j] >> np.uint64(16)), pack_plain(np.diff(d[i:j], prepend=0)), pack_plain(s[i:j]), pack_plain(v[i:j]), pack_plain(e[i:j])) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["r", "t", "d", "s", "v", "p"])


def _fits(small: np.ndarray, large: np.ndarray, sim: Similarity) -> np.ndarray:
    return np.minimum(small, large).astype(np.int64) * sim.den >= np.maximum(small, large).astype(np.int64) * sim.num


def _list_reduce(table: pa.Table, sim: Similarity) -> pa.Table:
    """Posting lists of a key range.

    kind 0: pair a < b of short lists, c shared tokens here, d matches needed;
    kind 1: document b of a long list and its pivot a;
    kind 2: entry of a long list: token a, document b, set size c, place in the prefix d, length of the prefix e.
    """
    cols = [np.concatenate([unpack_plain(x.as_py(), t) for x in table.column(c)]) for c, t in (("t", np.uint64), ("s", np.uint32), ("v", np.uint32), ("p", np.uint32))]
    d = np.concatenate([np.cumsum(unpack_plain(x.as_py(), np.int64)) for x in table.column("d")])
    order = np.lexsort((d, cols[0]))
    t, (s, at, pre), d = cols[0][order], (c[order].astype(np.int64) for c in cols[1:]), d[order]
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    size = np.diff(np.r_[first, len(t)])
    two = [(first[size == m][:, None] + np.array([[i, j]])) for m in range(2, SHORT_LIST + 1) for i in range(m) for j in range(i + 1, m)]
    two = np.concatenate(two)
    x, y = two[:, 0], two[:, 1]
    over = sim.overlap(s[x], s[y])
    ell = pre - s + sim.least(s)
    need = np.minimum(ell[x], ell[y])
    ok = (d[x] != d[y]) & (at[x] < s[x] - over + need) & (at[y] < s[y] - over + need) & _fits(s[x], s[y], sim)
    pairs = pd.DataFrame({"a": d[x[ok]], "b": d[y[ok]], "d": need[ok]}).groupby(["a", "b"], as_index=False).agg(c=("d", "size"), d=("d", "min"))
    entry = np.repeat(size > SHORT_LIST, size)
    t, s, at, pre, d = t[entry], s[entry], at[entry], pre[entry], d[entry]
    band = np.floor(np.log(np.maximum(s, 1)) / np.log(sim.den / sim.num)).astype(np.int64)
    order = np.lexsort((d, band, t))
    to, bo, do = t[order], band[order], d[order]
    lead = np.r_[True, (to[1:] != to[:-1]) | (bo[1:] != bo[:-1])] if len(to) else np.empty(0, bool)
    star = pd.DataFrame({"a": do[lead][np.cumsum(lead) - 1] if len(to) else do, "b": do}).query("a != b").drop_duplicates()
    out = pd.concat([
        pairs.assign(kind=0, e=0), star.assign(kind=1, c=0, d=0, e=0),
        pd.DataFrame({"kind": 2, "a": t.astype(np.int64), "b": d, "c": s, "d": at, "e": pre}),
    ])
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int32()), ("d", pa.int32()), ("e", pa.int32())])
    return pa.Table.from_pandas(out[schema.names], schema=schema, preserve_index=False)


def _verify(batches: Iterator[pa.RecordBatch], sim: Similarity) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, part, role): a pivot's texts, then the documents to compare with it."""
    key, pivots = None, []
    for batch in batches:
        a, part, role, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "part", "role", "b"))
        hit = np.zeros(len(a), bool)
        for i, s in enumerate(shingle_sets(batch.column("text"), sim.words)):
            if (a[i], part[i]) != key:
                key, pivots = (a[i], part[i]), []
            if role[i] == 0:
                pivots.append(s)
                continue
            for p in pivots:
                if len(p) and len(s) and not hit[i]:
                    both = int((p[np.minimum(np.searchsorted(p, s), len(p) - 1)] == s).sum())
                    hit[i] = both * sim.den >= sim.num * (len(p) + len(s) - both)
        yield pa.RecordBatch.from_arrays([pa.array(a[hit], pa.int64()), pa.array(b[hit], pa.int64())], names=["a", "b"])


def _holding(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id is among `ids` (doc_id), and a few others: a broadcast bit for each hash, so that most other texts stay where they are."""
    bits = lambda df: df.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_WORDS * 64))).withColumns(
        {"word": F.shiftright("h", 6), "bit": F.expr("shiftleft(1L, cast(h & 63 as int))")}
    )
    words = bits(ids).groupBy("word").agg(F.bit_or("bit").alias("held"))
    return bits(docs).join(F.broadcast(words), "word").where(F.col("held").bitwiseAND(F.col("bit")) != 0).select(docs.columns)


def _linked(pairs: DataFrame, docs: DataFrame, sim: Similarity) -> DataFrame:
    """Those of the staged pairs (a, b) whose texts link; a pivot of many pairs is copied once for `PIVOT_FANOUT` of them."""
    texts = _holding(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(PIVOT_FANOUT)).alias("parts"))
    dealt = pairs.join(fan, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    t = texts.select(F.col("doc_id").alias("b"), "text")
    members = dealt.join(t, "b").select("a", "part", F.lit(1).alias("role"), "b", "text")
    leads = fan.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("b"))
    rows = members.union(leads.join(t, "b").select("a", "part", "role", "b", "text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "a", "part").sortWithinPartitions("a", "part", "role")
    return rows.mapInArrow(lambda it: _verify(it, sim), "a long, b long")


def near_duplicates(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text).

    Words are runs of anything but ASCII white space, A-Z folded.  A null, empty or blank text has no
    shingle and links with nothing, also not with another such text.  Rows that share a doc_id
    are one document with several texts: a link of any of them counts, each row keeps its own n_shingles.
    Rows whose doc_id is null are given back with a null component.  Other columns are not read.
    """
    spark = docs.sparkSession
    ranges = key_ranges(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = docs.where("doc_id is not null")
    with scratch(spark) as keep:
        counted = whole.mapInArrow(lambda it: _count_map(it, ranges, sim.words), _COUNT)
        counted = stage(counted.groupBy("r").applyInArrow(_count_reduce, "kind int, a long, b long"), "shingle-counts")
        hot = _frequent(counted.where("kind = 0"))
        lists = whole.mapInArrow(lambda it: _list_map(it, ranges, sim, hot), "r long, t binary, d binary, s binary, v binary, p binary")
        lists = stage(lists.groupBy("r").applyInArrow(lambda t: _list_reduce(t, sim), _LIST), "shingle-lists")
        pairs, stars, entries = (lists.where(F.col("kind") == k) for k in range(3))
        stars = stage(stars.select("a", "b").distinct(), "stars")
        first = stage(_linked(stars, whole, sim), "links")
        classes = components(first)
        second = _linked(stage(_across(pairs, entries, classes, sim), "candidates"), whole, sim)
        # A class counts as its star from here on.
        final = components(classes.select(F.col("component").alias("a"), F.col("id").alias("b")).union(second))
        size = counted.where("kind = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
        out = size.join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        out = keep(out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "near-duplicates")
    nameless = docs.where("doc_id is null").mapInArrow(lambda it: _sizes(it, sim.words), "doc_id long, n_shingles long, component_id long")
    return out.union(nameless)


def _outside(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """Entries of the lists that hold several classes: t, doc, n, at, pre, k (class), main (largest class of the list)."""
    of = classes.withColumnRenamed("component", "k")
    e = entries.select(F.col("a").alias("t"), F.col("b").alias("doc"), F.col("c").alias("n"), F.col("d").alias("at"), F.col("e").alias("pre"))
    e = e.join(of, e.doc == of.id, "left").select("t", "doc", "n", "at", "pre", F.coalesce("k", "doc").alias("k"))
    per = e.groupBy("t", "k").agg(F.count(F.lit(1)).alias("m"))
    main = per.groupBy("t").agg(F.max_by("k", F.struct("m", "k")).alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    return e.join(main.select("t", "main"), "t")


def _sizes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.array([len(s) for s in shingle_sets(batch.column(1), width)], np.int64)
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(n), none], names=["doc_id", "n_shingles", "component_id"])


def _frequent(counts: DataFrame):
    """Broadcast of the frequent tokens and their document frequencies, bounded by `MOST_FREQUENT`."""
    steps = counts.groupBy(F.floor(F.log2("b")).cast("int").alias("p")).count().orderBy(F.desc("p")).collect()
    least, n = 1 << 62, 0
    for p, more in steps:
        if n + more > MOST_FREQUENT:
            break
        least, n = 1 << p, n + more
    rows = counts.where(F.col("b") >= least).select("a", "b").toPandas().sort_values("a")
    return counts.sparkSession.sparkContext.broadcast((rows["a"].to_numpy(np.uint64), rows["b"].to_numpy(np.int64)))


def _across(pairs: DataFrame, entries: DataFrame, classes: DataFrame, sim: Similarity) -> DataFrame:
    """Candidate pairs of documents in different classes that share enough prefix tokens.

    The first of l tokens that two documents share in their prefixes of n - t + l and m - t + l tokens lies within the first
    n - t + 1 and m - t + 1.  So the lists pair documents by these rarer tokens only; the other tokens are counted for such pairs alone.
    """
    of = classes.withColumnRenamed("component", "k")
    e = stage(_outside(entries, classes), "outside")
    x = e.where("k <> main").select("t", *[F.col(c).alias(f"x_{c}") for c in ("doc", "n", "at", "pre", "k")])
    y = e.select("t", (F.col("k") == F.col("main")).alias("lead"), *[F.col(c).alias(f"y_{c}") for c in ("doc", "n", "at", "pre", "k")])
    over = F.ceil((F.col("x_n") + F.col("y_n")) * F.lit(sim.num) / F.lit(sim.num + sim.den))
    ell = [F.col(f"{c}_pre") - F.col(f"{c}_n") + F.ceil(F.col(f"{c}_n") * F.lit(sim.num) / F.lit(sim.den)) for c in "xy"]
    need = F.least(*ell).cast("int")
    seeds = x.join(y, "t").where(
        (F.col("x_k") != F.col("y_k")) & (F.col("lead") | (F.col("x_doc") < F.col("y_doc")))
        & (F.col("x_at") <= F.col("x_n") - over) & (F.col("y_at") <= F.col("y_n") - over)
        & (F.least("x_n", "y_n") * sim.den >= F.greatest("x_n", "y_n") * sim.num)
    )
    seeds = seeds.select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b"), F.lit(0).cast("long").alias("c"), need.alias("d"))
    every = seeds.union(pairs.select("a", "b", F.col("c").cast("long"), "d"))
    some = every.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("d").alias("d"))
    left, right = (of.select(F.col("id").alias(c), F.col("k").alias(f"k{c}")) for c in "ab")
    some = some.join(left, "a", "left").join(right, "b", "left")
    some = stage(some.where(F.coalesce("ka", "a") != F.coalesce("kb", "b")).select("a", "b", "c", "d"), "seeds")
    held = e.groupBy("doc").agg(F.collect_set("t").alias("ts"))
    left, right = (held.select(F.col("doc").alias(c), F.col("ts").alias(f"t{c}")) for c in "ab")
    rest = some.where("c < d").join(left, "a").join(right, "b").where(F.col("c") + F.size(F.array_intersect("ta", "tb")) >= F.col("d"))
    return some.where("c >= d").select("a", "b").union(rest.select("a", "b"))
