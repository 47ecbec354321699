"""Benchmark decontamination by spaced seeds.

A mask looks at some words of a span and ignores the others, so a hash under it survives substitutions at the
ignored words.  All positions of all documents are hashed under the masks and joined with the hashes of the test
items.  A hit fixes how document and item lie on each other; there, windows of `OVERLAP` words are compared word by
word, and one with `SAME` per cent of equal words or more is a leak.  DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import stage

OVERLAP = 13
SAME = 80
#: Masks by the width of the windows compared: positions looked at. Wherever in such a window the substitutions that
#: SAME allows lie (2 from 10 words on, else 1), one mask has a place in it that meets none of them.
MASKS = {
    13: ((0, 1, 2, 3, 5, 6, 7), (0, 1, 2, 3, 5, 7, 8), (0, 1, 4, 7, 8, 9, 10)),
    12: ((0, 1, 2, 3, 5, 6, 7), (0, 3, 4, 5, 6, 7, 8), (0, 1, 2, 4, 7, 8, 9), (0, 1, 3, 4, 5, 7, 10)),
    11: ((0, 1, 2, 3, 5, 6), (0, 1, 5, 6, 7, 8), (0, 1, 3, 4, 8, 9)),
    10: ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 1, 2, 5, 6)),
    9: ((0, 1, 2, 3, 4, 5, 6), (0, 1, 2, 3, 4, 5, 7), (0, 1, 2, 3, 5, 6, 7), (0, 1, 3, 4, 5, 6, 7)),
    8: ((0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 5, 6)),
    7: ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 3, 4, 5)),
    6: ((0, 1, 2, 3), (0, 1, 3, 4)),
    5: ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)),
}
#: Items of fewer words are no evidence and never match.
MIN_WORDS = 5
#: Hashes of the items up to this number (24 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_HASHES = 2_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits, in lower case."""
    inner = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(inner == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(inner, r"[^\p{L}\p{N}]+"), lambda x: F.xxhash64(x)))


def _exploded(rows: DataFrame, keep: list[str], widths: list[int]) -> DataFrame:
    """(keep, at, seed) for each position and each mask of `widths` that fits there, in one pass over the words."""
    masks = [(w * 16 + k, m) for w in widths for k, m in enumerate(MASKS[w])]
    h, size = F.col("h"), F.size("h")

    def at(i: Column) -> Column:
        return F.array(*[F.when(i + m[-1] < size, F.xxhash64(F.lit(n), *[F.get(h, i + p) for p in m])) for n, m in masks])

    seeds = F.flatten(F.transform(F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>")), at))
    rows = rows.select(*keep, F.posexplode(seeds).alias("k", "seed")).where("seed is not null")
    return rows.select(*keep, F.floor(F.col("k") / len(masks)).cast("int").alias("at"), "seed")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_same, n_words, start_word): the best overlap of each document and test item that it leaks.

    `docs`: doc_id, text; `items`: item_id, text.  n_words: words of the item, n_same: equal words over its whole length,
    start_word: where its first word lies in the document (negative if cut off).  Null or empty texts leak nothing, items
    of fewer than `MIN_WORDS` words are never leaked, those of fewer than `OVERLAP` words are compared as a whole.  Rows that share a doc_id are one document; rows without doc_id or item_id
    are left out.  Other columns are not read.  Empty tables give no rows.
    """
    items = items.where("item_id is not null").select("item_id", word_hashes(F.col("text")).alias("h")).withColumn("n_words", F.size("h")).where(F.col("n_words") >= MIN_WORDS)
    items = items.withColumn("width", F.least(F.lit(OVERLAP), F.col("n_words")))
    widths = sorted(r[0] for r in items.select("width").distinct().collect()) or [OVERLAP]
    seeds = reduce(DataFrame.union, [_exploded(items.where(F.col("width") == w), ["item_id"], [w]) for w in widths])
    seeds = seeds.withColumnRenamed("at", "item_at").distinct()
    if seeds.count() <= BROADCAST_HASHES:
        seeds = F.broadcast(seeds)
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    hashed = docs.select("doc_id", "mark", word_hashes(F.col("text")).alias("h"))
    hits = _exploded(hashed, ["doc_id", "mark"], widths).join(seeds, "seed")
    hits = stage(hits.select("doc_id", "mark", "item_id", (F.col("at") - F.col("item_at")).alias("start")).distinct(), "seed-hits")
    rows = hits.join(items.drop("width").withColumnRenamed("h", "item"), "item_id").join(docs, ["doc_id", "mark"])
    part = F.slice(word_hashes(F.col("text")), F.greatest(F.col("start"), F.lit(0)) + 1, F.col("n_words"))
    # Staged, so that no lambda below works a text's words out again for each of them.
    rows = stage(rows.select("doc_id", "item_id", "start", "n_words", "item", part.alias("part")), "overlaps")

    def same(k: Column) -> Column:
        at = k + F.least(F.col("start"), F.lit(0))
        return F.when((at >= 0) & (F.get("part", F.when(at >= 0, at)) == F.get("item", k)), 1).otherwise(0)

    width = F.least(F.lit(OVERLAP), F.col("n_words"))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(0).alias("all"))

    def slide(a: Column, k: Column) -> Column:
        now = a["now"] + same(k) - F.when(k >= width, same(k - width)).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["best"], now).alias("best"), (a["all"] + same(k)).alias("all"))

    found = rows.select("doc_id", "item_id", "start", "n_words", width.alias("width"), F.aggregate(F.sequence(F.lit(0), F.col("n_words") - 1), zero, slide).alias("x"))
    found = found.select("doc_id", "item_id", "start", "n_words", "width", F.col("x.best").alias("best"), F.col("x.all").alias("n_same"))
    found = found.where(100 * F.col("best") >= SAME * F.col("width"))
    top = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_same", (-F.col("start")).alias("back"), "n_words")).alias("x"))
    return top.select("doc_id", "item_id", F.col("x.n_same").cast("long").alias("n_same"), F.col("x.n_words").cast("long").alias("n_words"), (-F.col("x.back")).cast("long").alias("start_word"))
