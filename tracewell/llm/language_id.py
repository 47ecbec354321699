"""Language by rank-order profiles: out-of-place distance between n-gram rankings.

A profile is a ranking of the most frequent character n-grams (1 to 3 letters, words padded with `_`).
A language's profile counts the n-grams of all its labelled documents.  A document's profile is
compared with each of them: every n-gram adds the distance between its two ranks, or `RANKS` if the language
does not rank it.  The nearest language wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANKS = 400
UNKNOWN = "und"
_GAP = re.compile(r"[\W\d_]+")
_PAD = np.uint64(ord("_"))
#: Letters counted at once in training; bounds a task's memory.
_RUN = 1 << 20


def _letters(text: str) -> str:
    """Words in lower case between `_`; empty if there is no letter."""
    words = _GAP.sub("_", text.lower())
    return f"_{words}_" if any(c.isalpha() for c in set(words)) else ""


def grams(padded: str) -> np.ndarray:
    """The n-grams of a padded text as numbers: up to three code points of 21 bits."""
    c = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    b = np.uint64(21)
    two = (c[:-1] << b) | c[1:]
    three = (two[:-1] << b) | c[2:]
    two = two[(c[:-1] != _PAD) | (c[1:] != _PAD)]
    return np.concatenate([c[c != _PAD], two, three[c[1:-1] != _PAD]])


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts), return_counts=True)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a task by language."""
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}
    done: dict[str, dict] = {}

    def fold(lang: str) -> None:
        keys, n = _counted(held.pop(lang))
        have = done.setdefault(lang, {"k": np.empty(0, np.uint64), "n": np.empty(0, np.int64)})
        k = np.concatenate([have["k"], keys])
        u, at = np.unique(k, return_inverse=True)
        have["n"] = np.bincount(at, np.concatenate([have["n"], n]), len(u)).astype(np.int64)
        have["k"] = u
        sizes[lang] = 0

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if p := _letters(text):
                g = grams(p)
                held.setdefault(lang, []).append(g)
                sizes[lang] = sizes.get(lang, 0) + len(g)
                if sizes[lang] > _RUN:
                    fold(lang)
    for lang in list(held):
        fold(lang)
    for lang, x in done.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x["k"])), pa.array(x["k"].astype(np.int64)), pa.array(x["n"])], names=["lang", "gram", "n"])


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Ranked n-grams of each language, from (text, lang) of rows where neither is null.  Bounded by languages x `RANKS`."""
    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    counts = rows.mapInArrow(_train, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= RANKS).toPandas().sort_values(["lang", "rank"])
    return {lang: g["gram"].to_numpy().astype(np.uint64) for lang, g in top.groupby("lang")}


class Profiles:
    """Rank tables of all languages over the union of their n-grams."""

    def __init__(self, ranked: dict[str, np.ndarray]):
        self.langs = sorted(ranked)
        self.keys = np.unique(np.concatenate([ranked[k] for k in self.langs])) if ranked else np.empty(0, np.uint64)
        self.rank = np.full((len(self.langs), len(self.keys) + 1), -1, np.int32)
        for i, k in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.keys, ranked[k])] = np.arange(len(ranked[k]))

    def predict(self, text: str | None) -> tuple[str, float]:
        padded = _letters(text) if text and self.langs else ""
        if not padded:
            return UNKNOWN, 0.0
        keys, n = _counted([grams(padded)])
        own = keys[np.lexsort((keys, -n))[:RANKS]]
        at = np.searchsorted(self.keys, own)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != own] = len(self.keys)
        theirs = self.rank[:, at]
        out = np.where(theirs < 0, RANKS, np.abs(theirs - np.arange(len(own))))
        d = out.mean(axis=1) / RANKS
        order = np.argsort(d, kind="stable")
        second = d[order[1]] if len(d) > 1 else 1.0
        return self.langs[order[0]], float(np.clip(1 - d[order[0]] / second, 0, 1)) if second > 0 else 0.0


def _predict(batches: Iterator[pa.RecordBatch], profiles) -> Iterator[pa.RecordBatch]:
    p = profiles.value
    for batch in batches:
        got = [p.predict(t) for t in batch.column("text").to_pylist()]
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*keep, "lang_pred", "score"])


def identify(docs: DataFrame, ranked: dict[str, np.ndarray]) -> DataFrame:
    """All columns of `docs` but text, with lang_pred and score (0 to 1: how much nearer than the second language).

    `und` and 0 where the text is null or has no letter, or where no language was learned.  Every row is judged by
    its own text, so copies and repeated rows get equal answers; ties of distance go to the first name in order.
    Columns of `docs` named lang_pred or score are replaced.
    """
    from pyspark.sql.types import DoubleType, StringType, StructType

    docs = docs.drop("lang_pred", "score")
    schema = StructType([f for f in docs.schema if f.name != "text"]).add("lang_pred", StringType()).add("score", DoubleType())
    sent = docs.sparkSession.sparkContext.broadcast(Profiles(ranked))
    return docs.mapInArrow(lambda it: _predict(it, sent), schema)
