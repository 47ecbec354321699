"""Quality rules: hashed n-gram log-likelihood ratio between trusted texts and the raw corpus.

Two multinomials over `BUCKETS` hashed n-grams (words, pairs of words, last three characters of a
word) are counted: one over the trusted texts, one over all texts.  A document's score is the mean log ratio of its
n-grams, so length does not matter; every document at or over `THRESHOLD` is kept.  Base rules (too few words, too many
repeated words) come first.  DataFrame functions only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import labelled

BLANK = r"[\x20\x09-\x0D]"
BUCKETS = 1 << 15
#: Added to every bucket's count, times the share of the corpus in a bucket of average size.
SMOOTH = 1.0
THRESHOLD = -0.6
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of the words
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK + "+"))


def _bucket(x: Column) -> Column:
    return F.pmod(x, F.lit(BUCKETS)).cast("int")


def _ending(word: Column) -> Column:
    return F.xxhash64(F.substring(word, -3, 3), F.lit(3))


def _hashed(docs: DataFrame) -> DataFrame:
    """`docs` with words w, their hashes h, the hashes p of each word and the one before it, and n_words."""
    d = docs.withColumn("w", words(F.col("text")))
    d = d.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("n_words", F.size("w").cast("long"))
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("h", 1, F.greatest(F.size("h") - 1, F.lit(0))))
    return d.withColumn("p", F.when(F.col("n_words") > 0, F.zip_with(before, "h", lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>")))


def counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, good) over all texts of `docs` (text, trusted): n-grams, and those of trusted texts."""
    buckets = F.concat(F.transform("h", _bucket), F.transform("p", _bucket), F.transform("w", lambda x: _bucket(_ending(x))))
    grams = _hashed(docs.select("text", F.coalesce("trusted", F.lit(False)).cast("int").alias("good"))).select("good", F.explode(buckets).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good"))


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of `docs` with `trusted`: the labelled documents of good quality, as many as `shared.labelled` takes."""
    good = labelled(labels.where("quality = 1").select("doc_id", F.lit(True).alias("trusted")), "trusted")
    return docs.select("doc_id", "text").join(good, "doc_id", "left")


def fit(corpus: DataFrame) -> np.ndarray:
    """Log ratios by bucket in thousandths from rows (text, trusted): `BUCKETS` numbers, whatever the corpus.

    Both multinomials are counted in one pass.  A null in trusted means no; without trusted texts all ratios are 0.
    """
    n = np.zeros((2, BUCKETS))
    for bucket, raw, good in counts(corpus).collect():  # at most one row for each bucket
        n[:, bucket] = raw, good
    if not n[1].sum():
        return np.zeros(BUCKETS, np.int32)
    share = np.log((n + SMOOTH) / (n.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS))
    return np.round(1000 * (share[1] - share[0])).astype(np.int32)


def _repeated(h: str) -> tuple[Column, Column, Column]:
    """Hashes of the windows, from the pairs in them; their order by hash where some repeat; words covered by repeated windows."""
    last = F.size(h) - WINDOW
    runs = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get("p", i + 1), F.get("p", i + 3), F.get(F.col(h), i + 4)))).otherwise(F.array().cast("array<bigint>"))
    order = F.when(F.size(F.array_distinct("runs")) < F.size("runs"), F.sort_array(F.transform("runs", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    same = F.filter("order", lambda e, k: (e["x"] == F.get("order", k + 1)["x"]) | (F.when(k > 0, F.get("order", k - 1)["x"]) == e["x"]))
    at = F.sort_array(F.transform(same, lambda e: e["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    n = F.aggregate(at, zero, lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - i)).alias("n")), lambda a: a["n"])
    return runs, order, F.coalesce(n, F.lit(0).cast("long"))


def judge(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Columns of `docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio and kept.

    A null or empty text has no words: it fails the base rules.  Rows are judged one by one, so copies and repeated
    rows get the same verdict.  Columns of `docs` with these names are replaced.  An empty table gives no rows.
    Write the result before filtering by it: the optimizer would move the filter into the expressions over words.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"]
    docs = docs.drop(*made)
    row = docs.select(F.struct(*docs.columns).alias("row"), "text")  # so that no column meets one made here
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    d = _hashed(row)
    runs, order, n_repeat = _repeated("h")
    table = F.lit(ratios)
    added = lambda c, of: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.get(table, _bucket(of(x))))
    g = (added("h", lambda x: x) + added("p", lambda x: x) + added("w", _ending)) / 1000.0
    d = d.withColumns({
        "runs": runs, "ratio": F.when(F.col("n_words") > 0, g / (3 * F.col("n_words"))).otherwise(F.lit(0.0)),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"), "_lines": lines,
    }).drop("w", "h", "p")
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    d = d.withColumn("order", order).drop("runs").withColumn("n_repeat_words", n_repeat).drop("order")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    d = d.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= THRESHOLD))
    return d.select("row.*", *made)
