"""Corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return
the columns of `documents`.  Null, empty and very long texts, repeated rows and empty tables are handled by the operators.
SQL can not express the packing, so `ORACLE_SQL` is None; the stages are tested one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from tracewell.llm.shared import stage

END_ID = 1
#: Parts into which the copies of one text are dealt.
SALTS = 16


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio to the trusted ones (labels.quality = 1)."""
    ratios = quality.fit(quality.with_trust(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    # Staged: a filter moved below the verdict's columns would work out a text's words again for each of them.
    judged = stage(quality.judge(docs.select(F.struct(*docs.columns).alias("doc"), "text"), ratios).select("doc", "kept"), "judged")
    return judged.where("kept").select("doc.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a smaller document holds; n_chars follows.

    A document that keeps no word of its own this way goes if a smaller one has the same whole text.  Else it stays with
    its whole text, since the documents that hold its lines may go later.
    """
    out = line_dedup.deduplicate_lines(docs).withColumn("_digest", F.sha2(F.col("text").cast("binary"), 256))
    out = out.withColumn("_emptied", (F.col("n_dropped") > 0) & ~F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    out = stage(out.withColumn("_salt", F.when(F.col("_emptied"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))), "lines")
    # Only digests of emptied rows are joined, salted as one text may have many copies.
    first = out.where("doc_id is not null").groupBy("_digest").agg(F.min("doc_id").alias("_first"), F.max("_emptied").alias("_any")).where("_any")
    first = first.select("_digest", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    emptied = out.where("_emptied").join(first, ["_digest", "_salt"]).where("doc_id = _first")
    out = out.where("not _emptied").withColumn("text", F.col("kept_text")).select(*docs.columns).unionByName(emptied.select(*docs.columns))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each class of near duplicates."""
    classes = jaccard_join.near_duplicates(docs)
    return docs.join(classes.where("component_id <> doc_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    leaks = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of token ids."""
    return packing.pack(docs, end_id=END_ID)


STAGES = [
    ("quality", keep_good), ("line dedup", drop_lines), ("near duplicates", one_of_each_group),
    ("decontamination", without_leaks), ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
