"""The thin registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import (
    collocations, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, packing, periodic_runs, quality, sharding,
    suffix_dedup, token_files, toxicity,
)
from tracewell.llm.shared import labelled, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, d, "documents").select("doc_id", "text"))


def op2_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, d, "documents"), _table(spark, d, "benchmark"))


def op3_lexical_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents").select("doc_id", "text"), end_id=1)


def _remainder(m: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % m


def op4_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text", "lang")
    ranked = language_id.learn(docs.where(_remainder(4) != 2))
    return language_id.identify(docs.select("doc_id", (_remainder(4) == 2).alias("held_out"), "text"), ranked)


def op5_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = suffix_dedup.repeated_spans(_table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_token_files(spark: SparkSession, d: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    token_files.write(_table(spark, d, "documents").select("doc_id", "text"), folder, end_id=2)
    return token_files.read(spark, folder)


def op7_sharding(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text")
    out = sharding.shard_by_bytes(docs, 8)
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text")
    labels = labelled(_table(spark, d, "labels").where(_remainder(3) != 1).select("doc_id", "toxic"), "toxic")
    insults = toxicity.learn_insults(docs.join(labels, "doc_id"))
    weighed = stage(toxicity.clause_weights(docs, insults).select("doc_id", "clause_weight"), "weighed")
    rates = toxicity.calibrate(weighed.join(labels, "doc_id"))
    score = toxicity.probability(F.col("clause_weight"), rates)
    out = weighed.select("doc_id", (_remainder(3) == 1).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op9_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.fit(quality.with_trust(docs, _table(spark, d, "labels")))).drop("text")


def op10_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = line_dedup.deduplicate_lines(_table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op10_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.*, s.owner IS NOT NULL AND s.owner <> k.doc_id AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op11_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.group_copies(_table(spark, d, "documents"))


ORACLES["op11_exact_dedup"] = r"""
WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM plain WINDOW same AS (PARTITION BY t)
"""


def _with_planted_period(doc_id: Column, text: Column) -> Column:
    """Every tenth text (by crc32 of its id) repeats a few of its words from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def again(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    spelled = F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0))
    return F.when(h % 10 == 0, F.get(F.transform(spelled, lambda w: F.when(F.size(w) > 0, again(w)).otherwise("")), 0)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", _with_planted_period(F.col("doc_id"), F.col("text")).alias("text"))
    out = periodic_runs.periodic_runs(docs)
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda x, r: F.when(r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    out = out.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations.collocations(_table(spark, d, "documents").select("lang", "text"), top=2000)


ORACLES["op13_collocations"] = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS id, lang, words FROM (
    SELECT lang, regexp_extract_all(unnest(string_split_regex(folded, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM documents)
  ) WHERE len(words) > 0
), words AS (
  SELECT id, lang, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM pieces
), near AS (
  SELECT lang, w AS x, lead(w) OVER piece AS y, lead(w, 2) OVER piece AS z FROM words WINDOW piece AS (PARTITION BY id ORDER BY i)
), one AS (SELECT lang, x, count(*) AS f FROM near GROUP BY ALL
), two AS (SELECT lang, x, y, count(*) AS f FROM near WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), three AS (SELECT lang, x, y, z, count(*) AS f FROM near WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), n AS (SELECT lang, count(*) AS n FROM words GROUP BY lang
), cuts AS (
  SELECT t.lang, t.x, t.y, NULL AS z, t.x || ' ' || t.y AS phrase, t.f AS a, 1 AS k, p.f AS l, q.f AS r
  FROM two t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN one q ON q.lang = t.lang AND q.x = t.y
  UNION ALL
  SELECT t.lang, t.x, t.y, t.z, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, p.f, q.f
  FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
  UNION ALL
  SELECT t.lang, t.x, t.y, t.z, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, p.f, q.f
  FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z
), scored AS (
  SELECT *, CAST(1000000 * a::HUGEINT * a::HUGEINT // (l::HUGEINT * r::HUGEINT) AS BIGINT) AS score FROM cuts
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
  SELECT lang, x, y, max(f) AS most FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL
), left_over AS (
  SELECT c.* FROM lowest c LEFT JOIN held h ON c.z IS NULL AND h.lang = c.lang AND h.x = c.x AND h.y = c.y
  WHERE h.most IS NULL OR 100 * h.most < 50 * c.a
)
SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score
FROM left_over c JOIN n ON n.lang = c.lang QUALIFY rank <= 2000
"""


QUERIES |= {f.__name__: f for f in (op1_jaccard_join, op2_decontamination, op3_lexical_packing, op4_language_id, op5_suffix_dedup, op6_token_files, op7_sharding, op8_toxicity, op9_quality_rules, op10_line_dedup, op11_exact_dedup, op12_periodic_runs, op13_collocations)}
