"""SPL: deterministic splits and cohorts."""

from pyspark.sql import functions as F

from tracewell.operators import align, splits
from tracewell.plans import bindings as b
from tracewell.plans.bindings import define_cte, sql
from tracewell.plans.registry import query
from tracewell.plans.sections.joins import strict_rows
from tracewell.plans.sections.windows import ID

SEEDS = list(range(20260921, 20260931))


@query("spl_01_interleaved_mod10", sql("cls", """
  SELECT sample_id, class, CASE WHEN n < 3 THEN 'train' WHEN p % 10 = 0 THEN 'test' WHEN p % 10 = 1 THEN 'validation' ELSE 'train' END AS partition FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY class ORDER BY sample_id) - 1 AS p, count(*) OVER (PARTITION BY class) AS n FROM cls) z"""))
def spl_01(spark, d):
    return splits.interleaved(b.cls(spark, d), ["class"], ID)


@query("spl_02_interleaved_mod5", sql("sev", """
  SELECT sample_id, class, severity, CASE p % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS partition FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY class ORDER BY sample_id) - 1 AS p FROM sev) z"""))
def spl_02(spark, d):
    return splits.interleaved(b.sev(spark, d), ["class"], ID, 5, min_size=1)


@query("spl_03_contiguous_folds", sql("sev", """
  SELECT sample_id, class, severity, fold, CASE WHEN (severity - 1)//20 = fold THEN 'test' ELSE 'train' END AS partition FROM sev CROSS JOIN range(0,5) k(fold)"""))
def spl_03(spark, d):
    return splits.contiguous_folds(b.sev(spark, d), "severity", 20, 5).withColumn("fold", F.col("fold").cast("long"))


define_cte("rep", ["sev"], f"""
  SELECT sample_id, class, seed, CASE WHEN k < nt THEN 'test' WHEN k < 2*nt THEN 'validation' ELSE 'train' END AS partition, 'seed_' || seed AS split_id FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY seed, class ORDER BY sha256(seed || '|' || sample_id), sample_id) - 1 AS k,
           greatest(1, CAST(round_even(0.2*count(*) OVER (PARTITION BY seed, class), 0) AS BIGINT)) AS nt FROM sev CROSS JOIN (VALUES {", ".join(f"({s})" for s in SEEDS)}) v(seed)) z""")


@query("spl_04_repeated_stratified", sql("rep", "SELECT * FROM rep"))
def spl_04(spark, d):
    who = b.table(spark, d, "customer").select(F.col("c_custkey").alias(ID), F.col("c_mktsegment").alias("class"))
    return splits.repeated_stratified(who, "class", ID, SEEDS)


define_cte("blk", ["sev"], """
  SELECT split_id, sample_id, class, severity, CASE WHEN k >= s AND k < s + tc THEN 'test' WHEN k = s - 1 OR k = s + tc THEN 'gap_excluded'
      WHEN (CASE WHEN k < s THEN k ELSE k - tc - g1 - g2 END) >= av - vc THEN 'validation' ELSE 'train' END AS partition FROM (
    SELECT *, n - tc - g1 - g2 AS av, greatest(1, CAST(round_even(0.2*(n - tc - g1 - g2), 0) AS BIGINT)) AS vc FROM (
      SELECT *, CASE WHEN s - 1 >= 0 THEN 1 ELSE 0 END AS g1, CASE WHEN s + tc < n THEN 1 ELSE 0 END AS g2 FROM (
        SELECT *, CASE split_id WHEN 'low_block' THEN 0 WHEN 'high_block' THEN n - tc ELSE greatest(0, (n - tc)//2) END AS s FROM (
          SELECT v.split_id, sev.*, severity - 1 AS k, count(*) OVER w AS n, greatest(1, (count(*) OVER w + 4)//5) AS tc
          FROM sev CROSS JOIN (VALUES ('low_block'),('middle_block'),('high_block')) v(split_id) WINDOW w AS (PARTITION BY class, split_id)) a) b0) c) d0
  WHERE n >= 6 AND av - vc >= 1""")


@query("spl_05_severity_blocked", sql("blk", "SELECT *, 'severity_blocked' AS split_type FROM blk"))
def spl_05(spark, d):
    return splits.severity_blocked(b.sev(spark, d), "class", "severity", ID)


@query("spl_06_severity_extrapolation", sql("ext", "SELECT *, 'severity_extrapolation' AS split_type FROM ext"))
def spl_06(spark, d):
    return splits.extrapolation(b.sev(spark, d), "class", "severity", ID)


define_cte("release", ["rep"], """
  SELECT sample_id, class, partition, 'locked_release_test' AS release_partition FROM rep WHERE seed = 20260921 AND partition = 'test'
  UNION ALL SELECT sample_id, class, partition, CASE WHEN k < cal THEN 'calibration' WHEN k < cal + val THEN 'development_validation' ELSE 'development_train' END FROM (
    SELECT *, CASE WHEN n >= 3 THEN greatest(1, CAST(round_even(0.2*n, 0) AS BIGINT)) ELSE 0 END AS cal, CASE WHEN n >= 4 THEN greatest(1, CAST(round_even(0.2*n, 0) AS BIGINT)) ELSE 0 END AS val FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY class ORDER BY sha256('7|' || sample_id), sample_id) - 1 AS k, count(*) OVER (PARTITION BY class) AS n
      FROM rep WHERE seed = 20260921 AND partition IN ('train', 'validation')) z) y""")

SETS = {
    "classifier_train": ("development_train", None), "classifier_validation": ("development_validation", None),
    "calibrator_fit": ("calibration", None), "severity_train": ("development_train", "BUILDING"),
    "severity_validation": ("development_validation", "BUILDING"), "release_test": ("locked_release_test", None),
}
_SETS = ", ".join(f"('{n}','{p}',{'NULL' if c is None else repr(c)})" for n, (p, c) in SETS.items())
define_cte("sets", ["release"], f"SELECT set, sample_id, r.class FROM release r JOIN (VALUES {_SETS}) v(set, p, c) ON p = release_partition AND (c IS NULL OR c = r.class)")


def release(spark, d):
    base = spl_04(spark, d).where(f"seed = {SEEDS[0]}").select(ID, "class", "partition")
    return splits.release_protocol(base, "class", ID, 7)


@query("spl_07_release_protocol", sql("release", "SELECT * FROM release"))
def spl_07(spark, d):
    return release(spark, d)


@query("spl_08_named_sets", sql("sets", "SELECT * FROM sets"))
def spl_08(spark, d):
    return splits.named_sets(release(spark, d), SETS, "class").select("set", ID, "class")


@query("spl_09_half_and_direction", sql("sev", """
  SELECT sample_id, CASE WHEN severity <= 50 THEN 'train' ELSE 'test' END AS half, train_direction, CASE WHEN direction = train_direction THEN 'train' ELSE 'test' END AS partition
  FROM (SELECT *, CASE WHEN sample_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction FROM sev) z CROSS JOIN (VALUES ('up'), ('down')) v(train_direction)"""))
def spl_09(spark, d):
    s = b.sev(spark, d).withColumn("direction", F.when(F.col(ID) % 2 == 0, "up").otherwise("down"))
    h = splits.half_split(s, "severity", 50).withColumnRenamed("partition", "half")
    return splits.cross_direction(h, "direction", ["up", "down"]).select(ID, "half", "train_direction", "partition")


@query("spl_10_matched_cohort", sql("evt windows", """
  SELECT sample_id FROM evt JOIN windows ON first_protection_s > window_s WHERE window_s IN (3, 6, 12) GROUP BY 1 HAVING count(*) = 3"""))
def spl_10(spark, d):
    return align.in_all_windows(strict_rows(spark, d), [3, 6, 12])
