"""PRJ, SRC, SNK: column operators, scans and sinks."""

import uuid

from pyspark.sql import functions as F

from tracewell.functions import scalars as sc
from tracewell.operators import aggregates as agg
from tracewell.operators import align, ranking
from tracewell.operators import windows as win
from tracewell.plans import bindings as b
from tracewell.plans.bindings import sql
from tracewell.plans.registry import q6, query, r6, rounded
from tracewell.plans.sections.windows import ID, events_row, row_median
from tracewell.session import shared_dir
from tracewell.sources import readers, sinks


def _scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _csv_copy(spark, d):
    """The daily trajectories as one CSV folder per class, written to the shared folder."""
    path = _scratch(spark, "trajectories")
    rows = b.traj(spark, d).join(b.cls(spark, d), ID)
    text = rows.select(ID, F.col("t").alias("TIME"), *b.FEATURES, F.col("class").alias("folder"))
    text.write.mode("overwrite").option("header", True).partitionBy("folder").csv(path)
    return path


_COLS = [ID, "TIME", *b.FEATURES]


@query("src_01_scan_trajectory_files", sql("traj cls", "SELECT class, count(*) AS rows, count(DISTINCT sample_id) AS trajectories, min(t) AS t_min, max(t) AS t_max FROM traj JOIN cls USING (sample_id) GROUP BY 1"))
def src_01(spark, d):
    df = readers.scan_trajectories(spark, _csv_copy(spark, d), _COLS, class_dir=r"/folder=([^/]+)/[^/]+$")
    return df.groupBy("class").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(ID).alias("trajectories"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))


@query("src_02_load_with_metadata", sql("traj cls", f"SELECT CAST(sample_id AS DOUBLE) AS sample_id, class, t, {q6('f_click')} AS f_click, {q6('f_error')} AS f_error FROM traj JOIN cls USING (sample_id)"))
def src_02(spark, d):
    df = readers.scan_trajectories(spark, _csv_copy(spark, d), _COLS, class_dir=r"/folder=([^/]+)/[^/]+$")
    return rounded(df.select(ID, "class", "t", "f_click", "f_error"))


@query("src_03_first_row_scan", "SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1")
def src_03(spark, d):
    rows = b.table(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    return readers.first_rows_only(rows.withColumn("first_ship", F.col("l_shipdate")), ["first_ship"], "l_orderkey", "l_shipdate")


@query("src_04_keep_first_per_time", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) = 1""")
def src_04(spark, d):
    li = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return readers.keep_first(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]).drop("l_shipdate")


@query("src_05_log_lines", sql("evlog", """
  SELECT k AS log, count(line) AS lines, count(line) = 0 AS log_missing FROM range(0, 20) r(k) LEFT JOIN evlog ON sample_id % 16 = k GROUP BY 1"""))
def src_05(spark, d):
    path = _scratch(spark, "logs")
    b.evlog(spark, d).select((F.col(ID) % 16).alias("log"), "line").write.mode("overwrite").partitionBy("log").text(path)
    lines = readers.scan_logs(spark, path, id_pattern=r"/log=(\d+)/[^/]+$").withColumn("log", F.col(ID).cast("long"))
    n = lines.groupBy("log").agg(F.count(F.lit(1)).alias("lines"))
    inv = spark.range(20).withColumnRenamed("id", "log")  # expected logs; the last four do not exist
    return inv.join(n, "log", "left").select("log", F.coalesce("lines", F.lit(0)).alias("lines"), F.col("lines").isNull().alias("log_missing"))


@query("src_06_scenario_manifest", f"SELECT o_orderkey, o_custkey, {q6('o_totalprice')} AS o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def src_06(spark, d):
    return rounded(readers.scenario_manifest(b.table(spark, d, "orders"), "o_orderstatus", "F").select("o_orderkey", "o_custkey", "o_totalprice"))


@query("src_07_text_flags", "SELECT doc_id, quality = 1 AS good, toxic = 1 AS toxic FROM labels")
def src_07(spark, d):
    text = lambda c: F.when(F.col(c) == 1, F.when(F.col("doc_id") % 2 == 0, "True").otherwise("TRUE")).otherwise("False")
    lab = b.table(spark, d, "labels").select("doc_id", text("quality").alias("good"), text("toxic").alias("toxic"))
    return readers.text_flags(lab, ["good", "toxic"])


@query("snk_01_partitioned_table", sql("cls", """
  SELECT sample_id, class, CASE WHEN p % 10 = 0 THEN 'test' WHEN p % 10 = 1 THEN 'validation' ELSE 'train' END AS partition FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY class ORDER BY sample_id) - 1 AS p, count(*) OVER (PARTITION BY class) AS n FROM cls) z WHERE n >= 3
  UNION ALL SELECT sample_id, class, 'train' FROM (SELECT *, count(*) OVER (PARTITION BY class) AS n FROM cls) z WHERE n < 3"""))
def snk_01(spark, d):
    from tracewell.operators import splits

    path = _scratch(spark, "splits")
    sinks.write_table(splits.interleaved(b.cls(spark, d), ["class"], ID), path, ["partition"])
    return spark.read.parquet(path).select(ID, "class", F.col("partition").cast("string").alias("partition"))


@query("snk_02_json_safe", sql("faulty", """
  SELECT sample_id, t, dup, CASE WHEN f_click IS NULL AND (f_view IS NULL OR isnan(f_view)) THEN '{}' WHEN f_click IS NULL THEN '{"v":' || CAST(CAST(f_view*100 AS BIGINT) AS VARCHAR) || '}'
         WHEN isnan(f_view) THEN '{"c":' || CAST(CAST(f_click*100 AS BIGINT) AS VARCHAR) || '}' ELSE '{"c":' || CAST(CAST(f_click*100 AS BIGINT) AS VARCHAR) || ',"v":' || CAST(CAST(f_view*100 AS BIGINT) AS VARCHAR) || '}' END AS json FROM faulty"""))
def snk_02(spark, d):
    cents = lambda c: F.round(sc.json_safe(F.col(c)) * 100, 0).cast("long")
    f = b.faulty(spark, d).select(ID, "t", F.col("dup"), cents("f_click").alias("c"), cents("f_view").alias("v"))
    return sinks.json_rows(f, [ID, "t", "dup"])


@query("snk_03_diagnosis_export", sql("traj cls", """
  SELECT sample_id, '{"schema_version":"1","input":{"source":"' || sample_id || '","row_count":' || n || '},"diagnosis":{"class":"' || class || '"}}' AS json
  FROM (SELECT sample_id, count(*) AS n FROM traj GROUP BY 1) z JOIN cls USING (sample_id)"""))
def snk_03(spark, d):
    rows = b.traj(spark, d).groupBy(ID).agg(F.count(F.lit(1)).alias("row_count")).join(b.cls(spark, d), ID)
    return sinks.diagnosis_export(rows, ID, ["row_count"], ["class"])


@query("snk_04_manifest_check", sql("cls", "SELECT DISTINCT class, 'ok' AS status FROM cls"))
def snk_04(spark, d):
    path = _scratch(spark, "artifacts")
    sinks.write_table(b.cls(spark, d), path, ["class"])
    made = sinks.file_manifest(spark, path, "*.parquet")
    checked = sinks.verify_manifest(made, sinks.file_manifest(spark, path, "*.parquet"))
    return checked.select(F.regexp_extract("file", "class=([^/]+)/", 1).alias("class"), "status").distinct()


# ---------------------------------------------------------------- projections


@query("prj_01_metadata_columns", sql("sev", "SELECT 'case' AS kind, 'percent' AS severity_unit, sample_id, class, CAST(severity AS DOUBLE) AS severity, class || '/' || sample_id || '.csv' AS source_file FROM sev"))
def prj_01(spark, d):
    return b.sev(spark, d).select(
        F.lit("case").alias("kind"), F.lit("percent").alias("severity_unit"), ID, "class", F.col("severity").cast("double").alias("severity"),
        F.concat("class", F.lit("/"), F.col(ID).cast("string"), F.lit(".csv")).alias("source_file"))


@query("prj_02_numeric_coercion", "SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN NULL ELSE value END AS DOUBLE) AS value FROM events")
def prj_02(spark, d):
    raw = F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 11 == 0, "NaN").otherwise(F.col("value").cast("string"))
    return b.table(spark, d, "events").select("event_id", raw.alias("value")).select("event_id", sc.to_number("value").alias("value"))


@query("prj_03_finite_quarantine", sql("faulty", """
  SELECT sample_id, count(*) FILTER (f_view IS NOT NULL AND NOT isnan(f_view)) AS kept, count(*) FILTER (f_view IS NULL OR isnan(f_view)) AS quarantined FROM faulty GROUP BY 1"""))
def prj_03(spark, d):
    ok = sc.is_finite(F.col("f_view"))
    return b.faulty(spark, d).groupBy(ID).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("quarantined"))


@query("prj_04_time_range", sql("traj", f"""
  SELECT sample_id, t, t > 0.5 AND t <= 6.5 AS half_open, t >= 0.5 AND t <= 12.5 AS closed, {q6('f_click')} AS f_click FROM traj WHERE t <= 12.5"""))
def prj_04(spark, d):
    return rounded(b.traj(spark, d).where("t <= 12.5").select(
        ID, "t", win.in_window("t", 0.5, 6.0).alias("half_open"), F.col("t").between(0.5, 12.5).alias("closed"), "f_click"))


@query("prj_05_time_reorigin", """
  SELECT event_id, round(epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00') - 0.5, 3) + 0.0 AS since_injection FROM events""")
def prj_05(spark, d):
    return b.table(spark, d, "events").select("event_id", r6(b._seconds("ts") - 0.5, 3).alias("since_injection"))


@query("prj_06_phase_label", sql("traj evt", """
  SELECT sample_id, t, CASE WHEN t < 0.5 THEN 'normal_or_pre_fault' WHEN first_protection_s IS NULL THEN 'unknown' WHEN t < first_protection_s THEN 'early' ELSE 'post_protection' END AS phase FROM traj LEFT JOIN evt USING (sample_id)"""))
def prj_06(spark, d):
    j = align.join_events(b.traj(spark, d).select(ID, "t"), events_row(spark, d))
    return j.select(ID, "t", sc.phase_label(F.col("t"), b.INJECTION, F.col("first_protection_s")).alias("phase"))


@query("prj_07_relative_change", sql("traj", f"""
  WITH s AS (SELECT sample_id, max_by(f_click, t) FILTER (t > 0.5) AS l, max_by(f_click, t) FILTER (t <= 0.5) AS z, avg(f_click) FILTER (t > 0.5) AS m, stddev_pop(f_click) FILTER (t > 0.5) AS sd, regr_slope(f_click, t) FILTER (t > 0.5) AS sl
             FROM traj WHERE t <= 12.5 GROUP BY 1), c AS (SELECT *, greatest(abs(z), abs(l), abs(m), 1.0) AS k FROM s)
  SELECT sample_id, {q6('l - z')} AS f_click__delta, {q6('m - z')} AS f_click__mean_minus_t0, {q6('(l - z)/k')} AS f_click__relative_delta, {q6('sl*12/k')} AS f_click__relative_slope, {q6('sd/k')} AS f_click__relative_std FROM c"""))
def prj_07(spark, d):
    s = win.window_summary(b.traj(spark, d), ["f_click"], [12], b.INJECTION)
    return rounded(s.select(ID, *[c.alias(n) for n, c in sc.relative_change("f_click", F.col("window_s")).items()]))


@query("prj_08_id_format", "SELECT c_custkey, 'CASE_' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS padded, 'CASE_' || CAST(c_custkey AS VARCHAR) AS stripped FROM customer")
def prj_08(spark, d):
    padded = sc.padded_id("CASE_", F.col("c_custkey"), 7)
    return b.table(spark, d, "customer").select("c_custkey", padded.alias("padded"), sc.strip_padding(padded, "CASE_").alias("stripped"))


@query("prj_09_split_feature_name", "SELECT DISTINCT p_brand || '__' || p_type AS name, p_brand AS variable, p_type AS statistic FROM part")
def prj_09(spark, d):
    n = b.table(spark, d, "part").select(F.concat("p_brand", F.lit("__"), "p_type").alias("name")).distinct()
    return n.select("name", sc.base_variable(F.col("name")).alias("variable"), sc.statistic(F.col("name")).alias("statistic"))


@query("prj_10_severity_band", sql("sev", "SELECT sample_id, CASE WHEN severity <= 10 THEN 'low_1_10' WHEN severity <= 90 THEN 'middle_11_90' ELSE 'high_91_100' END AS band FROM sev"))
def prj_10(spark, d):
    return b.sev(spark, d).select(ID, sc.severity_band(F.col("severity")).alias("band"))


@query("prj_11_family_map", sql("family", "SELECT event_type, COALESCE(family, 'unknown_or_other') AS family, count(*) AS n FROM events LEFT JOIN (SELECT * FROM family WHERE class <> 'view') f ON class = event_type GROUP BY 1, 2"))
def prj_11(spark, d):
    known = {k: v for k, v in b.FAMILY.items() if k != "view"}
    return b.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", sc.map_label(F.col("event_type"), known).alias("family"), "n")


@query("prj_12_feature_roles", sql("feature_dict", """
  SELECT 'f_' || event_type AS feature, COALESCE("group", 'unknown') AS role, COALESCE(policy, 'review') AS policy, count(*) AS n FROM events LEFT JOIN feature_dict ON feature = 'f_' || event_type GROUP BY 1, 2, 3"""))
def prj_12(spark, d):
    used = b.table(spark, d, "events").groupBy(F.concat(F.lit("f_"), "event_type").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    dim = F.broadcast(b.feature_dict(spark))  # literal rows, one per feature
    return used.join(dim, "feature", "left").select("feature", F.coalesce("group", F.lit("unknown")).alias("role"), F.coalesce("policy", F.lit("review")).alias("policy"), "n")


@query("prj_13_ordered_string_set", "SELECT l_suppkey, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS line_numbers FROM lineitem GROUP BY 1")
def prj_13(spark, d):
    # a set over the small domain of line numbers, so the list is short whatever the group size
    return b.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ",").alias("line_numbers"))


@query("prj_13_ordered_points", sql("traj", """
  SELECT sample_id, string_agg(CAST(CAST(t AS BIGINT) AS VARCHAR), ',' ORDER BY t) AS text, count(*) AS n FROM traj WHERE f_error > 0 GROUP BY 1"""))
def prj_13b(spark, d):
    days = b.traj(spark, d).where("f_error > 0").select(ID, "t", F.col("t").cast("long").alias("day"))
    return agg.ordered_text(days, [ID], "day", "t")


@query("prj_13_ordered_set", sql("", """
  SELECT user_id AS sample_id, string_agg(event_type, ' | ' ORDER BY first, event_type) AS text, count(*) AS n FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) z GROUP BY 1"""))
def prj_13c(spark, d):
    ev = b.table(spark, d, "events").select(F.col("user_id").alias(ID), "event_id", "event_type")
    return agg.ordered_text(ev, [ID], "event_type", "event_id", " | ", distinct=True)


@query("prj_14_id_set_digest", """
  SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS ids, sha256(string_agg(dg, ',' ORDER BY slot)) AS sha256 FROM (
    SELECT c_mktsegment, substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 4) AS slot, count(*) AS n, sha256(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY CAST(c_custkey AS VARCHAR))) AS dg FROM customer GROUP BY 1, 2) z GROUP BY 1""")
def prj_14(spark, d):
    return sinks.set_digest(b.table(spark, d, "customer"), "c_custkey", ["c_mktsegment"])


@query("prj_15_tolerance", "SELECT count(*) AS n, count(*) FILTER (abs(l_extendedprice*(1+l_tax/1000) - l_extendedprice) <= 1e-8 + 1e-5*abs(l_extendedprice)) AS close_default, count(*) FILTER (abs(l_tax - l_discount) <= 0.021) AS close_atol FROM lineitem")
def prj_15(spark, d):
    p = F.col("l_extendedprice")
    return b.table(spark, d, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sc.close(p * (1 + F.col("l_tax") / 1000), p)).alias("close_default"),
        F.count_if(sc.close(F.col("l_tax"), F.col("l_discount"), 0.0, 0.021)).alias("close_atol"))


@query("prj_16_row_median", sql("faulty", f"""
  SELECT sample_id, t, dup, {q6("median(x)")} AS composite FROM faulty UNPIVOT INCLUDE NULLS (x0 FOR f IN (f_click, f_view, f_purchase, f_signup, f_error)),
    LATERAL (SELECT CASE WHEN isnan(x0) THEN NULL ELSE x0 END AS x) k GROUP BY 1, 2, 3"""))
def prj_16(spark, d):
    arr = F.array_compact(F.array(*[sc.json_safe(F.col(f)) for f in b.FEATURES]))
    return rounded(b.faulty(spark, d).select(ID, "t", "dup", row_median(arr).alias("composite")))


@query("prj_17_array_ops", sql("scored", f"""
  SELECT grp, y_pred, {q6('margin')} AS margin, array_to_string(list_filter(['A','N','R'], lambda l: CASE l WHEN 'A' THEN p_a WHEN 'N' THEN p_n ELSE p_r END >= 0.3 - 1e-12), '|') AS members, count(*) AS n FROM (
    SELECT *, conf - list_sort([p_a, p_n, p_r])[2] AS margin FROM scored) z GROUP BY ALL"""))
def prj_17(spark, d):
    p = b.pred(spark, d)
    probs = F.array("p_a", "p_n", "p_r")
    return p.select("grp", sc.argmax_label(probs, b.LABELS).alias("y_pred"), r6(sc.top_two_margin(probs)).alias("margin"),
                    F.array_join(sc.label_set(probs, b.LABELS, 0.3), "|").alias("members")).groupBy("grp", "y_pred", "margin", "members").agg(F.count(F.lit(1)).alias("n"))
