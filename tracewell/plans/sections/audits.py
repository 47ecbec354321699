"""AUD: data-quality and dataset audits."""

import uuid

from pyspark.sql import functions as F

from tracewell.operators import align, audit, ranking, splits
from tracewell.operators import windows as win
from tracewell.plans import bindings as b
from tracewell.plans.bindings import define_cte, sql
from tracewell.plans.registry import q6, query, rounded
from tracewell.plans.sections.aggregates import big_long, feat_long
from tracewell.plans.sections.events import evt_06
from tracewell.plans.sections.splits import SETS, release  # noqa: F401
from tracewell.plans.sections.windows import ID, events_row, long_traj, reference
from tracewell.session import shared_dir
from tracewell.sources import readers

define_cte("bigsteps", ["bigtraj"], "SELECT *, t - lag(t) OVER (PARTITION BY sample_id ORDER BY t) AS dt FROM bigtraj")
define_cte("faultysteps", ["faulty"], "SELECT *, t - lag(t) OVER (PARTITION BY sample_id ORDER BY t, dup) AS dt FROM faulty")
_TIME = """
  SELECT s.sample_id, count(*) AS rows, min(t) AS time_start_s, max(t) AS time_end_s, min(dt) AS sampling_min_s, max(dt) AS sampling_max_s, COALESCE(bool_and(dt > 0), true) AS time_strictly_increasing,
         count(*) FILTER (dt = 0) AS time_duplicate_count, max(m) AS sampling_median_s, count(*) FILTER (abs(dt - m) > 1e-6 + 1e-5*abs(m)) AS nonuniform_sampling_intervals
  FROM %s s JOIN (SELECT sample_id, median(dt) AS m FROM %s GROUP BY 1) q USING (sample_id) GROUP BY 1"""


@query("aud_01_time_metrics_irregular", sql("bigsteps", _TIME % ("bigsteps", "bigsteps")))
def aud_01(spark, d):
    return audit.time_metrics(b.bigtraj(spark, d), 12.0)


@query("aud_01_time_metrics_duplicates", sql("faultysteps", _TIME % ("faultysteps", "faultysteps")))
def aud_01b(spark, d):
    return audit.time_metrics(b.faulty(spark, d), b.SEGMENT, order=["t", "dup"])


define_cte("arrivalsteps", ["arrivals"], "SELECT *, t - lag(t) OVER (PARTITION BY sample_id ORDER BY ord) AS dt FROM arrivals")


@query("aud_01_time_metrics_file_order", sql("arrivalsteps", """
  SELECT s.sample_id, count(*) AS rows, min_by(t, ord) AS time_start_s, max_by(t, ord) AS time_end_s, min(dt) AS sampling_min_s, max(dt) AS sampling_max_s, COALESCE(bool_and(dt > 0), true) AS time_strictly_increasing,
         count(*) - count(DISTINCT t) AS time_duplicate_count, max(m) AS sampling_median_s, count(*) FILTER (abs(dt - m) > 1e-6 + 1e-5*abs(m)) AS nonuniform_sampling_intervals
  FROM arrivalsteps s JOIN (SELECT sample_id, median(dt) AS m FROM arrivalsteps GROUP BY 1) q USING (sample_id) GROUP BY 1"""))
def aud_01c(spark, d):
    return audit.time_metrics(b.arrivals(spark, d), 12.0, ordinal="ord")


@query("aud_02_presence", """
  SELECT COALESCE(c_custkey, o_custkey) AS id, CASE WHEN o_custkey IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'extra' ELSE 'present' END AS status
  FROM customer c FULL JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c_custkey = o_custkey""")
def aud_02(spark, d):
    want = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return audit.presence(want, b.table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id")


def damaged_files(spark, d):
    """Trajectories in sixteen files, some with short lines, cells that are no numbers, or a header that lacks a name."""
    path = f"{shared_dir(spark)}/damaged-{uuid.uuid4().hex}"
    k = F.col(ID) + F.col("t").cast("long")
    view = F.when(k % 43 == 0, "n/a").otherwise(F.col("f_view").cast("string"))
    line = F.when(k % 41 == 0, F.col("t").cast("string")).otherwise(F.concat_ws(",", F.col("t").cast("string"), F.col("f_click").cast("string"), view))
    rows = b.traj(spark, d).select((F.col(ID) % 16).alias("folder"), F.col(ID), "t", line.alias("line"))
    tops = rows.select("folder").distinct().select("folder", F.lit(-1).cast("long").alias(ID), F.lit(0.0).alias("t"), F.when(F.col("folder") % 5 == 2, "TIME,f_click,other").otherwise("TIME,f_click,f_view").alias("line"))
    tops.unionByName(rows).repartition("folder").sortWithinPartitions("folder", ID, "t").select("folder", "line").write.partitionBy("folder").option("compression", "none").text(path)
    return path


@query("aud_02_file_errors", sql("traj", """
  WITH l AS (SELECT sample_id % 16 AS folder, sample_id + CAST(t AS BIGINT) AS k, 1 + ROW_NUMBER() OVER (PARTITION BY sample_id % 16 ORDER BY sample_id, t) AS line FROM traj),
  e AS (SELECT folder, line, CASE WHEN k % 41 = 0 THEN 'cells' WHEN k % 43 = 0 AND folder % 5 <> 2 THEN 'number' END AS error, CASE WHEN k % 41 = 0 THEN '1 of 3' ELSE 'f_view' END AS detail FROM l
    UNION ALL SELECT DISTINCT folder, 1, 'missing_columns', 'f_view' FROM l WHERE folder % 5 = 2)
  SELECT r.k AS folder, CASE WHEN f.folder IS NULL THEN 'missing' ELSE 'present' END AS status, COALESCE(n, 0) AS rows, 0::BIGINT AS unreadable, 0::BIGINT AS empty, COALESCE(missing_columns, 0) AS missing_columns, 0::BIGINT AS repeated_columns, COALESCE(cells, 0) AS cells, COALESCE(number, 0) AS number, x.error
  FROM range(0, 20) r(k) LEFT JOIN (SELECT folder, count(*) FILTER (k % 41 <> 0) AS n FROM l GROUP BY 1) f ON f.folder = r.k
  LEFT JOIN (SELECT folder, count(*) FILTER (error = 'missing_columns') AS missing_columns, count(*) FILTER (error = 'cells') AS cells, count(*) FILTER (error = 'number') AS number, min_by(error || ' in line ' || line || ': ' || detail, line) AS error FROM e WHERE error IS NOT NULL GROUP BY 1) x ON x.folder = r.k"""))
def aud_02b(spark, d):
    rows, faults = readers.scan_checked(spark, damaged_files(spark, d), ["TIME", "f_click", "f_view"], "*.txt")
    folder = F.regexp_extract("file", r"/folder=(\d+)/[^/]+$", 1).try_cast("long")
    expected = spark.range(20).withColumnRenamed("id", "folder")  # the last four do not exist
    known = lambda df: df.withColumn("folder", folder).where("folder is not null")  # rows without an id, or with a negative one, are in no expected folder
    return audit.file_report(expected, known(rows), known(faults), "folder")


@query("aud_03_schema_conformance", """
  SELECT user_id AS sample_id, len(h) AS column_count, array_to_string(list_sort(list_filter(['click','purchase','refund','view'], lambda x: NOT list_contains(h, x))), ';') AS schema_missing_columns,
         array_to_string(list_sort(list_filter(h, lambda x: NOT list_contains(['click','purchase','refund','view'], x))), ';') AS schema_extra_columns, false AS schema_match
  FROM (SELECT user_id, list(DISTINCT event_type) AS h FROM events GROUP BY 1) z""")
def aud_03(spark, d):
    cols = b.table(spark, d, "events").select(F.col("user_id").alias(ID), "event_type")
    return audit.schema_conformance(cols, ["click", "purchase", "refund", "view"], ID, "event_type")


_BAD = {f: f"({f} IS NULL OR isnan({f}) OR isinf({f}))" for f in b.FEATURES}


@query("aud_04_missing_cells", sql("faulty", f"""
  SELECT sample_id, CAST(sum({" + ".join(f"CAST({x} AS INT)" for x in _BAD.values())}) AS BIGINT) AS missing_cells, CAST({" + ".join(f"max(CAST({x} AS INT))" for x in _BAD.values())} AS BIGINT) AS columns_with_missing FROM faulty GROUP BY 1"""))
def aud_04(spark, d):
    return audit.missing_cells(b.faulty(spark, d), b.FEATURES)


@query("aud_05_key_signal", sql("bigtraj", f"""
  SELECT sample_id, {q6('min_by(f_price, t)')} AS f_price_first, {q6('max_by(f_price, t)')} AS f_price_last, {q6('min(f_price)')} AS f_price_min, {q6('max(f_price)')} AS f_price_max FROM bigtraj GROUP BY 1"""))
def aud_05(spark, d):
    return rounded(audit.key_signal(b.bigtraj(spark, d), "f_price"))


@query("aud_06_initial_state_match", sql("traj", """
  SELECT a.sample_id, abs(a.f_signup - r.f_signup) <= 1e-6 AND abs(a.f_purchase - r.f_purchase) <= 1e-6 AS initial_state_match
  FROM traj a JOIN traj r ON r.sample_id = 0 AND r.t = 0 WHERE a.t = 0"""))
def aud_06(spark, d):
    return audit.initial_state_match(b.traj(spark, d), 0, ["f_signup", "f_purchase"])


@query("aud_07_table_equality", sql("traj", """
  WITH r AS (SELECT sample_id, t, f_click + CASE WHEN t = 3 THEN 0.5 ELSE 0 END AS f_click, f_view + 1e-9 AS f_view FROM traj WHERE sample_id % 5 <> 0 UNION ALL SELECT sample_id, t + 100, f_click, f_view FROM traj WHERE sample_id % 5 = 0)
  SELECT count(*) FILTER (r.t IS NULL) AS only_left, count(*) FILTER (l.t IS NULL) AS only_right, count(*) FILTER (l.t IS NOT NULL AND r.t IS NOT NULL) AS matched,
         count(*) FILTER (abs(l.f_click - r.f_click) > 1e-6) AS f_click_differs, count(*) FILTER (abs(l.f_view - r.f_view) > 1e-6) AS f_view_differs
  FROM traj l FULL JOIN r ON l.sample_id = r.sample_id AND l.t = r.t"""))
def aud_07(spark, d):
    l = b.traj(spark, d).select(ID, "t", "f_click", "f_view")
    bump = F.when(F.col("t") == 3, 0.5).otherwise(0.0)
    r = l.select(
        ID, F.when(F.col(ID) % 5 == 0, F.col("t") + 100).otherwise(F.col("t")).alias("t"),
        (F.col("f_click") + F.when(F.col(ID) % 5 == 0, F.lit(0.0)).otherwise(bump)).alias("f_click"), (F.col("f_view") + 1e-9).alias("f_view"))
    return audit.table_equality(l, r, [ID, "t"], ["f_click", "f_view"])


@query("aud_08_pre_injection", sql("bigsteps", """
  SELECT sample_id, count(*) FILTER (t < 20) AS pre_injection_rows, min(t) FILTER (t < 20) AS pre_injection_time_start_s, max(t) FILTER (t < 20) AS pre_injection_time_end_s,
         max(t) FILTER (t < 20) - min(t) FILTER (t < 20) AS pre_injection_window_s, median(dt) FILTER (t < 20) AS pre_injection_sampling_median_s, count(*) FILTER (t < 20) > 0 AS has_valid_pre_injection_sample,
         COALESCE(count(*) FILTER (t < 20) >= 2 AND max(t) FILTER (t < 20) > min(t) FILTER (t < 20), false) AS pre_window_usable_for_normal FROM bigsteps GROUP BY 1"""))
def aud_08(spark, d):
    return audit.pre_injection_metrics(b.bigtraj(spark, d), 20.0, 12.0)


define_cte("inventory", ["traj", "bigtraj", "sev"], """
  SELECT *, CASE WHEN is_legal_normal_reference AND fixed_condition THEN 'A' WHEN is_legal_normal_reference THEN 'B' ELSE 'C' END AS classification FROM (
    SELECT 'fixed_normal' AS source_group, 'daily' AS source_category, sample_id, count(*) AS rows, true AS is_legal_normal_reference, true AS fixed_condition, true AS schema_match, CAST(NULL AS BIGINT) AS severity FROM traj GROUP BY 3
    UNION ALL SELECT 'variable_normal', 'monthly', sample_id, count(*), true, false, max(f_disc) <= 0.1, NULL FROM bigtraj GROUP BY 3
    UNION ALL SELECT 'accident_pre_injection', class, sample_id, 1, false, NULL, true, severity FROM sev) z""")


def inventory(spark, d):
    fixed = b.traj(spark, d).groupBy(ID).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("fixed_normal").alias("source_group"), F.lit("daily").alias("source_category"), ID, "rows",
        F.lit(True).alias("is_legal_normal_reference"), F.lit(True).alias("fixed_condition"), F.lit(True).alias("schema_match"))
    var = b.bigtraj(spark, d).groupBy(ID).agg(F.count(F.lit(1)).alias("rows"), (F.max("f_disc") <= 0.1).alias("schema_match")).select(
        F.lit("variable_normal").alias("source_group"), F.lit("monthly").alias("source_category"), ID, "rows",
        F.lit(True).alias("is_legal_normal_reference"), F.lit(False).alias("fixed_condition"), "schema_match")
    acc = b.sev(spark, d).select(
        F.lit("accident_pre_injection").alias("source_group"), F.col("class").alias("source_category"), ID, F.lit(1).cast("long").alias("rows"),
        F.lit(False).alias("is_legal_normal_reference"), F.lit(True).alias("schema_match"), "severity")
    return audit.classify_references(ranking.union_all([fixed, var, acc]))


@query("aud_09_source_inventory", sql("inventory", "SELECT * FROM inventory"))
def aud_09(spark, d):
    return inventory(spark, d)


@query("aud_10_audit_summary", sql("inventory", """
  SELECT COALESCE(source_group, 'overall') AS summary_group, CASE WHEN source_group IS NULL THEN 'all scanned trajectories' WHEN source_category IS NULL THEN source_group ELSE source_category END AS label,
         CAST(grouping(source_group)*2 + grouping(source_category) AS BIGINT) AS level, count(*) AS trajectory_count, count(*) FILTER (classification='A') AS "A_count", count(*) FILTER (classification='B') AS "B_count", count(*) FILTER (classification='C') AS "C_count",
         count(*) FILTER (is_legal_normal_reference) AS legal_normal_count, bool_and(schema_match) AS schema_all, min(rows) AS rows_min, max(rows) AS rows_max
  FROM inventory GROUP BY GROUPING SETS ((source_group, source_category), (source_group), ())"""))
def aud_10(spark, d):
    return audit.audit_summary(inventory(spark, d), "source_group", "source_category")


@query("aud_11_window_availability", sql("bigtraj", """
  SELECT sample_id, max(t) >= 60 AS available_60s, max(t) >= 80 AS available_80s, max(t) >= 83 AS available_83s FROM bigtraj GROUP BY 1"""))
def aud_11(spark, d):
    return audit.window_availability(b.bigtraj(spark, d), [60, 80, 83])


@query("aud_11_coverage_rate", sql("bigtraj", f"SELECT w AS window_s, count(*) AS n, {q6('avg(CASE WHEN e >= w THEN 1.0 ELSE 0.0 END)')} AS rate FROM (SELECT sample_id, max(t) AS e FROM bigtraj GROUP BY 1) z CROSS JOIN (VALUES (60), (80), (83)) v(w) GROUP BY 1"))
def aud_11b(spark, d):
    a = audit.window_availability(b.bigtraj(spark, d), [60, 80, 83])
    long = a.select(F.explode(F.array(*[F.struct(F.lit(w).alias("window_s"), F.col(f"available_{w}s").alias("ok")) for w in (60, 80, 83)])).alias("r")).select("r.*")
    return rounded(long.groupBy("window_s").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("int")).alias("rate")))


define_cte("states", ["faulty", "cls"], """
  SELECT sample_id, feature, COALESCE(max(abs(x)) > max(tol), false) AS present, COALESCE(max(abs(x - f0)) > max(tol), false) AS changed, count(DISTINCT round(x, 6)) <= 5 AS low_cardinality FROM (
    SELECT *, greatest(1e-9, greatest(max(abs(x)) OVER w, 1.0)*1e-6) AS tol, first_value(x IGNORE NULLS) OVER (PARTITION BY sample_id, feature ORDER BY t, dup ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f0 FROM (
      SELECT sample_id, t, dup, feature, CASE WHEN isnan(x) THEN NULL ELSE x END AS x FROM faulty UNPIVOT INCLUDE NULLS (x FOR feature IN (f_click, f_view, f_purchase, f_signup, f_error))) z
    WINDOW w AS (PARTITION BY sample_id, feature)) y GROUP BY 1, 2""")


def states(spark, d):
    return audit.feature_states(win.to_long(b.faulty(spark, d), [ID, "t", "dup"], b.FEATURES))


@query("aud_12_feature_states", sql("states", "SELECT * FROM states"))
def aud_12(spark, d):
    return states(spark, d)


define_cte("initstats", ["traj", "cls"], """
  SELECT feature, class, count(x) AS initial_count, avg(x) AS initial_mean, stddev_samp(x) AS initial_std, min(x) AS initial_min, max(x) AS initial_max
  FROM (SELECT * FROM traj WHERE t = 0) UNPIVOT (x FOR feature IN (f_click, f_view, f_purchase, f_signup, f_error)) JOIN cls USING (sample_id) GROUP BY 1, 2""")
define_cte("initconf", ["initstats"], """
  SELECT a.*, (SELECT max(initial_mean) - min(initial_mean) FROM initstats b WHERE b.feature = a.feature) AS max_pairwise_mean_diff,
         (SELECT max(abs(initial_mean)) FROM initstats b WHERE b.feature = a.feature) AS global_class_mean_max,
         (SELECT max(abs(a.initial_mean - b.initial_mean)) FROM initstats b WHERE b.feature = a.feature AND b.class <> a.class) AS class_mean_vs_other_max_diff,
         abs(a.initial_mean - (SELECT median(initial_mean) FROM initstats b WHERE b.feature = a.feature)) AS class_mean_vs_global_class_median_diff FROM initstats a""")


def initial_confounding(spark, d):
    first = audit.first_rows(b.traj(spark, d), b.FEATURES)
    return audit.initial_condition_confounding(win.to_long(first, [ID], b.FEATURES).join(b.cls(spark, d), ID))


@query("aud_13_leakage_screen", sql("states cls initconf", f"""
  WITH p AS (SELECT feature, class, count(*) AS n, count(*) FILTER (present) AS a, count(*) FILTER (changed) AS c, count(*) FILTER (low_cardinality) AS l FROM states JOIN cls USING (sample_id) GROUP BY 1, 2),
  q AS (SELECT *, sum(n) OVER w - n AS o, a/n AS ca, (sum(a) OVER w - a)/(sum(n) OVER w - n) AS oa, c/n AS cc, (sum(c) OVER w - c)/(sum(n) OVER w - n) AS oc, l/n AS cl, (sum(l) OVER w - l)/(sum(n) OVER w - n) AS ol FROM p WINDOW w AS (PARTITION BY feature)),
  r AS (SELECT q.*, list_filter([CASE WHEN ca >= 0.9 AND oa <= 0.1 THEN 'class_specific_nonzero' END, CASE WHEN cc >= 0.9 AND oc <= 0.1 THEN 'class_specific_state_change' END,
      CASE WHEN cl >= 0.9 AND ol <= 0.1 AND cc >= 0.5 THEN 'class_specific_low_cardinality_state' END], lambda x: x IS NOT NULL) AS tr,
      i.class_mean_vs_global_class_median_diff > greatest(1e-6, i.global_class_mean_max*1e-6) AS ini FROM q JOIN initconf i ON i.feature = q.feature AND i.class = q.class)
  SELECT feature, class, n AS class_trajectory_count, CAST(o AS BIGINT) AS other_trajectory_count, {q6('ca')} AS class_present_rate, {q6('oa')} AS other_present_rate, {q6('cc')} AS class_changed_rate, {q6('oc')} AS other_changed_rate,
         {q6('cl')} AS class_low_cardinality_rate, {q6('ol')} AS other_low_cardinality_rate, array_to_string(CASE WHEN ini THEN list_append(tr, 'class_specific_initial_constant') ELSE tr END, ';') AS trigger,
         len(tr) > 0 AS potential_label_leakage, CASE WHEN len(tr) > 0 THEN 'potential_label_leakage' ELSE 'initial_condition_confounding' END AS risk_type, CASE WHEN n < 3 THEN 'low_sample_class' ELSE 'review_candidate' END AS confidence_note
  FROM r WHERE len(tr) > 0 OR ini"""))
def aud_13(spark, d):
    ini = initial_confounding(spark, d).select("feature", "class", "class_initial_condition_flag")
    return rounded(audit.leakage_screen(states(spark, d).join(b.cls(spark, d), ID), ini))


@query("aud_14_initial_confounding", sql("initconf", f"""
  SELECT feature, class, initial_count, {", ".join(f"{q6(c)} AS {c}" for c in ("initial_mean", "initial_std", "initial_min", "initial_max", "max_pairwise_mean_diff", "global_class_mean_max", "class_mean_vs_other_max_diff", "class_mean_vs_global_class_median_diff"))},
         max_pairwise_mean_diff > greatest(1e-6, global_class_mean_max*1e-6) AS initial_condition_flag, class_mean_vs_global_class_median_diff > greatest(1e-6, global_class_mean_max*1e-6) AS class_initial_condition_flag FROM initconf"""))
def aud_14(spark, d):
    return rounded(initial_confounding(spark, d))


@query("aud_15_class_audit", sql("bigtraj traj cls reports", """
  WITH s AS (SELECT sample_id, class, CASE WHEN n < 3 THEN 'train' WHEN p % 10 = 0 THEN 'test' WHEN p % 10 = 1 THEN 'validation' ELSE 'train' END AS partition FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY class ORDER BY sample_id) - 1 AS p, count(*) OVER (PARTITION BY class) AS n FROM cls) z)
  SELECT class, count(*) AS trajectory_count, CAST(sum(rows) AS BIGINT) AS total_rows, min(rows) AS rows_min, max(rows) AS rows_max, min(e) AS time_end_min_s, max(e) AS time_end_max_s, count(injection_s) AS injection_parse_success_count,
         count(first_protection_s) AS first_protection_parse_success_count, count(*) FILTER (e >= 12) AS available_12s, count(*) FILTER (e >= 24) AS available_24s, count(*) FILTER (partition='train') AS train_count,
         count(*) FILTER (partition='validation') AS validation_count, count(*) FILTER (partition='test') AS test_count, count(*) >= 10 AS first_version_eligible,
         CASE WHEN count(*) >= 3 THEN 'three-way grouped split' ELSE 'train-only until more independent trajectories are available' END AS class_size_strategy
  FROM s JOIN (SELECT sample_id, count(*) AS rows, max(t) AS e FROM traj GROUP BY 1) x USING (sample_id) LEFT JOIN reports USING (sample_id) GROUP BY 1"""))
def aud_15(spark, d):
    t = b.traj(spark, d)
    rows = t.groupBy(ID).agg(F.count(F.lit(1)).alias("rows"), F.max("t").alias("time_end_s"))
    inv = splits.interleaved(b.cls(spark, d), ["class"], ID).join(rows, ID).join(audit.window_availability(t, [12, 24]), ID)
    inv = inv.join(evt_06(spark, d).select(ID, "injection_s", "first_protection_s"), ID, "left")
    return audit.class_audit(inv, "class", ["available_12s", "available_24s"])


_CODES = [
    ("mindt <= 0", "time_not_strictly_increasing_or_duplicate"), ("dev > 0.1", "sampling_interval_off"), ("{len} < 12", "window_too_short"),
    *[(f"bad_{f}", f"{f}_contains_NaN_or_Inf") for f in b.FEATURES],
]


def _gate_sql(length):
    codes = ", ".join(f"CASE WHEN {c.format(len=length)} THEN '{n}' END" for c, n in _CODES)
    return f"""
  SELECT sample_id, n AS row_count, t0 AS time_start_s, t1 AS time_end_s, t1 - t0 AS window_s, dev AS sampling_interval_max_deviation_s, errors, errors = '' AS valid FROM (
    SELECT *, CASE WHEN have_f_signup = 0 THEN 'missing_required_columns:f_signup' ELSE array_to_string(list_filter([{codes}], lambda x: x IS NOT NULL), ';') END AS errors FROM (
      SELECT sample_id, count(*) AS n, min(t) AS t0, max(t) AS t1, min(dt) AS mindt, max(abs(dt - 1)) AS dev, count(f_signup) AS have_f_signup, {", ".join(f"bool_or({x}) AS bad_{f}" for f, x in _BAD.items())} FROM faultysteps GROUP BY 1) z) y"""


@query("aud_16_input_gate_end", sql("faultysteps", _gate_sql("t1")))
def aud_16(spark, d):
    return gate(spark, d, "end")


@query("aud_16_input_gate_length", sql("faultysteps", _gate_sql("t1 - t0")))
def aud_16b(spark, d):
    return gate(spark, d, "length")


define_cte("filesteps", ["faultyfile"], "SELECT *, t - lag(t) OVER (PARTITION BY sample_id ORDER BY ord) AS dt FROM faultyfile")
_FILE_CODES = ", ".join(f"CASE WHEN {c.format(len='hi')} THEN '{n}' END" for c, n in [("repeated", "duplicate_column_names"), *_CODES])


@query("aud_16_input_gate_file_order", sql("filesteps headers", f"""
  SELECT sample_id, n AS row_count, t0 AS time_start_s, t1 AS time_end_s, hi - lo AS window_s, dev AS sampling_interval_max_deviation_s, med AS sampling_interval_median_s, extra AS extra_columns, errors, errors = '' AS valid FROM (
    SELECT *, CASE WHEN lacks THEN 'missing_required_columns:f_signup' ELSE array_to_string(list_filter([{_FILE_CODES}], lambda x: x IS NOT NULL), ';') END AS errors FROM (
      SELECT sample_id, count(*) AS n, min_by(t, ord) AS t0, max_by(t, ord) AS t1, min(t) AS lo, max(t) AS hi, min(dt) AS mindt, max(abs(dt - 1)) AS dev, median(dt) AS med, {", ".join(f"bool_or({x}) AS bad_{f}" for f, x in _BAD.items())} FROM filesteps GROUP BY 1) z
    JOIN (SELECT sample_id, count(*) FILTER (col = 'f_signup') = 0 AS lacks, COALESCE(string_agg(col, ';') FILTER (col = 'note'), '') AS extra, count(*) > count(DISTINCT col) AS repeated FROM headers GROUP BY 1) h USING (sample_id)) y"""))
def aud_16c(spark, d):
    return audit.input_gate(b.faulty_file(spark, d), b.FEATURES, b.INJECTION, 12.0, 1.0, 0.1, b.SEGMENT, ordinal="ord", header=b.headers(spark, d))


def gate(spark, d, span):
    return audit.input_gate(b.faulty(spark, d), b.FEATURES, b.INJECTION, 12.0, 1.0, 0.1, b.SEGMENT, order=["t", "dup"], span=span)


@query("aud_17_alignment_audit", sql("traj", f"""
  SELECT t, count(*) AS n, {q6('max(g)')} AS max_difference, {q6('median(g)')} AS median_difference FROM (
    SELECT a.t, greatest(abs(a.f_click - r.f_click), abs(a.f_view - r.f_view)) AS g FROM traj a JOIN traj r ON r.sample_id = 0 AND r.t = a.t WHERE a.t IN (0, 5, 10, 20)) z GROUP BY 1"""))
def aud_17(spark, d):
    both = align.join_reference(b.traj(spark, d), reference(spark, d), ["f_click", "f_view"])
    return rounded(audit.alignment_audit(both, ["f_click", "f_view"], [0, 5, 10, 20]))


@query("aud_18_shared_times", sql("bigtraj", "SELECT t, count(*) AS n FROM bigtraj GROUP BY 1 HAVING count(*) >= 2"))
def aud_18(spark, d):
    return audit.shared_times(b.bigtraj(spark, d))


_LIMBS = " || '-' || ".join(f"CAST(sum(CAST(('0x' || substr(sha256(CAST(y.sample_id AS VARCHAR)), {13 * k + 1}, 13)) AS BIGINT)) AS VARCHAR)" for k in range(5))


@query("aud_19_overlap_audit", sql("sets", f"""
  WITH n AS (SELECT DISTINCT set FROM sets)
  SELECT a.set AS left_set, c.set AS right_set, count(y.sample_id) AS overlap, {_LIMBS} AS overlap_digest
  FROM n a JOIN n c ON a.set < c.set LEFT JOIN sets x ON x.set = a.set LEFT JOIN sets y ON y.set = c.set AND y.sample_id = x.sample_id GROUP BY 1, 2"""))
def aud_19(spark, d):
    from tracewell.plans.sections.splits import spl_08

    return splits.overlap_audit(spl_08(spark, d))


@query("aud_20_label_correlations", sql("featlong", f"SELECT j, {q6('r')} AS r FROM (SELECT j, corr(v, label) AS r FROM featlong WHERE sample_id % 5 <> 0 GROUP BY 1) z WHERE abs(r) >= 0.05"))
def aud_20(spark, d):
    return rounded(audit.label_correlations(feat_long(spark, d).where(f"{ID} % 5 <> 0"), ["j"], "v", "label", 0.05))


@query("aud_21_non_constant", sql("faulty", """
  SELECT sample_id, feature FROM faulty UNPIVOT INCLUDE NULLS (x FOR feature IN (f_click, f_view, f_purchase, f_signup, f_error)) GROUP BY 1, 2
  HAVING count(DISTINCT CASE WHEN isnan(x) THEN NULL ELSE x END) + max(CASE WHEN x IS NULL OR isnan(x) THEN 1 ELSE 0 END) > 1"""))
def aud_21(spark, d):
    return audit.non_constant(win.to_long(b.faulty(spark, d), [ID, "t"], b.FEATURES), [ID, "feature"], "x")


@query("aud_22_key_uniqueness", sql("faulty", "SELECT sample_id, t, count(*) AS n FROM faulty GROUP BY 1, 2 HAVING count(*) > 1"))
def aud_22(spark, d):
    return align.duplicate_keys(b.faulty(spark, d), [ID, "t"])


@query("aud_23_sampling_patterns", sql("faulty windows", """
  WITH p AS (SELECT CAST(window_s AS DOUBLE) AS window_s, sample_id, count(*) AS k, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS s FROM faulty JOIN windows ON t > 0.5 AND t <= 0.5 + window_s GROUP BY 1, 2)
  SELECT p.window_s, count(*) AS trajectories, max(u) AS distinct_times, min(k) AS points_min, max(k) AS points_max, count(DISTINCT s) = 1 AND min(k) = max(u) AS same_pattern
  FROM p JOIN (SELECT CAST(window_s AS DOUBLE) AS window_s, count(DISTINCT t) AS u FROM faulty JOIN windows ON t > 0.5 AND t <= 0.5 + window_s GROUP BY 1) q ON q.window_s = p.window_s GROUP BY 1"""))
def aud_23(spark, d):
    return audit.sampling_patterns(b.faulty(spark, d), b.WINDOWS, b.INJECTION)


@query("aud_24_landmark_coverage", sql("evt windows", """
  SELECT e.sample_id, CAST(window_s AS DOUBLE) AS landmark_s FROM evt e CROSS JOIN windows WHERE NOT COALESCE(first_protection_s > window_s, false)"""))
def aud_24(spark, d):
    rows = win.landmark_dataset(b.traj(spark, d), events_row(spark, d), ["f_click"], b.WINDOWS, b.INJECTION)
    return audit.landmark_coverage(rows, events_row(spark, d), b.WINDOWS)


@query("aud_25_allow_list", "SELECT event_type AS feature, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup') GROUP BY 1")
def aud_25(spark, d):
    used = b.table(spark, d, "events").groupBy(F.col("event_type").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    return audit.not_allowed(used, ["click", "view", "purchase", "signup"])
