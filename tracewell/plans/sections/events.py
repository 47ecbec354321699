"""EVT: event log parsing and first-event tables."""

from pyspark.sql import functions as F

from tracewell.operators import events as evt
from tracewell.plans import bindings as b
from tracewell.plans.bindings import define_cte, sql
from tracewell.plans.registry import q6, query, rounded
from tracewell.plans.sections.windows import ID

_TAX = ", ".join(f"({i}, '{c}', '(?i)' || '{rx}')" for i, (c, rx) in enumerate(evt.TAXONOMY.items()))
define_cte("hits", ["parsed"], f"""
  SELECT p.*, x.tax_no, x.category FROM parsed p JOIN (VALUES {_TAX}) x(tax_no, category, rx) ON regexp_matches(p.description, x.rx)
  WHERE NOT regexp_matches(p.description, '{evt.INJECTION}')""")
define_cte("inj", ["parsed"], f"""
  SELECT sample_id, min_by(t, line_no) AS injection_s, min_by(description, line_no) AS injection_event FROM parsed WHERE regexp_matches(description, '{evt.INJECTION}') GROUP BY 1""")
define_cte("firstprot", ["hits"], """
  SELECT sample_id, t AS first_protection_s, description AS first_protection_event, category AS first_protection_category FROM (
    SELECT h.*, s.seen FROM hits h JOIN (SELECT sample_id, category, min(line_no*100 + tax_no) AS seen FROM hits GROUP BY 1, 2) s USING (sample_id, category)) z
  QUALIFY ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY t, seen, line_no) = 1""")
define_cte("reports", ["evlog", "hits", "inj", "firstprot"], """
  SELECT l.sample_id, report_line_count, injection_s, injection_event, injection_s IS NOT NULL AS injection_parse_ok, first_protection_s, first_protection_event, first_protection_category,
         COALESCE(n, 0) AS protection_match_count, COALESCE(cats, '') AS protection_categories, COALESCE(ex, '') AS protection_match_examples, first_protection_s IS NOT NULL AS event_parse_ok
  FROM (SELECT sample_id, count(*) AS report_line_count FROM evlog GROUP BY 1) l LEFT JOIN inj USING (sample_id) LEFT JOIN firstprot USING (sample_id)
  LEFT JOIN (SELECT sample_id, sum(k)::BIGINT AS n, string_agg(category, ';' ORDER BY seen) AS cats FROM (SELECT sample_id, category, count(*) AS k, min(line_no*100+tax_no) AS seen FROM hits GROUP BY 1, 2) z GROUP BY 1) c USING (sample_id)
  LEFT JOIN (SELECT sample_id, string_agg(CAST(CAST(t AS BIGINT) AS VARCHAR) || ' sec, ' || description, ' || ' ORDER BY rn) AS ex FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY line_no, tax_no) AS rn FROM hits) z WHERE rn <= 8 GROUP BY 1) e USING (sample_id)""")


@query("evt_01_parse_lines", sql("parsed", "SELECT sample_id, line_no, t, description FROM parsed"))
def evt_01(spark, d):
    return evt.parse_lines(b.evlog(spark, d))


@query("evt_02_first_injection", sql("parsed inj", "SELECT p.sample_id, injection_s, injection_event FROM (SELECT DISTINCT sample_id FROM parsed) p LEFT JOIN inj USING (sample_id)"))
def evt_02(spark, d):
    return evt.first_injection(evt_01(spark, d))


@query("evt_03_taxonomy_matches", sql("hits", "SELECT sample_id, line_no, t, description, tax_no, category FROM hits"))
def evt_03(spark, d):
    return evt.match_taxonomy(evt_01(spark, d))


@query("evt_04_named_event_times", sql("parsed", "SELECT sample_id, " + ", ".join(
    f"min_by(t, line_no) FILTER (regexp_matches(description, '{rx}')) AS {n}" for n, rx in evt.NAMED_EVENTS.items()) + " FROM parsed GROUP BY 1"))
def evt_04(spark, d):
    return evt.first_named_events(evt_01(spark, d))


@query("evt_04_earliest_event_times", sql("parsed", "SELECT sample_id, min(t) FILTER (regexp_matches(description, 'Reactor Scram')) AS scram_s, min(t) FILTER (regexp_matches(description, 'Turbine Trip')) AS trip_s FROM parsed GROUP BY 1"))
def evt_04b(spark, d):
    return evt.first_named_events(evt_01(spark, d), {"scram_s": "Reactor Scram", "trip_s": "Turbine Trip"}, earliest=True)


@query("evt_05_first_protection", sql("parsed", r"""
  SELECT *, CASE WHEN first_protection_s IS NULL THEN NULL WHEN scram_s = first_protection_s THEN 'scram_s' ELSE 'hpi_pump_1_s' END AS first_protection_event FROM (
    SELECT *, least(scram_s, hpi_pump_1_s) AS first_protection_s FROM (
      SELECT sample_id, min_by(t, line_no) FILTER (regexp_matches(description, 'Reactor Scram')) AS scram_s, min_by(t, line_no) FILTER (regexp_matches(description, 'HPI Pump #1 Position Change: 100%')) AS hpi_pump_1_s
      FROM parsed GROUP BY 1) z) y"""))
def evt_05(spark, d):
    named = evt.first_named_events(evt_01(spark, d)).select(ID, "scram_s", "hpi_pump_1_s")
    return evt.first_protection(named, ["scram_s", "hpi_pump_1_s"])


@query("evt_06_report_table", sql("reports", "SELECT * FROM reports"))
def evt_06(spark, d):
    return evt.report_table(b.evlog(spark, d))


@query("evt_07_parse_coverage", sql("reports cls", f"""
  SELECT class, count(*) AS trajectories, count(report_line_count) AS reports, count(injection_s) AS injection_parsed, count(first_protection_s) AS protection_parsed,
         {q6('avg(CASE WHEN first_protection_s IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS protection_rate FROM cls LEFT JOIN reports USING (sample_id) GROUP BY 1"""))
def evt_07(spark, d):
    return rounded(evt.parse_coverage(evt_06(spark, d), b.cls(spark, d)))


@query("evt_07_category_coverage", sql("hits cls", """
  SELECT s.category, matches, trajectories, classes, examples FROM (
    SELECT category, count(*) AS matches, count(DISTINCT h.sample_id) AS trajectories, count(DISTINCT class) AS classes FROM hits h JOIN cls USING (sample_id) GROUP BY 1) s
  JOIN (SELECT category, string_agg(description, ' || ' ORDER BY description) AS examples FROM (
    SELECT category, description, ROW_NUMBER() OVER (PARTITION BY category ORDER BY description) AS rn FROM (SELECT DISTINCT category, description FROM hits) y) z WHERE rn <= 3 GROUP BY 1) e USING (category)"""))
def evt_07b(spark, d):
    return evt.category_coverage(evt_03(spark, d), b.cls(spark, d))


@query("evt_08_event_table", sql("reports", """
  SELECT c_custkey AS sample_id, report_line_count IS NOT NULL AS report_exists, injection_s, first_protection_s FROM customer LEFT JOIN reports ON sample_id = c_custkey"""))
def evt_08(spark, d):
    inv = b.table(spark, d, "customer").select(F.col("c_custkey").alias(ID))
    return evt.event_table(inv, evt_06(spark, d)).select(ID, "report_exists", "injection_s", "first_protection_s")


@query("evt_09_sensor_event_skew", sql("traj firstprot", f"""
  SELECT t.sample_id, f_error_first_positive_s, {q6('f_error_first_positive_s - first_protection_s/86400')} AS sensor_minus_log FROM (
    SELECT sample_id, min(CASE WHEN f_error > 1e-9 THEN t END) AS f_error_first_positive_s FROM traj GROUP BY 1) t LEFT JOIN firstprot USING (sample_id)"""))
def evt_09(spark, d):
    s = evt.sensor_event_time(b.traj(spark, d), "f_error").join(evt_06(spark, d).select(ID, "first_protection_s"), ID, "left")
    return rounded(s.select(ID, "f_error_first_positive_s", (F.col("f_error_first_positive_s") - F.col("first_protection_s") / 86400).alias("sensor_minus_log")))
