"""JN: alignment, cohort and confusion joins."""

from pyspark.sql import functions as F

from tracewell.operators import align, splits
from tracewell.operators import windows as win
from tracewell.plans import bindings as b
from tracewell.plans.bindings import define_cte, sql
from tracewell.plans.registry import q6, query, r6, rounded
from tracewell.plans.sections.windows import ID, events_row, reference

define_cte("ext", ["sev"], """
  SELECT split_id, sample_id, class, severity, CASE WHEN split_id = 'low_train_to_high_test' THEN
      CASE WHEN severity > n - tc THEN 'test' WHEN severity = n - tc THEN 'gap_excluded' WHEN severity > m - vc THEN 'validation' ELSE 'train' END
    ELSE CASE WHEN severity <= tc THEN 'test' WHEN severity = tc + 1 THEN 'gap_excluded' WHEN severity <= tc + 1 + vc THEN 'validation' ELSE 'train' END END AS partition
  FROM (SELECT *, n - tc - 1 AS m, greatest(1, CAST(round_even(0.2*(n - tc - 1), 0) AS BIGINT)) AS vc FROM (
    SELECT *, count(*) OVER (PARTITION BY class, split_id) AS n, greatest(1, (count(*) OVER (PARTITION BY class, split_id) + 4) // 5) AS tc
    FROM sev CROSS JOIN (VALUES ('low_train_to_high_test'), ('high_train_to_low_test')) v(split_id)) z) y
  WHERE n >= 6 AND m - vc >= 1""")


@query("jn_01_exact_reference_join", sql("traj", f"""
  SELECT a.sample_id, a.t, {q6('a.f_click')} AS f_click, {q6('r.f_click')} AS f_click_ref, {q6('a.f_view')} AS f_view, {q6('r.f_view')} AS f_view_ref
  FROM traj a JOIN traj r ON r.sample_id = 0 AND r.t = a.t"""))
def jn_01(spark, d):
    t = b.traj(spark, d).select(ID, "t", "f_click", "f_view")
    return rounded(align.join_reference(t, reference(spark, d), ["f_click", "f_view"]))


@query("jn_02_interpolated_reference", sql("bigtraj", f"""
  WITH seg AS (SELECT t AS t0, lead(t) OVER (ORDER BY t) AS t1, f_disc AS v0, lead(f_disc) OVER (ORDER BY t) AS v1 FROM bigtraj WHERE sample_id = (SELECT min(sample_id) FROM bigtraj))
  SELECT sample_id, t, {q6('f_disc')} AS f_disc, {q6('CASE WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0)*(t - t0)/(t1 - t0) END')} AS f_disc_ref
  FROM bigtraj JOIN seg ON (t >= t0 AND t < t1) OR (t1 IS NULL AND t = t0)"""))
def jn_02(spark, d):
    big = b.bigtraj(spark, d).select(ID, "t", "f_disc")
    first = big.agg(F.min(ID).alias(ID))  # the reference trajectory is the one with the smallest id
    return rounded(align.interpolate_reference(big, align.restrict(big, first), ["f_disc"], 2.0, segment=12.0))


@query("jn_03_event_join", sql("traj evt", f"""
  SELECT a.sample_id, a.t, {q6('f_error')} AS f_error, first_protection_s FROM traj a LEFT JOIN evt e ON e.sample_id = a.sample_id"""))
def jn_03(spark, d):
    return rounded(align.join_events(b.traj(spark, d).select(ID, "t", "f_error"), events_row(spark, d)))


@query("jn_04_features_by_split", sql("traj windows cls", f"""
  SELECT r.sample_id, window_s, split_id, partition, f_click__mean FROM (
    SELECT sample_id, CAST(w.window_s AS DOUBLE) AS window_s, {q6('avg(f_click) FILTER (t > 0.5)')} AS f_click__mean FROM traj JOIN windows w ON t <= 0.5 + w.window_s GROUP BY 1, 2) r
  JOIN (SELECT sample_id, split_id, CASE p WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS partition FROM (
    SELECT sample_id, 'mod10' AS split_id, (ROW_NUMBER() OVER (PARTITION BY class ORDER BY sample_id) - 1) % 10 AS p FROM cls
    UNION ALL SELECT sample_id, 'mod5', (ROW_NUMBER() OVER (PARTITION BY class ORDER BY sample_id) - 1) % 5 FROM cls) z) s ON s.sample_id = r.sample_id"""))
def jn_04(spark, d):
    rows = win.window_summary(b.traj(spark, d), ["f_click"], b.WINDOWS, b.INJECTION).select(ID, "window_s", r6("f_click__mean").alias("f_click__mean"))
    c = b.cls(spark, d)
    a = splits.interleaved(c, ["class"], ID, 10, min_size=1).withColumn("split_id", F.lit("mod10"))
    s = a.unionByName(splits.interleaved(c, ["class"], ID, 5, min_size=1).withColumn("split_id", F.lit("mod5")))
    return align.join_splits(rows, s.select(ID, "split_id", "partition"))


@query("jn_05_nearest_train_severity", sql("ext", """
  SELECT te.split_id, te.class, te.sample_id, CAST(te.severity AS DOUBLE) AS test_value,
         CAST(min_by(tr.severity, abs(tr.severity - te.severity)*1000000 + tr.severity) AS DOUBLE) AS nearest_train, CAST(min(abs(tr.severity - te.severity)) AS DOUBLE) AS gap
  FROM ext te JOIN ext tr ON tr.split_id = te.split_id AND tr.class = te.class AND tr.partition = 'train' WHERE te.partition = 'test' GROUP BY 1, 2, 3, 4"""))
def jn_05(spark, d):
    return align.nearest_in_train(splits.extrapolation(b.sev(spark, d), "class", "severity", ID))


@query("jn_06_cohort_in_all_windows", sql("traj evt windows", """
  SELECT sample_id, count(*) AS rows FROM traj WHERE sample_id IN (
    SELECT e.sample_id FROM evt e JOIN windows w ON e.first_protection_s > w.window_s WHERE w.window_s IN (3, 6) GROUP BY 1 HAVING count(DISTINCT window_s) = 2) GROUP BY 1"""))
def jn_06(spark, d):
    cohort = align.in_all_windows(strict_rows(spark, d), [3, 6])
    return align.restrict(b.traj(spark, d), cohort).groupBy(ID).agg(F.count(F.lit(1)).alias("rows"))


def strict_rows(spark, d):
    """(trajectory, window) pairs whose event is later than the window's last sample."""
    rows = win.window_summary(b.traj(spark, d), ["f_click"], b.WINDOWS, b.INJECTION).select(ID, "window_s", "last_sample_s")
    return win.strict_pre_event(align.join_events(rows, events_row(spark, d)), "first_protection_s").where("strict_pre_event")


@query("jn_07_missing_ids", sql("", """
  SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT 'user', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"""))
def jn_07(spark, d):
    expected = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    seen = b.table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    users = b.table(spark, d, "events").select(F.col("user_id").alias("id"))
    return align.missing_keys(expected, seen, ["id"]).select(F.lit("customer").alias("kind"), "id").unionByName(
        align.missing_keys(expected, users, ["id"]).select(F.lit("user").alias("kind"), "id"))


_SCENARIO = """SELECT o_orderkey AS scenario_id, CAST(floor(o_totalprice/100000) AS BIGINT) AS start_pct, month(o_orderdate) AS end_pct, o_orderstatus AS category FROM orders"""


@query("jn_08_matching_reference", f"""
  WITH s AS ({_SCENARIO}) SELECT r.scenario_id, r.start_pct, CAST(r.end_pct AS BIGINT) AS end_pct, n.reference_id FROM s r
  JOIN (SELECT start_pct, end_pct, min(scenario_id) AS reference_id FROM s WHERE category = 'O' GROUP BY 1, 2) n USING (start_pct, end_pct) WHERE r.category <> 'O'""")
def jn_08(spark, d):
    s = b.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("scenario_id"), F.floor(F.col("o_totalprice") / 100000).alias("start_pct"),
        F.month("o_orderdate").cast("long").alias("end_pct"), F.col("o_orderstatus").alias("category"))
    refs = s.where("category = 'O'").groupBy("start_pct", "end_pct").agg(F.min("scenario_id").alias("scenario_id"))
    return align.match_condition(s.where("category <> 'O'"), refs, ["start_pct", "end_pct"]).drop("category")


define_cte("mode_metrics", [], """
  SELECT l_shipdate_year AS split, model, input_group, avg(hit) AS accuracy, count(*) AS n FROM (
    SELECT CAST(year(l_shipdate) AS BIGINT) AS l_shipdate_year, l_linestatus AS model, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS input_group,
           CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS hit FROM lineitem) z GROUP BY 1, 2, 3""")


def mode_metrics(spark, d):
    """A metric per (split, model, input group), taken from the line items."""
    g = F.col("l_linenumber") % 3
    return b.table(spark, d, "lineitem").groupBy(
        F.year("l_shipdate").cast("long").alias("split"), F.col("l_linestatus").alias("model"),
        F.when(g == 0, "A").when(g == 1, "B").otherwise("C").alias("input_group"),
    ).agg(F.avg(F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("jn_09_baseline_delta", sql("mode_metrics", f"""
  SELECT m.split, m.model, m.input_group, {q6('m.accuracy')} AS accuracy, m.n, {q6('a.accuracy')} AS accuracy_baseline, {q6('m.accuracy - a.accuracy')} AS accuracy_delta
  FROM mode_metrics m LEFT JOIN mode_metrics a ON a.split = m.split AND a.model = m.model AND a.input_group = 'A'"""))
def jn_09(spark, d):
    return rounded(align.baseline_delta(mode_metrics(spark, d), ["split", "model"], "input_group", "A", "accuracy"))


@query("jn_10_flag_selected", sql("mode_metrics", """
  SELECT split, model, input_group, n, ROW_NUMBER() OVER (PARTITION BY split ORDER BY accuracy DESC, model, input_group) = 1 AS validation_selected FROM mode_metrics"""))
def jn_10(spark, d):
    from tracewell.operators.ranking import best_per_group

    m = mode_metrics(spark, d)
    best = best_per_group(m, ["split"], [F.col("accuracy").desc(), "model", "input_group"])
    return align.flag_selected(m, best, ["split", "model", "input_group"]).drop("accuracy")


@query("jn_11_dense_confusion", sql("scored", """
  SELECT g.grp, l.y_true, m.y_pred, count(s.row_id) AS count FROM (SELECT DISTINCT grp FROM scored) g
  CROSS JOIN (VALUES ('A'),('N'),('R'),('Z')) l(y_true) CROSS JOIN (VALUES ('A'),('N'),('R'),('Z')) m(y_pred)
  LEFT JOIN scored s ON s.grp = g.grp AND s.y_true = l.y_true AND s.y_pred = m.y_pred GROUP BY 1, 2, 3"""))
def jn_11(spark, d):
    return align.dense_confusion(scored_pred(spark, d), ["grp"], [*b.LABELS, "Z"])


def scored_pred(spark, d):
    from tracewell.functions.scalars import argmax_label

    p = b.pred(spark, d)
    probs = F.array("p_a", "p_n", "p_r")
    return p.withColumn("y_pred", argmax_label(probs, b.LABELS)).withColumn("conf", F.array_max(probs))


@query("jn_12_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def jn_12(spark, d):
    return align.duplicate_keys(b.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("jn_13_unordered_pairs", sql("scored", """
  SELECT grp, least(y_true, y_pred) AS left_class, greatest(y_true, y_pred) AS right_class, count(*) FILTER (y_true < y_pred) AS forward_count,
         count(*) FILTER (y_true > y_pred) AS reverse_count, count(*) AS pair_count FROM scored WHERE y_true <> y_pred GROUP BY 1, 2, 3"""))
def jn_13(spark, d):
    return align.unordered_pairs(align.dense_confusion(scored_pred(spark, d), ["grp"], b.LABELS), ["grp"])
