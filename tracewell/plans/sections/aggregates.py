"""AGG, SRT, SET: grouped statistics, ordering and set operations."""

from pyspark.sql import functions as F

from tracewell.operators import aggregates as agg
from tracewell.operators import align, ranking
from tracewell.operators import windows as win
from tracewell.plans import bindings as b
from tracewell.plans.bindings import define_cte, sql
from tracewell.plans.registry import q6, query, rounded
from tracewell.plans.sections.joins import mode_metrics, scored_pred
from tracewell.plans.sections.windows import ID, events_row, long_traj, score_long, win_10a, win_11


@query("agg_01_baseline_scale", sql("long", f"""
  SELECT feature, {q6('CASE WHEN greatest(stddev_samp(x), 0.01*median(abs(x))) >= 1e-6 THEN greatest(stddev_samp(x), 0.01*median(abs(x))) END')} AS scale
  FROM long WHERE t <= 10 GROUP BY 1"""))
def agg_01(spark, d):
    return rounded(agg.baseline_scale(long_traj(spark, d).where("t <= 10")))


define_cte("biglong", ["bigtraj"], "SELECT sample_id, t, feature, x FROM bigtraj UNPIVOT (x FOR feature IN (f_qty, f_price, f_disc, f_tax))")
define_cte("robust", ["biglong"], """
  SELECT feature, max(center) AS center, median(abs(x - center)) AS mad, greatest(1.4826*median(abs(x - center)), 0.01*median(abs(x)), 1e-12) AS scale
  FROM (SELECT *, median(x) OVER (PARTITION BY feature) AS center FROM biglong) z GROUP BY 1""")


def big_long(spark, d):
    return win.to_long(b.bigtraj(spark, d), [ID, "t"], ["f_qty", "f_price", "f_disc", "f_tax"])


@query("agg_02_robust_scale", sql("robust", f"SELECT feature, {q6('center')} AS center, {q6('mad')} AS mad, {q6('scale')} AS scale, mad > 1e-10 AS active FROM robust"))
def agg_02(spark, d):
    return rounded(agg.robust_scale(big_long(spark, d)))


@query("agg_03_active_features", sql("robust", f"SELECT feature, {q6('mad')} AS mad FROM robust WHERE mad > 1e-10"))
def agg_03(spark, d):
    return rounded(agg.robust_scale(big_long(spark, d)).where("active").select("feature", "mad"))


def describe_sql(v, prefix=""):
    s = f"CASE WHEN count({v}) > 1 THEN stddev_samp({v}) WHEN count({v}) = 1 THEN 0 END"
    m = f"CASE WHEN count({v}) > 1 THEN 1.96*stddev_samp({v})/sqrt(count({v})) ELSE 0 END"
    return (f"count({v}) AS {prefix}n, {q6(f'avg({v})')} AS {prefix}mean, {q6(s)} AS {prefix}std, {q6(f'median({v})')} AS {prefix}median, "
            f"{q6(f'min({v})')} AS {prefix}min, {q6(f'max({v})')} AS {prefix}max, {q6(f'avg({v}) - {m}')} AS {prefix}ci95_low, {q6(f'avg({v}) + {m}')} AS {prefix}ci95_high")


@query("agg_04_describe", f"SELECT l_returnflag, l_linestatus, {describe_sql('l_extendedprice')} FROM lineitem GROUP BY 1, 2")
def agg_04(spark, d):
    return rounded(agg.describe(b.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"))


@query("agg_05_metric_summary", sql("mode_metrics", f"""
  SELECT m.input_group, {describe_sql('accuracy', 'accuracy_')}, max(c) AS selected_model_counts FROM mode_metrics m
  JOIN (SELECT input_group, string_agg(model || '=' || k, ';' ORDER BY model) AS c FROM (SELECT input_group, model, count(*) AS k FROM mode_metrics GROUP BY 1, 2) z GROUP BY 1) s
    ON s.input_group = m.input_group GROUP BY 1"""))
def agg_05(spark, d):
    out = agg.metric_summary(mode_metrics(spark, d), ["input_group"], ["accuracy"], "model")
    return rounded(out.withColumn("accuracy_n", F.col("accuracy_n").cast("long")))


define_cte("recalls", ["scored"], """
  SELECT *, max(support) OVER (PARTITION BY y_true) AS cohort_support FROM (
    SELECT row_id % 50 AS split, y_true, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS support FROM scored GROUP BY 1, 2) z""")


def recalls(spark, d):
    from pyspark.sql import Window

    r = scored_pred(spark, d).groupBy((F.col("row_id") % 50).alias("split"), "y_true").agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("recall"), F.count(F.lit(1)).alias("support"))
    return r.withColumn("cohort_support", F.max("support").over(Window.partitionBy("y_true")))


@query("agg_06_recall_stability", sql("recalls", f"""
  SELECT y_true, max(cohort_support) AS cohort_support, count(*) AS n_splits, count(*) FILTER (support > 0) AS n_evaluable_splits, {q6('avg(support)')} AS support_mean,
         min(support) AS support_min, max(support) AS support_max, count(*) FILTER (support >= 3) AS n_splits_support_ge_3, count(*) FILTER (support >= 5) AS n_splits_support_ge_5,
         CASE WHEN max(cohort_support) = 0 THEN 'not_evaluable_no_strict_trajectory' WHEN min(support) < 5 THEN 'low_support' ELSE 'evaluable' END AS status,
         max(cohort_support) > 0 AND min(support) >= 5 AS reliable_for_gate, {describe_sql('recall', 'recall_')} FROM recalls GROUP BY 1"""))
def agg_06(spark, d):
    return rounded(agg.recall_stability(recalls(spark, d), ["y_true"]))


@query("agg_07_confusion_stability", sql("scored", f"""
  WITH p AS (SELECT row_id % 50 AS split, least(y_true, y_pred) AS left_class, greatest(y_true, y_pred) AS right_class, count(*) FILTER (y_true < y_pred) AS f,
      count(*) FILTER (y_true > y_pred) AS r FROM scored WHERE y_true <> y_pred GROUP BY 1, 2, 3),
  g AS (SELECT * FROM (SELECT DISTINCT row_id % 50 AS split FROM scored) s CROSS JOIN (VALUES ('A','N'),('A','R'),('N','R')) v(left_class, right_class)),
  q AS (SELECT g.*, COALESCE(f, 0) AS f, COALESCE(r, 0) AS r FROM g LEFT JOIN p USING (split, left_class, right_class))
  SELECT left_class, right_class, count(DISTINCT split) AS n_splits, count(*) FILTER (f + r > 0) AS split_count_present, {q6('avg(CASE WHEN f + r > 0 THEN 1.0 ELSE 0.0 END)')} AS pair_frequency,
         avg(CASE WHEN f + r > 0 THEN 1.0 ELSE 0.0 END) >= 0.5 AS stable_frequency_ge_50pct, {q6('avg(f)')} AS forward_count_mean, {q6('avg(r)')} AS reverse_count_mean,
         {q6('avg(f + r)')} AS pair_count_mean, max(f + r) AS pair_count_max FROM q GROUP BY 1, 2"""))
def agg_07(spark, d):
    s = scored_pred(spark, d).withColumn("split", F.col("row_id") % 50)
    pairs = align.unordered_pairs(align.dense_confusion(s, ["split"], b.LABELS), ["split"])
    return rounded(agg.confusion_stability(pairs, [], ["split"]))


@query("agg_08_support_table", sql("ext", """
  SELECT g.split_id, c.class, count(*) FILTER (partition='train') AS train_n, count(*) FILTER (partition='validation') AS validation_n, count(*) FILTER (partition='test') AS test_n
  FROM (SELECT DISTINCT split_id FROM ext) g CROSS JOIN (VALUES ('AUTOMOBILE'),('BUILDING'),('FURNITURE'),('HOUSEHOLD'),('MACHINERY'),('NONE')) c(class)
  LEFT JOIN ext e ON e.split_id = g.split_id AND e.class = c.class GROUP BY 1, 2"""))
def agg_08(spark, d):
    from tracewell.operators import splits

    e = splits.extrapolation(b.sev(spark, d), "class", "severity", ID)
    return agg.support_table(e, ["split_id"], "class", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE"], ["train", "validation", "test"])


@query("agg_09_alarm_summary", sql("alarms cls", f"""
  SELECT class, count(*) AS n, count(first_alarm_s) AS n_alarm, {q6('avg(CASE WHEN first_alarm_s IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS alarm_rate, {q6('median(first_alarm_s)')} AS median_first_alarm_s
  FROM alarms JOIN cls USING (sample_id) GROUP BY 1"""))
def agg_09(spark, d):
    return rounded(agg.alarm_summary(win_10a(spark, d).join(b.cls(spark, d), ID), ["class"]))


@query("agg_10_detection_summary", sql("alarms evt", f"""
  SELECT 'composite' AS method, count(*) AS n, count(first_alarm_s) AS detected_count, count(*) FILTER (first_alarm_s < first_protection_s) AS before_event_count,
         {q6('count(first_alarm_s)/count(*)')} AS detection_rate, {q6('count(*) FILTER (first_alarm_s < first_protection_s)/count(*)')} AS before_event_rate,
         min(first_alarm_s) AS detection_min_s, max(first_alarm_s) AS detection_max_s, min(first_protection_s-first_alarm_s) AS lead_min_s, max(first_protection_s-first_alarm_s) AS lead_max_s,
         {q6('median(first_alarm_s)')} AS detection_median_s, {q6('median(first_protection_s-first_alarm_s)')} AS lead_median_s
  FROM alarms a LEFT JOIN evt e USING (sample_id)"""))
def agg_10(spark, d):
    return rounded(agg.detection_summary(win_11(spark, d).withColumn("method", F.lit("composite")), ["method"]))


define_cte("eta", ["featlong"], """
  SELECT j, ssb/(ssb + ssw + 1e-12) AS between_share FROM (
    SELECT j, sum(n*(m-g)*(m-g)) AS ssb, sum(n*v) AS ssw FROM (
      SELECT *, sum(n*m) OVER (PARTITION BY j)/sum(n) OVER (PARTITION BY j) AS g FROM (
        SELECT j, label, count(*) AS n, avg(v) AS m, var_pop(v) AS v FROM featlong GROUP BY 1, 2) z) y GROUP BY 1) x""")


def feat_long(spark, d):
    return b.feat(spark, d).select(ID, "label", "family", F.posexplode("x").alias("j", "v")).withColumn("j", F.col("j").cast("long"))


@query("agg_11_between_class_share", sql("eta", f"SELECT j, {q6('between_share')} AS between_share FROM eta"))
def agg_11(spark, d):
    return rounded(agg.between_class_share(feat_long(spark, d), ["j"], "label", "v"))


@query("agg_12_spearman", sql("bigtraj", f"""
  SELECT feature, count(*) AS n, {q6('abs(corr(rx, ry))')} AS spearman_abs FROM (
    SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1)/2.0 AS rx,
           rank() OVER (PARTITION BY feature ORDER BY t) + (count(*) OVER (PARTITION BY feature, t) - 1)/2.0 AS ry
    FROM (SELECT t, f_qty, f_price FROM bigtraj) UNPIVOT (x FOR feature IN (f_qty, f_price))) z GROUP BY 1"""))
def agg_12(spark, d):
    long = b.bigtraj(spark, d).unpivot(["t"], ["f_qty", "f_price"], "feature", "x")
    return rounded(agg.spearman_abs(long.withColumn("x", F.round("x", 6)), ["feature"], "x", "t"))


@query("agg_13_quantiles", sql("", f"""
  WITH s AS (SELECT l_returnflag, l_extendedprice AS v, ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
  SELECT l_returnflag, max(n) AS n, {q6('quantile_cont(v, 0.9)')} AS q_linear, {q6('max(CASE WHEN k = floor(round(0.9*(n-1), 9)) THEN v END)')} AS q_lower,
         {q6('max(CASE WHEN k = ceil(round(0.9*(n-1), 9)) THEN v END)')} AS q_higher,
         {q6('max(CASE WHEN k = least(n-1, greatest(0, ceil(round((n+1)*0.9, 9))-1)) THEN v END)')} AS q_conformal FROM s GROUP BY 1"""))
def agg_13(spark, d):
    return rounded(agg.quantile_table(b.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9, 0.1))


@query("agg_14_most_frequent", sql("scored", """
  SELECT y_true, min_by(y_pred, -n) AS majority, max(n) AS votes FROM (SELECT y_true, y_pred, count(*) AS n FROM scored WHERE y_true <> y_pred GROUP BY 1, 2 ORDER BY 1, 2) z GROUP BY 1"""))
def agg_14(spark, d):
    return agg.most_frequent(scored_pred(spark, d).where("y_true <> y_pred"), ["y_true"], "y_pred")


@query("agg_15_crosstab", """SELECT l_returnflag, count(*) FILTER (l_linestatus='F') AS "F", count(*) FILTER (l_linestatus='O') AS "O", count(*) FILTER (l_linestatus='X') AS "X" FROM lineitem GROUP BY 1""")
def agg_15(spark, d):
    return agg.crosstab(b.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O", "X"])


@query("agg_16_peak_and_top_share", sql("devlong", f"""
  SELECT feature, max(n) AS n, {q6('max(score)')} AS peak, {q6('median(score) FILTER (rn <= greatest(1, ceil(round(0.1*n, 9))))')} AS top_median FROM (
    SELECT feature, score, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY score DESC) AS rn, count(*) OVER (PARTITION BY feature) AS n FROM devlong WHERE score IS NOT NULL) z GROUP BY 1"""))
def agg_16(spark, d):
    return rounded(agg.peak_and_top_share(score_long(spark, d), ["feature"], "score"))


@query("agg_17_pairwise_correlation", sql("bigtraj", f"""
  SELECT 'f_qty' AS left_feature, 'f_price' AS right_feature, {q6('corr(f_qty, f_price)')} AS r FROM bigtraj
  UNION ALL SELECT 'f_qty', 'f_disc', {q6('corr(f_qty, f_disc)')} FROM bigtraj UNION ALL SELECT 'f_qty', 'f_tax', {q6('corr(f_qty, f_tax)')} FROM bigtraj
  UNION ALL SELECT 'f_price', 'f_disc', {q6('corr(f_price, f_disc)')} FROM bigtraj UNION ALL SELECT 'f_price', 'f_tax', {q6('corr(f_price, f_tax)')} FROM bigtraj
  UNION ALL SELECT 'f_disc', 'f_tax', {q6('corr(f_disc, f_tax)')} FROM bigtraj"""))
def agg_17(spark, d):
    return rounded(agg.pairwise_correlations(b.bigtraj(spark, d), ["f_qty", "f_price", "f_disc", "f_tax"]))


@query("agg_17_redundancy_prune", sql("bigtraj", """
  SELECT feature FROM (SELECT 'f_qty' AS feature, 1 AS k FROM bigtraj UNION SELECT 'f_disc', 3 FROM bigtraj UNION SELECT 'f_tax', 4 FROM bigtraj
    UNION SELECT 'f_price', 2 FROM (SELECT corr(f_qty, f_price) AS r FROM bigtraj) z WHERE abs(r) < 0.9) y"""))
def agg_17b(spark, d):
    names = ["f_qty", "f_price", "f_disc", "f_tax"]
    kept = agg.prune_redundant(agg.pairwise_correlations(b.bigtraj(spark, d), names), names, 0.9)
    return spark.createDataFrame([(k,) for k in kept], "feature string")


@query("agg_18_alarm_time_distribution", sql("alarms", "SELECT first_alarm_s, count(*) AS n FROM alarms GROUP BY 1"))
def agg_18(spark, d):
    return agg.first_alarm_histogram(win_10a(spark, d))


@query("agg_18_id_score_correlation", sql("composite", f"SELECT {q6('corr(sample_id, peak)')} AS r, count(*) AS n FROM (SELECT sample_id, max(composite) AS peak FROM composite GROUP BY 1) z"))
def agg_18b(spark, d):
    from tracewell.plans.sections.windows import scored

    peaks = scored(spark, d).groupBy(ID).agg(F.max("composite").alias("peak"))
    return rounded(peaks.agg(F.corr(ID, "peak").alias("r"), F.count(F.lit(1)).alias("n")))


@query("agg_19_distinct_counts", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def agg_19(spark, d):
    return agg.distinct_counts(b.table(spark, d, "lineitem"), ["l_returnflag"], {"orders": "l_orderkey", "suppliers": "l_suppkey"})


@query("agg_20_balanced_weights", sql("cls", f"""
  SELECT sample_id, class, {q6('(SELECT count(*) FROM cls)/((SELECT count(DISTINCT class) FROM cls)*count(*) OVER (PARTITION BY class))')} AS weight FROM cls"""))
def agg_20(spark, d):
    return rounded(agg.balanced_weights(b.cls(spark, d), "class"))


# ---------------------------------------------------------------- sorting, top-k, sets


@query("srt_01_mixed_order", f"SELECT o_orderkey, o_orderstatus, {q6('o_totalprice')} AS o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def srt_01(spark, d):
    o = b.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rounded(o.orderBy("o_orderstatus", F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(50))


@query("srt_02_best_per_group", sql("mode_metrics", f"""
  SELECT split, model, input_group, {q6('accuracy')} AS accuracy, n FROM mode_metrics QUALIFY ROW_NUMBER() OVER (PARTITION BY split ORDER BY accuracy DESC, n DESC, model, input_group) = 1"""))
def srt_02(spark, d):
    return rounded(ranking.best_per_group(mode_metrics(spark, d), ["split"], [F.col("accuracy").desc(), F.col("n").desc(), "model", "input_group"]))


@query("srt_03_held_out_row", sql("mode_metrics", f"""
  SELECT b.split, b.model, b.input_group, {q6('b.accuracy')} AS accuracy, b.n FROM (
    SELECT * FROM mode_metrics WHERE split % 2 = 1 QUALIFY ROW_NUMBER() OVER (PARTITION BY split ORDER BY accuracy DESC, model, input_group) = 1) a
  JOIN mode_metrics b ON b.split = a.split - 1 AND b.model = a.model AND b.input_group = a.input_group"""))
def srt_03(spark, d):
    m = mode_metrics(spark, d)
    sel = ranking.best_per_group(m.where("split % 2 = 1"), ["split"], [F.col("accuracy").desc(), "model", "input_group"])
    sel = sel.withColumn("split", F.col("split") - 1).join(m.select("split").distinct(), "split", "left_semi")
    return rounded(ranking.held_out_row(sel, m, ["split", "model", "input_group"]))


@query("srt_04_extreme_rows", f"""
  SELECT * FROM (SELECT 'largest' AS side, l_orderkey, l_partkey, l_suppkey, {q6('l_extendedprice')} AS v FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey LIMIT 10) x
  UNION ALL SELECT * FROM (SELECT 'smallest', l_orderkey, l_partkey, l_suppkey, {q6('l_extendedprice')} FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey LIMIT 10) y""")
def srt_04(spark, d):
    li = b.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("v"))
    ties = ["l_orderkey", "l_partkey", "l_suppkey"]
    hi = ranking.extreme_rows(li, "v", 10, ties).select(F.lit("largest").alias("side"), "*")
    return rounded(hi.unionByName(ranking.extreme_rows(li, "v", 10, ties, False).select(F.lit("smallest").alias("side"), "*")))


@query("srt_04_top_features_per_row", sql("featlong", f"""
  SELECT sample_id, j, {q6('v')} AS v, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY abs(v) DESC, j) AS rank FROM featlong) z WHERE rank <= 3"""))
def srt_04b(spark, d):
    top = ranking.top_per_group(feat_long(spark, d), [ID], [F.abs("v").desc(), "j"], 3)
    return rounded(top.select(ID, "j", "v", "rank"))


@query("set_01_heterogeneous_union", sql("mode_metrics", f"""
  SELECT split, model, input_group, {q6('accuracy')} AS accuracy, n, CAST(NULL AS VARCHAR) AS status FROM mode_metrics
  UNION ALL SELECT CAST(year(o_orderdate) AS BIGINT), NULL, NULL, NULL, count(*), o_orderstatus FROM orders GROUP BY 1, o_orderstatus"""))
def set_01(spark, d):
    o = b.table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("split"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(ranking.union_all([mode_metrics(spark, d), o]))


@query("set_02_set_algebra", """
  SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) a
  UNION ALL SELECT 'only_left', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) z""")
def set_02(spark, d):
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(c.intersect(o), "both").unionByName(count(c.subtract(o), "only_left"))


@query("set_03_consistent_entities", "SELECT l_orderkey, min(l_linestatus) AS l_linestatus, min(l_linestatus) = max(l_linestatus) AS consistent FROM lineitem GROUP BY 1")
def set_03(spark, d):
    return ranking.consistent_entities(b.table(spark, d, "lineitem"), "l_orderkey", ["l_linestatus"])
