"""MET: evaluation metrics."""

from pyspark.sql import functions as F

from tracewell.functions import scalars as sc
from tracewell.operators import align, directional, metrics, ranking, splits
from tracewell.operators import aggregates as agg
from tracewell.plans import bindings as b
from tracewell.plans.bindings import define_cte, sql
from tracewell.plans.registry import q6, query, rounded
from tracewell.plans.sections.audits import gate
from tracewell.plans.sections.joins import mode_metrics, scored_pred
from tracewell.plans.sections.windows import ID

_LAB = "(VALUES ('A'),('N'),('R'),('Z')) l(label)"
LABELS = [*b.LABELS, "Z"]


def metric_cte(src, keys, out, where="true"):
    """SQL label counts of a prediction relation with columns y_true, y_pred."""
    k = ", ".join(keys)
    on = " AND ".join([f"g.{c} = s.{c}" for c in keys])
    g = f"(SELECT DISTINCT {k} FROM {src} WHERE {where}) g CROSS JOIN {_LAB}"
    sel = ", ".join(f"g.{c}" for c in keys)
    define_cte(out, [src], f"""
      SELECT {sel}, l.label, count(*) FILTER (s.y_true = l.label) AS support, count(*) FILTER (s.y_pred = l.label) AS predicted, count(*) FILTER (s.y_true = l.label AND s.y_pred = l.label) AS tp, count(s.y_true) AS n
      FROM {g} LEFT JOIN (SELECT * FROM {src} WHERE {where}) s ON {on} GROUP BY {sel}, l.label""")


metric_cte("scored", ["grp"], "lab")
_F1 = "CASE WHEN support + predicted > 0 THEN 2*tp/(support + predicted) ELSE 0 END"
_REC = "CASE WHEN support > 0 THEN tp/support END"


@query("met_01_classification", sql("lab", f"""
  SELECT grp, max(n) AS n, {q6('sum(tp)/max(n)')} AS accuracy, {q6(f'avg({_REC})')} AS balanced_accuracy, {q6(f'avg({_F1})')} AS macro_f1_fixed, {q6(f'avg({_F1}) FILTER (support > 0)')} AS macro_f1_observed,
         {q6(f'avg({_F1}) FILTER (support >= 3)')} AS macro_f1_support_ge_3, {q6(f'avg({_F1}) FILTER (support >= 5)')} AS macro_f1_support_ge_5 FROM lab GROUP BY 1"""))
def met_01(spark, d):
    return rounded(metrics.classification(scored_pred(spark, d), ["grp"], LABELS))


@query("met_02_per_class", sql("lab", f"""
  SELECT grp, label, support, {q6('CASE WHEN support > 0 THEN CASE WHEN predicted > 0 THEN tp/predicted ELSE 0 END END')} AS precision, {q6(_REC)} AS recall, {q6(f'CASE WHEN support > 0 THEN {_F1} END')} AS f1 FROM lab"""))
def met_02(spark, d):
    return rounded(metrics.per_class(scored_pred(spark, d), ["grp"], LABELS))


@query("met_03_confusion_matrix", sql("scored", """
  SELECT t.l AS y_true, p.l AS y_pred, count(s.row_id) AS count FROM (VALUES ('A'),('N'),('R')) t(l) CROSS JOIN (VALUES ('A'),('N'),('R')) p(l) LEFT JOIN scored s ON s.y_true = t.l AND s.y_pred = p.l GROUP BY 1, 2"""))
def met_03(spark, d):
    return align.dense_confusion(scored_pred(spark, d), [], b.LABELS)


_REG = f"count(*) AS n, {q6('avg(abs(y - p))')} AS mae, {q6('sqrt(avg((y-p)*(y-p)))')} AS rmse, {q6('CASE WHEN var_pop(y) > 0 THEN 1 - sum((y-p)*(y-p))/(var_pop(y)*count(*)) ELSE 0 END')} AS r2"
define_cte("regr", ["bigtraj"], "SELECT sample_id, t, f_price AS y, n*38000.0 + t*10 AS p, n FROM bigtraj")


def regr(spark, d):
    return b.bigtraj(spark, d).select(ID, "t", F.col("f_price").alias("y"), (F.col("n") * 38000.0 + F.col("t") * 10).alias("p"), "n")


@query("met_04_regression", sql("regr", f"SELECT CAST(floor(t/12) AS BIGINT) AS year, {_REG} FROM regr GROUP BY 1"))
def met_04(spark, d):
    return rounded(metrics.regression(regr(spark, d).withColumn("year", F.floor(F.col("t") / 12)), ["year"], "y", "p"))


@query("met_05_subset_regression", sql("regr", f"SELECT 'low' AS subset, {_REG} FROM regr WHERE n <= 3"))
def met_05(spark, d):
    return rounded(metrics.regression(regr(spark, d).where("n <= 3").withColumn("subset", F.lit("low")), ["subset"], "y", "p"))


def selective_sql(cte_all, cte_acc, keys):
    k = ", ".join(keys)
    on = ", ".join(keys)
    return f"""
  SELECT {k}, n_total, COALESCE(n_acc, 0) AS n_accepted, n_total - COALESCE(n_acc, 0) AS n_rejected, {q6('COALESCE(n_acc, 0)/n_total')} AS coverage, {q6('acc')} AS selective_accuracy, {q6('mf')} AS selective_macro_f1,
         {q6('ba')} AS selective_balanced_accuracy, {q6('1 - acc')} AS risk, {q6('1 - COALESCE(n_acc, 0)/n_total')} AS reject_rate
  FROM (SELECT {k}, count(*) AS n_total FROM {cte_all} GROUP BY {k}) t
  LEFT JOIN (SELECT {k}, max(n) AS n_acc, sum(tp)/max(n) AS acc, avg({_F1}) AS mf, avg({_REC}) AS ba FROM {cte_acc} GROUP BY {k}) a USING ({on})"""


metric_cte("scored", ["grp"], "lab_acc", "conf >= 0.45")


@query("met_06_selective", sql("scored lab_acc", selective_sql("scored", "lab_acc", ["grp"])))
def met_06(spark, d):
    return rounded(metrics.selective(scored_pred(spark, d), ["grp"], LABELS, F.col("conf") >= 0.45))


@query("met_06_selective_nothing_accepted", sql("scored", f"""
  SELECT grp, count(*) AS n_total, CAST(0 AS BIGINT) AS n_accepted, count(*) AS n_rejected, 0.0::DOUBLE AS coverage, NULL::DOUBLE AS selective_accuracy, NULL::DOUBLE AS selective_macro_f1, NULL::DOUBLE AS selective_balanced_accuracy, NULL::DOUBLE AS risk, 1.0::DOUBLE AS reject_rate FROM scored GROUP BY 1"""))
def met_06b(spark, d):
    return rounded(metrics.selective(scored_pred(spark, d), ["grp"], LABELS, F.col("conf") > 1.0))


GRID = [round(i * 0.05, 2) for i in range(20)]
define_cte("grid", ["scored"], f"SELECT s.*, threshold, conf >= threshold AS acc FROM scored s CROSS JOIN (VALUES {', '.join(f'({x}::DOUBLE)' for x in GRID)}) v(threshold)")
metric_cte("grid", ["grp", "threshold"], "lab_grid", "acc")


@query("met_07_risk_coverage", sql("grid lab_grid", selective_sql("grid", "lab_grid", ["grp", "threshold"])))
def met_07(spark, d):
    return rounded(metrics.risk_coverage(scored_pred(spark, d), ["grp"], LABELS, "conf", GRID))


@query("met_07_choose_threshold", sql("grid lab_grid", f"""
  SELECT * FROM ({selective_sql("grid", "lab_grid", ["grp", "threshold"])}) z
  QUALIFY ROW_NUMBER() OVER (PARTITION BY grp ORDER BY coverage >= 0.5 DESC, selective_macro_f1 DESC NULLS LAST, selective_accuracy DESC NULLS LAST, coverage DESC, threshold) = 1"""))
def met_07b(spark, d):
    return metrics.choose_threshold(met_07(spark, d), ["grp"])


TARGETS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
_T = ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(TARGETS))
define_cte("comb", ["scored"], f"""
  SELECT s.y_true, s.y_pred, a.t AS good_target, c.t AS bad_target, a.i AS gi, c.i AS bi, a.th AS good_threshold, c.th AS bad_threshold, s.conf >= a.th AND s.p_r <= c.th AS acc FROM scored s
  CROSS JOIN (SELECT i, t, max(v) AS th FROM (SELECT conf AS v, ROW_NUMBER() OVER (ORDER BY conf) - 1 AS k, count(*) OVER () AS n FROM scored) z JOIN (VALUES {_T}) x(i, t) ON k = floor(round((1 - t)*(n - 1), 9)) GROUP BY 1, 2) a
  CROSS JOIN (SELECT i, t, max(v) AS th FROM (SELECT p_r AS v, ROW_NUMBER() OVER (ORDER BY p_r) - 1 AS k, count(*) OVER () AS n FROM scored) z JOIN (VALUES {_T}) x(i, t) ON k = ceil(round(t*(n - 1), 9)) GROUP BY 1, 2) c""")
metric_cte("comb", ["good_target", "bad_target"], "lab_comb", "acc")


@query("met_08_combination_thresholds", sql("comb lab_comb", f"""
  SELECT good_target, bad_target, n_total, n_accepted, n_rejected, coverage, selective_accuracy, selective_macro_f1, selective_balanced_accuracy, risk, reject_rate, {q6('g')} AS good_threshold, {q6('h')} AS bad_threshold FROM (
    {selective_sql("comb", "lab_comb", ["good_target", "bad_target"])}) z JOIN (SELECT good_target, bad_target, max(good_threshold) AS g, max(bad_threshold) AS h FROM comb GROUP BY 1, 2) y USING (good_target, bad_target)"""))
def met_08(spark, d):
    out = metrics.combination_thresholds(scored_pred(spark, d), LABELS, "conf", "p_r", TARGETS, 0.7)
    return rounded(out.drop("position"))


define_cte("combfit", ["scored"], f"""
  SELECT CASE WHEN row_id % 5 = 1 THEN 'validation' ELSE 'test' END AS partition, s.y_true, s.y_pred, a.i AS gi, c.i AS bi, a.t AS good_target, c.t AS bad_target, a.th AS good_threshold, c.th AS bad_threshold, s.conf >= a.th AND s.p_r <= c.th AS acc FROM scored s
  CROSS JOIN (SELECT i, t, max(v) AS th FROM (SELECT conf AS v, ROW_NUMBER() OVER (ORDER BY conf) - 1 AS k, count(*) OVER () AS n FROM scored WHERE row_id % 5 = 1) z JOIN (VALUES {_T}) x(i, t) ON k = floor(round((1 - t)*(n - 1), 9)) GROUP BY 1, 2) a
  CROSS JOIN (SELECT i, t, max(v) AS th FROM (SELECT p_r AS v, ROW_NUMBER() OVER (ORDER BY p_r) - 1 AS k, count(*) OVER () AS n FROM scored WHERE row_id % 5 = 1) z JOIN (VALUES {_T}) x(i, t) ON k = ceil(round(t*(n - 1), 9)) GROUP BY 1, 2) c""")
metric_cte("combfit", ["partition", "gi", "bi"], "lab_combfit", "acc")


@query("met_08_fitted_combination", sql("combfit lab_combfit", f"""
  WITH m AS ({selective_sql("combfit", "lab_combfit", ["partition", "gi", "bi"])}),
  p AS (SELECT gi, bi, ROW_NUMBER() OVER (ORDER BY round(abs(coverage - 0.7), 12), selective_macro_f1 DESC NULLS LAST, selective_accuracy DESC NULLS LAST, gi, bi) AS position FROM m WHERE partition = 'validation'),
  t AS (SELECT gi, bi, max(good_target) AS good_target, max(bad_target) AS bad_target, {q6('max(good_threshold)')} AS good_threshold, {q6('max(bad_threshold)')} AS bad_threshold FROM combfit GROUP BY 1, 2)
  SELECT partition, good_target, bad_target, good_threshold, bad_threshold, n_total, n_accepted, n_rejected, coverage, selective_accuracy, selective_macro_f1, selective_balanced_accuracy, risk, reject_rate, position, position = 1 AS chosen
  FROM m JOIN p USING (gi, bi) JOIN t USING (gi, bi)"""))
def met_08b(spark, d):
    s = scored_pred(spark, d)
    out = metrics.fitted_combination(s.where("row_id % 5 = 1"), s.where("row_id % 5 <> 1"), LABELS, "conf", "p_r", TARGETS, 0.7)
    return rounded(out)


@query("met_09_reliability", sql("scored", f"""
  WITH r AS (SELECT grp, least(floor(conf*10), 9)::INT AS bin, conf, CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END AS ok,
      (p_a - (y_true='A')::INT)**2 + (p_n - (y_true='N')::INT)**2 + (p_r - (y_true='R')::INT)**2 AS br, -ln(CASE y_true WHEN 'A' THEN p_a WHEN 'N' THEN p_n ELSE p_r END) AS ll FROM scored),
  p AS (SELECT grp, bin, count(*) AS count, avg(conf) AS mc, avg(ok) AS ac FROM r GROUP BY 1, 2),
  t AS (SELECT grp, avg(br) AS b, avg(ll) AS l, (SELECT sum(count*abs(mc - ac))/sum(count) FROM p WHERE p.grp = r.grp) AS ece FROM r GROUP BY 1)
  SELECT t.grp, k.bin, {q6('k.bin/10')} AS bin_lower, {q6('(k.bin+1)/10')} AS bin_upper, COALESCE(count, 0) AS count, {q6('mc')} AS mean_confidence, {q6('ac')} AS accuracy, {q6('ece')} AS ece, {q6('b')} AS brier_score, {q6('l')} AS log_loss
  FROM t CROSS JOIN (SELECT bin::INT AS bin FROM range(0,10) x(bin)) k LEFT JOIN p ON p.grp = t.grp AND p.bin = k.bin"""))
def met_09(spark, d):
    s = scored_pred(spark, d).withColumn("probs", F.array("p_a", "p_n", "p_r"))
    return rounded(metrics.reliability(s, ["grp"], "probs", b.LABELS))


ALPHAS = {"a05": 0.05, "a10": 0.10, "a20": 0.20}
define_cte("calib", ["scored"], """
  SELECT row_id, y_true, 1 - CASE y_true WHEN 'A' THEN p_a WHEN 'N' THEN p_n ELSE p_r END AS nc, ROW_NUMBER() OVER (ORDER BY 1 - CASE y_true WHEN 'A' THEN p_a WHEN 'N' THEN p_n ELSE p_r END) - 1 AS k, count(*) OVER () AS n FROM scored WHERE grp = 'F'""")
define_cte("cutoffs", ["calib"], """
  SELECT alpha, max(n) AS calibration_n, 1 - max(nc) AS cutoff FROM calib JOIN (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) v(alpha) ON k = least(n - 1, greatest(0, ceil(round((n + 1)*(1 - alpha), 9)) - 1)) GROUP BY 1""")
define_cte("confset", ["scored", "cutoffs"], """
  SELECT s.*, alpha, cutoff, calibration_n, list_filter(['A','N','R'], lambda l: CASE l WHEN 'A' THEN p_a WHEN 'N' THEN p_n ELSE p_r END >= cutoff - 1e-12) AS members FROM scored s CROSS JOIN cutoffs WHERE grp = 'O'""")
metric_cte("confset", ["alpha"], "lab_conf", "len(members) = 1")


def p_true(s):
    return s.withColumn("p_true", F.when(F.col("y_true") == "A", F.col("p_a")).when(F.col("y_true") == "N", F.col("p_n")).otherwise(F.col("p_r")))


def conformal_sets(spark, d):
    """Sets on group O with cutoffs calibrated on group F; one row per alpha."""
    s = p_true(scored_pred(spark, d))
    cut = metrics.conformal_cutoffs(s.where("grp = 'F'"), [], "p_true", ALPHAS)
    long = cut.select("calibration_n", F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(n).alias("cutoff")) for n, a in ALPHAS.items()])).alias("_c")).select("calibration_n", "_c.*")
    # three literal alphas: the grid is joined on alpha, not crossed
    rows = s.where("grp = 'O'").withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS.values()]))).join(long, "alpha")
    return rows.withColumn("members", sc.label_set(F.array("p_a", "p_n", "p_r"), b.LABELS, F.col("cutoff")))


@query("met_10_conformal", sql("confset lab_conf", f"""
  SELECT * FROM (SELECT alpha, {q6("avg(CASE WHEN list_contains(members, y_true) THEN 1.0 ELSE 0.0 END)")} AS empirical_set_coverage, {q6('avg(len(members))')} AS average_prediction_set_size, {q6('avg(CASE WHEN len(members)=1 THEN 1.0 ELSE 0.0 END)')} AS single_label_rate,
      {q6('avg(CASE WHEN len(members)>1 THEN 1.0 ELSE 0.0 END)')} AS ambiguous_multi_label_rate, {q6('avg(CASE WHEN len(members)=0 THEN 1.0 ELSE 0.0 END)')} AS empty_unknown_rate FROM confset GROUP BY 1) x
  JOIN ({selective_sql("confset", "lab_conf", ["alpha"])}) y USING (alpha)"""))
def met_10(spark, d):
    return rounded(metrics.conformal_metrics(conformal_sets(spark, d), ["alpha"], "members", LABELS))


@query("met_10_conformal_cutoffs", sql("cutoffs", f"SELECT alpha, calibration_n, {q6('cutoff')} AS cutoff FROM cutoffs"))
def met_10b(spark, d):
    cut = metrics.conformal_cutoffs(p_true(scored_pred(spark, d)).where("grp = 'F'"), [], "p_true", ALPHAS)
    return rounded(cut.select("calibration_n", F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(n).alias("cutoff")) for n, a in ALPHAS.items()])).alias("_c")).select("calibration_n", "_c.*"))


def ranking_sql(src, keys, score, pos):
    k = ", ".join(keys)
    return f"""
  SELECT {k}, CAST(sum(p) AS BIGINT) AS n_positive, CAST(sum(q) AS BIGINT) AS n_negative, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN {q6('sum(p*(cq - q + q/2.0))/(sum(p)*sum(q))')} END AS auroc,
         CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN {q6('sum(p*tp/(tp+fp))/sum(p)')} END AS average_precision FROM (
    SELECT *, CAST(sum(q) OVER (PARTITION BY {k} ORDER BY v) AS DOUBLE) AS cq, CAST(sum(p) OVER (PARTITION BY {k} ORDER BY v DESC) AS DOUBLE) AS tp, CAST(sum(q) OVER (PARTITION BY {k} ORDER BY v DESC) AS DOUBLE) AS fp FROM (
      SELECT {k}, {score} AS v, count(*) FILTER ({pos}) AS p, count(*) FILTER (NOT ({pos})) AS q FROM {src} GROUP BY {k}, v) z) y GROUP BY {k}"""


@query("met_11_ranking_quality", sql("scored", ranking_sql("scored", ["grp"], "p_r", "y_true = 'R'")))
def met_11(spark, d):
    s = scored_pred(spark, d).withColumn("is_r", F.col("y_true") == "R")
    return rounded(metrics.ranking_quality(s, ["grp"], "p_r", "is_r"))


define_cte("ood", ["scored"], """
  SELECT 'probability' AS mechanism, 1 - conf AS ood_score, conf < 0.42 AS rejected, y_true, grp, abs(p_a - p_r) AS gap FROM scored
  UNION ALL SELECT 'margin', 1 - (conf - list_sort([p_a, p_n, p_r])[2]), conf - list_sort([p_a, p_n, p_r])[2] < 0.1, y_true, grp, abs(p_a - p_r) FROM scored""")
define_cte("oodp", ["ood"], "SELECT *, 'group_o' AS proxy_type, grp = 'O' AS is_ood FROM ood UNION ALL SELECT *, 'large_gap', gap >= 0.2 FROM ood")


def ood_samples(spark, d):
    s = scored_pred(spark, d)
    margin = sc.top_two_margin(F.array("p_a", "p_n", "p_r"))
    arr = F.array(
        F.struct(F.lit("probability").alias("mechanism"), (1 - F.col("conf")).alias("ood_score"), (F.col("conf") < 0.42).alias("rejected")),
        F.struct(F.lit("margin").alias("mechanism"), (1 - margin).alias("ood_score"), (margin < 0.1).alias("rejected")))
    return s.select("y_true", "grp", F.abs(F.col("p_a") - F.col("p_r")).alias("gap"), F.explode(arr).alias("_m")).select("_m.*", "y_true", "grp", "gap")


@query("met_12_detection_table", sql("oodp", f"""
  SELECT * EXCLUDE (n_positive, n_negative) FROM (SELECT mechanism, proxy_type, count(*) FILTER (is_ood) AS n_ood_proxy, count(*) FILTER (NOT is_ood) AS n_id_proxy, {q6('avg(rejected::INT) FILTER (is_ood)')} AS ood_reject_rate, {q6('avg(rejected::INT) FILTER (NOT is_ood)')} AS id_reject_rate,
      {q6('avg(gap) FILTER (rejected)')} AS mean_gap_rejected, {q6('avg(gap) FILTER (NOT rejected)')} AS mean_gap_accepted, {q6('avg(gap) FILTER (rejected) - avg(gap) FILTER (NOT rejected)')} AS gap_difference FROM oodp GROUP BY 1, 2) a
  JOIN ({ranking_sql("oodp", ["mechanism", "proxy_type"], "ood_score", "is_ood")}) r USING (mechanism, proxy_type)"""))
def met_12(spark, d):
    return rounded(metrics.detection_table(ood_samples(spark, d), {"group_o": F.col("grp") == "O", "large_gap": F.col("gap") >= 0.2}))


@query("met_13_rejection_by_class", sql("ood", f"""
  SELECT mechanism, y_true, n_total, n_rejected, {q6('ga')} AS gap_mean_rejected, {q6('gb')} AS gap_mean_accepted, {q6('n_rejected/n_total')} AS reject_rate, {q6('(sr - n_rejected)/(sn - n_total)')} AS other_reject_rate,
         {q6('n_rejected/n_total - (sr - n_rejected)/(sn - n_total)')} AS enrichment FROM (SELECT *, sum(n_total) OVER (PARTITION BY mechanism) AS sn, sum(n_rejected) OVER (PARTITION BY mechanism) AS sr FROM (
    SELECT mechanism, y_true, count(*) AS n_total, count(*) FILTER (rejected) AS n_rejected, avg(gap) FILTER (rejected) AS ga, avg(gap) FILTER (NOT rejected) AS gb FROM ood GROUP BY 1, 2) z) y WHERE y_true IN ('A', 'R')"""))
def met_13(spark, d):
    return rounded(metrics.rejection_by_class(ood_samples(spark, d), ["mechanism"], "y_true", ["A", "R"]))


define_cte("dirpred", ["ext"], "SELECT *, class AS y_true, CASE sample_id % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE class END AS y_pred FROM ext WHERE partition = 'test'")
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("met_14_directional_errors", sql("dirpred ext", f"""
  WITH l AS (SELECT DISTINCT split_id, label FROM dirpred CROSS JOIN (VALUES {", ".join(f"('{x}')" for x in SEGMENTS)}) v(label)),
  c AS (SELECT l.*, count(*) FILTER (y_true = label) AS support, count(*) FILTER (y_pred = label) AS predicted, count(*) FILTER (y_true = label AND y_pred = label) AS tp FROM l JOIN dirpred p USING (split_id) GROUP BY 1, 2),
  w AS (SELECT split_id, y_true, y_pred FROM dirpred WHERE y_true <> y_pred GROUP BY 1, 2, 3 QUALIFY ROW_NUMBER() OVER (PARTITION BY split_id, y_true ORDER BY count(*) DESC, y_pred) = 1),
  g AS (SELECT split_id, class, avg(gap) AS gap FROM (SELECT te.split_id, te.class, te.sample_id, min(abs(tr.severity - te.severity)) AS gap FROM ext te JOIN ext tr ON tr.split_id = te.split_id AND tr.class = te.class AND tr.partition = 'train' WHERE te.partition = 'test' GROUP BY 1, 2, 3) z GROUP BY 1, 2),
  r AS (SELECT split_id, class, min(severity) FILTER (partition='train') AS a, max(severity) FILTER (partition='train') AS b, min(severity) FILTER (partition='test') AS c, max(severity) FILTER (partition='test') AS d FROM ext GROUP BY 1, 2)
  SELECT c.split_id, c.label, support, {q6('CASE WHEN support > 0 THEN CASE WHEN predicted > 0 THEN tp/predicted ELSE 0 END END')} AS precision, {q6(_REC)} AS recall, {q6(f'CASE WHEN support > 0 THEN {_F1} END')} AS f1, w.y_pred AS main_confusion_target, {q6('gap')} AS nearest_gap_mean,
         r.a AS train_severity_min, r.b AS train_severity_max, r.c AS test_severity_min, r.d AS test_severity_max
  FROM c LEFT JOIN w ON w.split_id = c.split_id AND w.y_true = label LEFT JOIN g ON g.split_id = c.split_id AND g.class = label LEFT JOIN r ON r.split_id = c.split_id AND r.class = label"""))
def met_14(spark, d):
    e = splits.extrapolation(b.sev(spark, d), "class", "severity", ID)
    guess = F.when(F.col(ID) % 5 == 0, "BUILDING").when(F.col(ID) % 5 == 1, "MACHINERY").otherwise(F.col("class"))
    return rounded(directional.directional_errors(e.withColumn("y_pred", guess), SEGMENTS))


# each direction over five parts of the customers, as five splits
define_cte("ext5", ["sev"], """
  SELECT direction, part, sample_id, class, severity, CASE WHEN k < tc THEN 'test' WHEN k = tc THEN 'gap_excluded' WHEN k <= tc + vc THEN 'validation' ELSE 'train' END AS partition,
         CASE sample_id % 7 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE class END AS y_pred FROM (
    SELECT *, greatest(1, CAST(round_even(0.2*(n - tc - 1), 0) AS BIGINT)) AS vc FROM (
      SELECT *, CASE direction WHEN 'low_train_to_high_test' THEN n - 1 - r ELSE r END AS k, greatest(1, (n + 4)//5) AS tc FROM (
        SELECT v.direction, sample_id % 5 AS part, sev.*, ROW_NUMBER() OVER w - 1 AS r, count(*) OVER (PARTITION BY v.direction, class, sample_id % 5) AS n
        FROM sev CROSS JOIN (VALUES ('low_train_to_high_test'), ('high_train_to_low_test')) v(direction) WINDOW w AS (PARTITION BY v.direction, class, sample_id % 5 ORDER BY severity, sample_id)) a) b0) c
  WHERE n >= 6 AND n - tc - 1 - vc >= 1""")
EDGES = [0, 2, 5, 10, 20, 50, 100]


def _five_parts(spark, d):
    s = b.sev(spark, d).withColumn("part", F.col(ID) % 5).withColumn("cell", F.concat_ws("/", "class", "part"))
    e = splits.extrapolation(s, "cell", "severity", ID).withColumnRenamed("split_id", "direction")
    guess = F.when(F.col(ID) % 7 == 0, "BUILDING").when(F.col(ID) % 7 == 1, "MACHINERY").otherwise(F.col("class"))
    return e.drop("cell", "split_type").withColumn("y_pred", guess)


define_cte("dirsplit", ["ext5"], f"""
  SELECT c.direction, c.part, label, support, CASE WHEN support > 0 THEN CASE WHEN predicted > 0 THEN tp/predicted ELSE 0 END END AS precision, {_REC} AS recall, CASE WHEN support > 0 THEN {_F1} END AS f1, w.y_pred AS target, gap, a, b, c0, d0 FROM (
    SELECT l.*, count(*) FILTER (class = label) AS support, count(*) FILTER (y_pred = label) AS predicted, count(*) FILTER (class = label AND y_pred = label) AS tp FROM (SELECT DISTINCT direction, part, label FROM ext5 CROSS JOIN (VALUES {", ".join(f"('{x}')" for x in SEGMENTS)}) v(label)) l
    JOIN ext5 p USING (direction, part) WHERE partition = 'test' GROUP BY 1, 2, 3) c
  LEFT JOIN (SELECT direction, part, class, y_pred FROM ext5 WHERE partition = 'test' AND class <> y_pred GROUP BY 1, 2, 3, 4 QUALIFY ROW_NUMBER() OVER (PARTITION BY direction, part, class ORDER BY count(*) DESC, y_pred) = 1) w ON w.direction = c.direction AND w.part = c.part AND w.class = label
  LEFT JOIN (SELECT direction, part, class, avg(gap) AS gap FROM (SELECT te.direction, te.part, te.class, te.sample_id, min(abs(tr.severity - te.severity)) AS gap FROM ext5 te JOIN ext5 tr ON tr.direction = te.direction AND tr.part = te.part AND tr.class = te.class AND tr.partition = 'train' WHERE te.partition = 'test' GROUP BY 1, 2, 3, 4) z GROUP BY 1, 2, 3) g ON g.direction = c.direction AND g.part = c.part AND g.class = label
  LEFT JOIN (SELECT direction, part, class, min(severity) FILTER (partition='train') AS a, max(severity) FILTER (partition='train') AS b, min(severity) FILTER (partition='test') AS c0, max(severity) FILTER (partition='test') AS d0 FROM ext5 GROUP BY 1, 2, 3) r ON r.direction = c.direction AND r.part = c.part AND r.class = label""")
_SD = "CASE WHEN count({0}) > 1 THEN stddev_samp({0}) WHEN count({0}) = 1 THEN 0 END"


@query("met_14_direction_summary", sql("dirsplit", f"""
  SELECT s.direction, s.label, COALESCE(n_splits, 0) AS n_splits, support_mean, support_min, precision_mean, precision_std, recall_mean, recall_std, f1_mean, f1_std, nearest_gap_mean, nearest_gap_std, train_severity_min, train_severity_max, test_severity_min, test_severity_max, target AS main_confusion_target
  FROM (SELECT DISTINCT direction, label FROM dirsplit) s LEFT JOIN (
    SELECT direction, label, count(*) AS n_splits, {q6('avg(support)')} AS support_mean, min(support) AS support_min, {", ".join(f"{q6(f'avg({m})')} AS {m}_mean, {q6(_SD.format(m))} AS {m}_std" for m in ("precision", "recall", "f1"))},
           {q6('avg(gap)')} AS nearest_gap_mean, {q6(_SD.format('gap'))} AS nearest_gap_std, {q6('avg(a)')} AS train_severity_min, {q6('avg(b)')} AS train_severity_max, {q6('avg(c0)')} AS test_severity_min, {q6('avg(d0)')} AS test_severity_max FROM dirsplit WHERE support > 0 GROUP BY 1, 2) p USING (direction, label)
  LEFT JOIN (SELECT direction, label, target FROM dirsplit WHERE support > 0 AND target IS NOT NULL GROUP BY 1, 2, 3 QUALIFY ROW_NUMBER() OVER (PARTITION BY direction, label ORDER BY count(*) DESC, target) = 1) m USING (direction, label)"""))
def met_14b(spark, d):
    errors = directional.directional_errors(_five_parts(spark, d), SEGMENTS, ["direction", "part"])
    return rounded(directional.direction_summary(errors))


_BIN = f"len(list_filter({EDGES}, lambda x: x <= gap)) - 1"


@query("met_14_recall_by_gap", sql("ext5", f"""
  WITH g AS (SELECT te.direction, te.class, te.y_pred, te.sample_id, te.part, min(abs(tr.severity - te.severity)) AS gap FROM ext5 te LEFT JOIN ext5 tr ON tr.direction = te.direction AND tr.part = te.part AND tr.class = te.class AND tr.partition = 'train' WHERE te.partition = 'test' GROUP BY 1, 2, 3, 4, 5)
  SELECT v.direction, v.part, v.bin::INT AS bin, {EDGES}[v.bin + 1]::DOUBLE AS gap_from, {EDGES}[v.bin + 2]::DOUBLE AS gap_to, COALESCE(n, 0) AS n, COALESCE(hits, 0) AS hits, {q6('hits/n')} AS recall, {q6('gm')} AS gap_mean
  FROM (SELECT DISTINCT direction, part, bin FROM ext5 CROSS JOIN range(-1, {len(EDGES)}) r(bin)) v LEFT JOIN (
    SELECT direction, part, CASE WHEN gap IS NULL THEN -1 ELSE {_BIN} END AS bin, count(*) AS n, count(*) FILTER (class = y_pred) AS hits, avg(gap) AS gm FROM g GROUP BY 1, 2, 3) z ON z.direction = v.direction AND z.part = v.part AND z.bin = v.bin"""))
def met_14c(spark, d):
    out = directional.recall_by_gap(_five_parts(spark, d), EDGES, ["direction", "part"])
    return rounded(out)


define_cte("mapped", ["scored"], "SELECT 'fine' AS scope, y_true, y_pred FROM scored UNION ALL SELECT 'mapped', CASE y_true WHEN 'R' THEN 'Z' ELSE 'A' END, CASE y_pred WHEN 'R' THEN 'Z' ELSE 'A' END FROM scored")
metric_cte("mapped", ["scope"], "lab_map")


@query("met_15_mapped_family", sql("lab_map", f"SELECT scope, max(n) AS n, {q6('sum(tp)/max(n)')} AS accuracy, {q6(f'avg({_REC})')} AS balanced_accuracy, {q6(f'avg({_F1}) FILTER (support > 0)')} AS macro_f1_observed FROM lab_map GROUP BY 1"))
def met_15(spark, d):
    s = scored_pred(spark, d).select("y_true", "y_pred")
    fam = {"A": "A", "N": "A", "R": "Z"}
    both = s.withColumn("scope", F.lit("fine")).unionByName(
        s.select(sc.map_label(F.col("y_true"), fam).alias("y_true"), sc.map_label(F.col("y_pred"), fam).alias("y_pred"), F.lit("mapped").alias("scope")))
    return rounded(metrics.classification(both, ["scope"], LABELS).select("scope", "n", "accuracy", "balanced_accuracy", "macro_f1_observed"))


@query("met_16_late_gain", sql("mode_metrics", f"""
  SELECT model, input_group, {q6('max(accuracy) FILTER (split = 1996)')} AS early, {q6('max(accuracy) FILTER (split = 1998)')} AS late, {q6('max(accuracy) FILTER (split = 1998) - max(accuracy) FILTER (split = 1996)')} AS gain FROM mode_metrics GROUP BY 1, 2"""))
def met_16(spark, d):
    at = lambda y: F.max(F.when(F.col("split") == y, F.col("accuracy")))
    return rounded(mode_metrics(spark, d).groupBy("model", "input_group").agg(at(1996).alias("early"), at(1998).alias("late"), (at(1998) - at(1996)).alias("gain")))


@query("met_17_gate_decision", sql("mode_metrics", f"""
  SELECT *, CASE WHEN mean_at_least_half AND late_exceeds_early AND all_supported THEN 'A_ENTER_NEXT_GATE' ELSE 'B_REQUIRE_FURTHER_VALIDATION' END AS decision FROM (
    SELECT input_group, avg(accuracy) >= 0.5 AS mean_at_least_half, max(accuracy) FILTER (split = 1998) > max(accuracy) FILTER (split IN (1996, 1997)) AS late_exceeds_early, min(n) >= 5 AS all_supported FROM mode_metrics GROUP BY 1) z"""))
def met_17(spark, d):
    best = lambda ys: F.max(F.when(F.col("split").isin(ys), F.col("accuracy")))
    g = mode_metrics(spark, d).groupBy("input_group").agg(
        (F.avg("accuracy") >= 0.5).alias("mean_at_least_half"), (best([1998]) > best([1996, 1997])).alias("late_exceeds_early"), (F.min("n") >= 5).alias("all_supported"))
    ok = F.col("mean_at_least_half") & F.col("late_exceeds_early") & F.col("all_supported")
    return g.withColumn("decision", F.when(ok, "A_ENTER_NEXT_GATE").otherwise("B_REQUIRE_FURTHER_VALIDATION"))


@query("met_18_capability_tiers", sql("ext sev", """
  WITH s AS (SELECT class, count(*) AS matched FROM sev GROUP BY 1),
  t AS (SELECT class, count(*) FILTER (split_id = 'low_train_to_high_test') AS low_support, count(*) FILTER (split_id = 'high_train_to_low_test') AS high_support FROM ext WHERE partition = 'test' GROUP BY 1),
  c AS (SELECT v.class, COALESCE(matched, 0) AS matched, COALESCE(low_support, 0) AS low_support, COALESCE(high_support, 0) AS high_support FROM (VALUES ('AUTOMOBILE'),('BUILDING'),('FURNITURE'),('HOUSEHOLD'),('MACHINERY'),('NONE')) v(class) LEFT JOIN s USING (class) LEFT JOIN t USING (class))
  SELECT *, CASE WHEN matched >= 20 AND low_support >= 5 AND high_support >= 5 THEN 'Tier A' WHEN matched > 0 THEN 'Tier B' ELSE 'Tier C' END AS tier,
         CASE WHEN matched >= 20 AND low_support >= 5 AND high_support >= 5 THEN 'supported' WHEN matched > 0 THEN 'exploratory' ELSE 'not-supported' END AS status FROM c"""))
def met_18(spark, d):
    return metrics.capability_tiers(class_support(spark, d).select("class", "matched", "low_support", "high_support"))


FAMILIES = {"AUTOMOBILE": "moving", "MACHINERY": "moving", "BUILDING": "home", "HOUSEHOLD": "home", "FURNITURE": "fitting", "NONE": "fitting", "OTHER": "rest"}


def class_support(spark, d):
    s = b.sev(spark, d)
    test = splits.extrapolation(s, "class", "severity", ID).where("partition = 'test'")
    sup = test.groupBy("class").agg(F.count_if(F.col("split_id") == "low_train_to_high_test").alias("low_support"), F.count_if(F.col("split_id") == "high_train_to_low_test").alias("high_support"))
    mat = s.groupBy("class").agg(F.count(F.lit(1)).alias("matched"))
    dim = spark.createDataFrame([(c,) for c in [*SEGMENTS, "NONE"]], "class string")
    return dim.join(mat, "class", "left").join(sup, "class", "left").na.fill(0)


_FAM = ", ".join(f"('{c}', '{f}', {str(c != 'OTHER').lower()})" for c, f in FAMILIES.items())


@query("met_18_family_tiers", sql("ext sev", f"""
  WITH c AS (SELECT v.*, COALESCE(matched, 0) AS matched, COALESCE(low, 0) AS low, COALESCE(high, 0) AS high FROM (VALUES {_FAM}) v(class, family, expected) LEFT JOIN (SELECT class, count(*) AS matched FROM sev GROUP BY 1) s USING (class)
    LEFT JOIN (SELECT class, count(*) FILTER (split_id = 'low_train_to_high_test') AS low, count(*) FILTER (split_id = 'high_train_to_low_test') AS high FROM ext WHERE partition = 'test' GROUP BY 1) t USING (class)),
  f AS (SELECT family, string_agg(class, ';' ORDER BY class) AS members, COALESCE(string_agg(class, ';' ORDER BY class) FILTER (expected), '') AS expected_members, COALESCE(string_agg(class, ';' ORDER BY class) FILTER (matched > 0), '') AS active_members,
    COALESCE(string_agg(class, ';' ORDER BY class) FILTER (expected AND matched = 0), '') AS missing_members, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(low) AS BIGINT) AS low_support, CAST(sum(high) AS BIGINT) AS high_support FROM c GROUP BY 1)
  SELECT *, CASE WHEN full_ THEN 'Tier A' WHEN matched > 0 THEN 'Tier B' ELSE 'Tier C' END AS tier, CASE WHEN full_ THEN 'supported' WHEN matched > 0 THEN 'exploratory' ELSE 'not-supported' END AS status FROM (
    SELECT *, matched >= 20 AND low_support >= 5 AND high_support >= 5 AND missing_members = '' AS full_ FROM f) z""").replace("SELECT *, CASE WHEN full_", "SELECT * EXCLUDE (full_), CASE WHEN full_"))
def met_18b(spark, d):
    fam = spark.createDataFrame([(c, f, c != "OTHER") for c, f in FAMILIES.items()], "class string, family string, expected boolean")
    return metrics.family_tiers(fam.join(class_support(spark, d), "class", "left").na.fill(0))


@query("met_19_parity", sql("traj cls", f"""
  SELECT c.sample_id, true AS in_both, c.sample_id % 9 <> 0 AS discrete_match, {q6('CASE WHEN c.sample_id % 35 = 0 THEN 0.0 WHEN c.sample_id % 7 = 0 THEN NULL WHEN c.sample_id % 4 = 0 THEN 0.25 ELSE 0.0 END')} AS max_delta,
    c.sample_id % 9 <> 0 AND (c.sample_id % 35 = 0 OR c.sample_id % 7 <> 0 AND c.sample_id % 4 <> 0) AS passed FROM cls c"""))
def met_19(spark, d):
    e = b.cls(spark, d).join(b.traj(spark, d).groupBy(ID).agg(F.sum("f_click").alias("total")), ID)
    moved = F.col("total") + F.when(F.col(ID) % 4 == 0, 0.25).otherwise(0.0)
    a = e.select(ID, F.when(F.col(ID) % 9 == 0, "changed").otherwise(F.col("class")).alias("class"), F.when(F.col(ID) % 7 != 0, moved).alias("total"))
    e = e.withColumn("total", F.when(F.col(ID) % 35 != 0, F.col("total")))
    return rounded(metrics.parity(e, a, [ID], ["class"], ["total"]))


@query("met_20_release_benchmark", sql("scored lab lab_acc", f"""
  SELECT 'forced' AS metric_group, 'accuracy' AS metric, grp AS key, {q6('sum(tp)/max(n)')} AS value FROM lab GROUP BY grp
  UNION ALL SELECT 'forced', 'macro_f1_fixed', grp, {q6(f'avg({_F1})')} FROM lab GROUP BY grp
  UNION ALL SELECT 'selective', 'coverage', grp, {q6('avg((conf >= 0.45)::INT)')} FROM scored GROUP BY grp
  UNION ALL SELECT 'selective', 'risk', grp, {q6('1 - sum(tp)/max(n)')} FROM lab_acc GROUP BY grp
  UNION ALL SELECT 'per_class', 'recall', y_true, {q6('avg((y_true = y_pred)::INT)')} FROM scored GROUP BY y_true
  UNION ALL SELECT 'per_class', 'support', y_true, count(*) + 0.0 FROM scored GROUP BY y_true
  UNION ALL SELECT 'status_distribution', 'count', CASE WHEN conf >= 0.45 THEN 'accepted' ELSE 'unknown' END, count(*) + 0.0 FROM scored GROUP BY 3"""))
def met_20(spark, d):
    s = scored_pred(spark, d)
    status = s.groupBy(F.when(F.col("conf") >= 0.45, "accepted").otherwise("unknown").alias("status")).agg(F.count(F.lit(1)).alias("count"))
    return rounded(ranking.union_all([
        metrics.long_metrics(metrics.classification(s, ["grp"], LABELS), "forced", ["accuracy", "macro_f1_fixed"], "grp"),
        metrics.long_metrics(metrics.selective(s, ["grp"], LABELS, F.col("conf") >= 0.45), "selective", ["coverage", "risk"], "grp"),
        metrics.long_metrics(metrics.per_class(s, [], b.LABELS), "per_class", ["recall", "support"], "label"),
        metrics.long_metrics(status, "status_distribution", ["count"], "status"),
    ]))


@query("met_21_regression_checks", sql("faultysteps", """
  WITH x AS (SELECT sample_id, bool_or(dt = 0) AS dup, max(t) AS e, bool_or(isnan(f_view)) AS nan_seen, count(f_signup) = 0 AS no_col, bool_or(f_click IS NULL) AS hole FROM faultysteps GROUP BY 1)
  SELECT 'duplicate_time_rejected' AS test, count(*) FILTER (dup) AS cases, true AS passed FROM x UNION ALL SELECT 'missing_required_column', count(*) FILTER (no_col), true FROM x
  UNION ALL SELECT 'nan_rejected', count(*) FILTER (nan_seen), true FROM x UNION ALL SELECT 'window_too_short', count(*) FILTER (e < 12), true FROM x
  UNION ALL SELECT 'valid_input', count(*) FILTER (NOT dup AND NOT COALESCE(nan_seen, false) AND NOT no_col AND e >= 12 AND NOT hole), true FROM x"""))
def met_21(spark, d):
    f = b.faulty(spark, d)
    facts = f.groupBy(ID).agg(
        (F.count(F.lit(1)) > F.countDistinct("t")).alias("dup"), F.max("t").alias("e"), F.max(F.isnan("f_view")).alias("nan_seen"),
        (F.count("f_signup") == 0).alias("no_col"), F.max(F.col("f_click").isNull()).alias("hole"))
    g = facts.join(gate(spark, d, "end"), ID)
    clean = ~F.col("dup") & ~F.col("nan_seen") & ~F.col("no_col") & (F.col("e") >= 12) & ~F.col("hole")
    rules = {"duplicate_time_rejected": (F.col("dup"), False), "missing_required_column": (F.col("no_col"), False), "nan_rejected": (F.col("nan_seen"), False),
             "window_too_short": (F.col("e") < 12, False), "valid_input": (clean, True)}
    arr = F.array(*[F.struct(F.lit(n).alias("test"), c.alias("hit"), (F.col("valid") == want).alias("as_wanted")) for n, (c, want) in rules.items()])
    rows = g.select(F.explode(arr).alias("_r")).select("_r.*")
    return rows.groupBy("test").agg(F.count_if("hit").alias("cases"), F.min(~F.col("hit") | F.col("as_wanted")).alias("passed"))
