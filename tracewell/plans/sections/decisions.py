"""DEC, EXP, STR: decisions, attribution and streaming."""

import uuid

from pyspark.sql import functions as F

from tracewell.functions import scalars as sc
from tracewell.operators import align, decide, explain, gram, learn, metrics, ordered, splits
from tracewell.operators import aggregates as agg
from tracewell.operators import anomaly as ano
from tracewell.operators import windows as win
from tracewell.plans import bindings as b
from tracewell.plans.bindings import define_cte, sql
from tracewell.plans.registry import q6, query, r6, rounded
from tracewell.plans.sections.anomaly import BIG, ano_07, reference
from tracewell.plans.sections.audits import _BAD, _FILE_CODES
from tracewell.plans.sections.learning import TRAIN
from tracewell.plans.sections.joins import scored_pred
from tracewell.plans.sections.metrics import _F1, _REC, metric_cte
from tracewell.plans.sections.metrics import LABELS as MET_LABELS
from tracewell.plans.sections.windows import ID
from tracewell.session import cut_lineage, shared_dir
from tracewell.streaming import online

FAMS = [0, 1, 2, 3, 4]
TIERS = {"A": "Tier A", "N": "Tier B"}


COLUMNS = [f"{f}__{s}" for f in b.FEATURES for s in win.STATS]


def _feature_rows(spark, d):
    """Window features with class, family, partition, and a number to estimate from them: what the whole trajectory adds up to."""
    t = b.traj(spark, d)
    feats = win.window_summary(t, b.FEATURES, [12], b.INJECTION).select(ID, F.array(*COLUMNS).alias("x"))
    size = t.groupBy(ID).agg(F.sum("f_click").alias("size"))
    c = splits.interleaved(b.cls(spark, d), ["class"], ID, 5, min_size=1)
    return cut_lineage(feats.join(c, ID).join(size, ID).withColumn("family", sc.map_label(F.col("class"), b.FAMILY)))  # every fit reads its rows many times


def _bundle(spark, d):
    rows = _feature_rows(spark, d)
    return decide.fit_bundle(
        rows.where("partition = 'train'"), rows.where("partition = 'validation'"), "family", ["browse", "convert", "fault"], b.TIER, target="size", target_label="browse")


def _diagnosis(spark, d):
    return decide.diagnose(
        b.faulty_file(spark, d), _bundle(spark, d), b.FEATURES, b.INJECTION, 12.0, 1.0, 0.1, b.SEGMENT, ordinal="ord", header=b.headers(spark, d))


@query("dec_01_diagnose")
def dec_01(spark, d):
    out = _diagnosis(spark, d)
    return rounded(out.withColumn("conformal_set", F.array_join("conformal_set", "|")))


_GATE = f"""
  SELECT sample_id, n AS row_count, CASE WHEN lacks THEN 'missing_required_columns:f_signup' ELSE array_to_string(list_filter([{_FILE_CODES}], lambda x: x IS NOT NULL), ';') END AS errors FROM (
    SELECT sample_id, count(*) AS n, max(t) AS hi, min(dt) AS mindt, max(abs(dt - 1)) AS dev, {", ".join(f"bool_or({x}) AS bad_{f}" for f, x in _BAD.items())} FROM filesteps GROUP BY 1) z
  JOIN (SELECT sample_id, count(*) FILTER (col = 'f_signup') = 0 AS lacks, count(*) > count(DISTINCT col) AS repeated FROM headers GROUP BY 1) h USING (sample_id)"""


@query("dec_01_diagnosis_rules", sql("filesteps headers", f"""
  SELECT sample_id, row_count, errors, errors = '' AS valid, errors <> '' AS invalid_input, true AS status_follows_policy, true AS estimate_follows_gate, true AS confidence_in_range, true AS set_follows_cutoff FROM ({_GATE}) z"""))
def dec_01b(spark, d):
    bundle = _bundle(spark, d)
    out = decide.diagnose(b.faulty_file(spark, d), bundle, b.FEATURES, b.INJECTION, 12.0, 1.0, 0.1, b.SEGMENT, ordinal="ord", header=b.headers(spark, d))
    scored = F.col("valid")
    policy = decide.status_policy(F.size("conformal_set"), F.col("distance") > bundle.distance_limit, decide.capability(F.col("y_pred"), bundle.tiers))
    opened = (F.col("status") == "accepted") & (F.col("y_pred") == "browse")
    inside = F.array_contains("conformal_set", F.col("y_pred")) == (F.col("confidence") >= bundle.cutoff - 1e-12)
    return out.select(
        ID, "row_count", "errors", "valid", (F.col("status") == "invalid_input").alias("invalid_input"),
        F.when(scored, F.col("status") == policy).otherwise(F.col("y_pred").isNull()).alias("status_follows_policy"),
        F.when(scored, F.col("estimate").isNotNull() == opened).otherwise(F.col("estimate").isNull()).alias("estimate_follows_gate"),
        F.when(scored, F.col("confidence").between(1 / 3 - 1e-9, 1)).otherwise(F.col("confidence").isNull()).alias("confidence_in_range"),
        F.when(scored, inside).otherwise(F.col("conformal_set").isNull()).alias("set_follows_cutoff"))


define_cte("decided", ["scored"], """
  SELECT *, CASE WHEN len(members) = 0 THEN 'unknown' WHEN len(members) > 1 OR ood THEN 'requires_review' WHEN tier = 'Tier C' THEN 'unknown' WHEN tier = 'Tier B' THEN 'requires_review' ELSE 'accepted' END AS status FROM (
    SELECT *, list_filter(['A','N','R'], lambda l: CASE l WHEN 'A' THEN p_a WHEN 'N' THEN p_n ELSE p_r END >= 0.42 - 1e-12) AS members, p_r > 0.55 AS ood,
           CASE y_pred WHEN 'A' THEN 'Tier A' WHEN 'N' THEN 'Tier B' ELSE 'Tier C' END AS tier FROM scored) z""")


def decided(spark, d):
    s = scored_pred(spark, d)
    s = s.withColumn("members", sc.label_set(F.array("p_a", "p_n", "p_r"), b.LABELS, 0.42)).withColumn("ood", F.col("p_r") > 0.55)
    s = s.withColumn("tier", decide.capability(F.col("y_pred"), TIERS))
    return s.withColumn("status", decide.status_policy(F.size("members"), F.col("ood"), F.col("tier")))


@query("dec_02_status_policy", sql("decided", "SELECT grp, y_pred, tier, ood, CAST(len(members) AS BIGINT) AS set_size, status, count(*) AS n FROM decided GROUP BY ALL"))
def dec_02(spark, d):
    return decided(spark, d).groupBy("grp", "y_pred", "tier", "ood", F.size("members").cast("long").alias("set_size"), "status").agg(F.count(F.lit(1)).alias("n"))


_OPEN = "status = 'accepted' AND y_pred = 'A' AND tier = 'Tier A'"


@query("dec_03_gated_estimate", sql("decided predq", f"""
  WITH tr AS (SELECT (1 - p_a) AS x, quantity AS y FROM predq WHERE row_id % 5 <> 0 AND y_true = 'A'),
  s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my FROM tr), w AS (SELECT mx, sx, my, sum((x - mx)/sx*(y - my))/(sum(((x - mx)/sx)**2) + 10) AS w FROM tr, s GROUP BY ALL)
  SELECT y_pred, status, CASE WHEN {_OPEN} THEN 'available_exploratory' ELSE 'not_run_due_to_gating' END AS severity_status, count(*) AS n, count(e) AS estimates, {q6('avg(e)', 4)} AS mean_estimate, {q6('min(e)', 4)} AS least, {q6('max(e)', 4)} AS most
  FROM (SELECT *, CASE WHEN {_OPEN} THEN my + (1 - p_a - mx)/sx*w END AS e FROM decided, w) z GROUP BY 1, 2, 3"""))
def dec_03(spark, d):
    train = b.pred_quantity(spark, d).where("row_id % 5 <> 0 AND y_true = 'A'").select(F.array(1 - F.col("p_a")).alias("x"), "quantity")
    ridge = learn.fit_ridge(train, "x", "quantity", 10.0)
    rows = decide.gated_estimate(decided(spark, d), decide.gate_open("A"), lambda r: r.withColumn("estimate", ridge.predict(F.array(1 - F.col("p_a")))))
    return rounded(rows.groupBy("y_pred", "status", "severity_status").agg(
        F.count(F.lit(1)).alias("n"), F.count("estimate").alias("estimates"), F.avg("estimate").alias("mean_estimate"), F.min("estimate").alias("least"), F.max("estimate").alias("most")), 4)


@query("dec_04_capability_gate", sql("cls family tier", """
  SELECT sample_id, COALESCE(family, 'unknown_or_other') AS family, COALESCE(t.tier, 'Tier C') AS tier FROM cls LEFT JOIN family USING (class) LEFT JOIN (SELECT * FROM tier WHERE family <> 'fault') t USING (family)"""))
def dec_04(spark, d):
    c = b.cls(spark, d).withColumn("family", sc.map_label(F.col("class"), b.FAMILY))
    return c.select(ID, "family", decide.capability(F.col("family"), {k: v for k, v in b.TIER.items() if k != "fault"}).alias("tier"))




def _legacy_rows(spark, d):
    g = ano_07(spark, d)
    n = b.bigtraj(spark, d).groupBy(ID).agg(F.avg("f_disc").alias("m"))
    j = g.join(n, ID).withColumn("predicted", F.when(F.col("m") > 0.05, "high").otherwise("low")).withColumn("fixed", F.col(ID) % 3 != 0)
    return j.withColumn("decision", decide.legacy_decision(F.col("first_alarm_s"), F.col("predicted"), F.col("fixed")))


from tracewell.plans.sections.anomaly import _gate as _gate_sql  # noqa: E402

define_cte("gate7", ["big", "big_ref", "gatescale"], _gate_sql("big", []))
define_cte("legacy", ["gate7", "bigtraj"], """
  SELECT g.*, predicted, sample_id % 3 <> 0 AS fixed, CASE WHEN first_alarm_s IS NULL THEN 'NoAlarm' WHEN sample_id % 3 <> 0 THEN predicted ELSE 'Unknown' END AS decision
  FROM gate7 g JOIN (SELECT sample_id, CASE WHEN avg(f_disc) > 0.05 THEN 'high' ELSE 'low' END AS predicted FROM bigtraj GROUP BY 1) p USING (sample_id)""")


@query("dec_05_legacy_decision", sql("legacy", "SELECT sample_id, first_alarm_s, predicted, fixed, decision FROM legacy"))
def dec_05(spark, d):
    return _legacy_rows(spark, d).select(ID, "first_alarm_s", "predicted", "fixed", "decision")


@query("dec_06_first_examples", sql("decided", f"""
  SELECT v.category, grp, y_pred, status, {q6('conf')} AS conf, conf IS NOT NULL AS observed FROM (VALUES ('accepted_tier_a'), ('requires_review'), ('unknown'), ('never')) v(category) LEFT JOIN (
    SELECT category, grp, y_pred, status, conf, ROW_NUMBER() OVER (PARTITION BY category ORDER BY row_id, conf, grp, y_pred) AS rn FROM (
      SELECT 'accepted_tier_a' AS category, * FROM decided WHERE status = 'accepted' AND tier = 'Tier A' UNION ALL SELECT 'requires_review', * FROM decided WHERE status = 'requires_review'
      UNION ALL SELECT 'unknown', * FROM decided WHERE status = 'unknown') z) y ON y.category = v.category AND rn = 1"""))
def dec_06(spark, d):
    s = F.col("status")
    cats = {"accepted_tier_a": (s == "accepted") & (F.col("tier") == "Tier A"), "requires_review": s == "requires_review", "unknown": s == "unknown", "never": F.lit(False)}
    out = decide.first_examples(decided(spark, d), cats, ["row_id", "conf", "grp", "y_pred"], ["row_id", "grp", "y_pred", "status", "conf"])
    return rounded(out.drop("row_id"))


@query("dec_07_result_view", sql("decided", """
  SELECT status, CASE status WHEN 'accepted' THEN 'Accepted' WHEN 'unknown' THEN 'Unknown' ELSE 'Review required' END AS status_label, len(members) = 0 AS trend_fallback,
         CASE WHEN len(members) = 0 THEN 'P|TAVG' ELSE array_to_string(members, '|') END AS trend_variables, count(*) AS n FROM decided GROUP BY ALL"""))
def dec_07(spark, d):
    v = decide.result_view(decided(spark, d), {"accepted": "Accepted", "unknown": "Unknown", "requires_review": "Review required"}, "members", ["P", "TAVG"])
    return v.select("status", "status_label", "trend_fallback", F.array_join("trend_variables", "|").alias("trend_variables")).groupBy(
        "status", "status_label", "trend_fallback", "trend_variables").agg(F.count(F.lit(1)).alias("n"))


@query("dec_08_validation_sweep", sql("legacy", f"""
  SELECT predicted, decision, count(*) AS n, count(first_alarm_s) AS n_alarm, {q6('avg(peak_score)')} AS mean_peak FROM legacy GROUP BY 1, 2"""))
def dec_08(spark, d):
    return rounded(_legacy_rows(spark, d).groupBy("predicted", "decision").agg(F.count(F.lit(1)).alias("n"), F.count("first_alarm_s").alias("n_alarm"), F.avg("peak_score").alias("mean_peak")))


define_cte("bench", ["decided"], """
  SELECT '' AS e, *, y_true = y_pred AS hit, status = 'accepted' AS acc, list_contains(members, y_true) AS covered FROM decided""")
metric_cte("bench", ["e"], "lab_bench")
metric_cte("bench", ["e"], "lab_bench_acc", "acc")
_ROWS = {
    "forced": ("lab_bench", {"accuracy": "sum(tp)/max(n)", "balanced_accuracy": f"avg({_REC})", "macro_f1_fixed": f"avg({_F1})"}),
    "selective": ("lab_bench_acc", {"selective_accuracy": "sum(tp)/max(n)", "selective_macro_f1": f"avg({_F1})", "risk": "1 - sum(tp)/max(n)"}),
    "conformal": ("bench", {"empirical_set_coverage": "avg(covered::INT)", "average_prediction_set_size": "avg(len(members))", "single_label_rate": "avg((len(members) = 1)::INT)",
                            "ambiguous_multi_label_rate": "avg((len(members) > 1)::INT)", "empty_unknown_rate": "avg((len(members) = 0)::INT)"}),
    "ood": ("bench", {"warning_rate": "avg(ood::INT)", "accuracy_with_warning": "avg(hit::INT) FILTER (ood)", "accuracy_without_warning": "avg(hit::INT) FILTER (NOT ood)"}),
}
_LINES = [f"SELECT '{g}' AS metric_group, '{m}' AS metric, '' AS key, {q6(x)} AS value FROM {src}" for g, (src, ms) in _ROWS.items() for m, x in ms.items()]


@query("met_20_locked_cohort", sql("bench lab_bench lab_bench_acc", " UNION ALL ".join([
    *_LINES, f"SELECT 'selective', 'coverage', '', {q6('avg(acc::INT)')} FROM bench", f"SELECT 'per_class', 'support', label, {q6('support')} FROM lab_bench", f"SELECT 'per_class', 'recall', label, {q6(_REC)} FROM lab_bench",
    "SELECT 'status_by_tier', 'count', status || '|' || tier, count(*) + 0.0 FROM bench GROUP BY 3"])))
def met_20b(spark, d):
    rows = decided(spark, d)
    return rounded(metrics.release_benchmark(rows, MET_LABELS, F.col("status") == "accepted", "members", "ood", "status", "tier"))


# ---------------------------------------------------------------- attribution

NAMES = [f"v{j // 8}__s{j % 8}" for j in range(64)]


def _model(spark, d):
    f = b.feat(spark, d)
    m = learn.fit_logistic(f.where(TRAIN), "family", FAMS)
    return m, learn.fit_medians(f.where(TRAIN)), f.where(f"NOT ({TRAIN})")


@query("exp_01_permutation_importance")
def exp_01(spark, d):
    m, _, held = _model(spark, d)
    return rounded(explain.permutation_importance(held, m, "family", NAMES))


@query("exp_01_importance_variables")
def exp_01b(spark, d):
    m, _, held = _model(spark, d)
    return rounded(explain.importance_variables(explain.permutation_importance(held, m, "family", NAMES)))


def _price_model(spark, d):
    """The ridge estimate of ML-05 and the centre of its train rows."""
    big = b.bigtraj(spark, d).select(ID, "t", F.array("f_qty").alias("x"), "f_price")
    return big, learn.fit_ridge(big, "x", "f_price", 10.0)


@query("exp_02_value_drivers", sql("bigtraj", f"""
  WITH s AS (SELECT avg(f_qty) AS mx, stddev_pop(f_qty) AS sx, avg(f_price) AS my, median(f_qty) AS mid FROM bigtraj), w AS (SELECT mx, sx, my, mid, sum((f_qty - mx)/sx*(f_price - my))/(sum(((f_qty - mx)/sx)**2) + 10) AS w FROM bigtraj, s GROUP BY ALL)
  SELECT sample_id, t, 'f_qty' AS feature, {q6('my + (f_qty - mx)/sx*w', 4)} AS estimate, {q6('(f_qty - mid)/sx*w', 4)} AS contribution FROM bigtraj, w"""))
def exp_02b(spark, d):
    big, ridge = _price_model(spark, d)
    return rounded(explain.value_drivers(big, ridge.predict, learn.fit_medians(big), ["f_qty"], [ID, "t"]), 4)


@query("exp_02_leave_one_feature_out")
def exp_02(spark, d):
    m, center, held = _model(spark, d)
    return rounded(explain.leave_one_out(held, m, center, NAMES, [ID]))


define_cte("drv", ["featlong"], """
  SELECT sample_id, f.label, j, v - m AS delta, 1/s AS diag FROM featlong f JOIN (SELECT label, j, avg(v) AS m, var_pop(v) + 1e-6 AS s FROM featlong GROUP BY 1, 2) c USING (label, j)""")


@query("exp_03_distance_drivers", sql("drv", f"""
  SELECT sample_id, label, j, {q6('k')} AS contribution, {q6('k/sum(k) OVER (PARTITION BY sample_id)')} AS fraction, CASE WHEN delta > 0 THEN 'above_class_center' WHEN delta < 0 THEN 'below_class_center' ELSE 'at_class_center' END AS direction
  FROM (SELECT *, greatest(0, delta*delta*diag) AS k FROM drv) z"""))
def exp_03(spark, d):
    f = b.feat(spark, d).select(ID, "label", F.posexplode("x").alias("j", "v")).withColumn("j", F.col("j").cast("long"))
    params = f.groupBy("label", "j").agg(F.avg("v").alias("m"), (1 / (F.var_pop("v") + 1e-6)).alias("diag"))
    rows = f.join(params, ["label", "j"]).withColumn("delta", F.col("v") - F.col("m"))
    return rounded(explain.distance_drivers(rows, [ID], "delta", "diag").select(ID, "label", "j", "contribution", "fraction", "direction"))


# the closed form of the shrunk precision per class for two features
define_cte("dz", ["bigtraj"], """
  SELECT sample_id, t, sample_id % 3 AS label, (sample_id + CAST(t AS BIGINT)) % 3 AS guess, (f_qty - mq)/sq AS a, (f_price - mp)/sp AS c
  FROM bigtraj CROSS JOIN (SELECT avg(f_qty) AS mq, stddev_pop(f_qty) AS sq, avg(f_price) AS mp, stddev_pop(f_price) AS sp FROM bigtraj) m""")
define_cte("dprec", ["dz"], """
  SELECT label, ma, mc, v11/det AS p00, v00/det AS p11, -v01/det AS p01 FROM (SELECT *, v00*v11 - v01*v01 AS det FROM (
    SELECT label, ma, mc, (1-l)*s00 + l*mu AS v00, (1-l)*s11 + l*mu AS v11, (1-l)*s01 AS v01 FROM (
      SELECT *, greatest(least((q/n - nrm)/(2*n), dl), 0)/dl AS l FROM (SELECT *, (nrm - 2*mu*(s00+s11) + 2*mu*mu)/2 AS dl FROM (
        SELECT *, (s00+s11)/2 AS mu, s00*s00 + s11*s11 + 2*s01*s01 AS nrm FROM (
          SELECT label, max(ma) AS ma, max(mc) AS mc, avg(u*u) AS s00, avg(w*w) AS s11, avg(u*w) AS s01, sum((u*u + w*w)**2) AS q, count(*) AS n FROM (
            SELECT z.label, m.ma, m.mc, a - m.ma AS u, c - m.mc AS w FROM dz z JOIN (SELECT label, avg(a) AS ma, avg(c) AS mc FROM dz GROUP BY 1) m ON m.label = z.label) e GROUP BY 1) f) g) h) i) j) k""")
define_cte("dparts", ["dz", "dprec"], """
  SELECT *, u*u*p00 AS k0, w*w*p11 AS k1, u*u*p00 + w*w*p11 + 2*u*w*p01 AS distance FROM (SELECT z.sample_id, z.t, guess, a - ma AS u, c - mc AS w, p00, p11, p01 FROM dz z JOIN dprec p ON p.label = guess) e""")
_SIDE = "CASE WHEN {0} > 0 THEN 'above_class_center' WHEN {0} < 0 THEN 'below_class_center' ELSE 'at_class_center' END"


def _distance_rows(spark, d):
    rows = b.bigtraj(spark, d).select(ID, "t", F.array("f_qty", "f_price").alias("x"), (F.col(ID) % 3).alias("label"), ((F.col(ID) + F.col("t").cast("long")) % 3).alias("guess"))
    model = decide.fit_class_distance(rows, "label", [0, 1, 2])
    return explain.distance_explanation(rows, model, ["load__qty", "load__price"], [ID, "t", "guess"], guess="guess")


@query("exp_03_distance_explanation", sql("dparts", f"""
  SELECT sample_id, t, guess, CASE j WHEN 0 THEN 'load__qty' ELSE 'load__price' END AS feature, {q6('k')} AS contribution, {q6('k/(k0 + k1)')} AS fraction, {q6('d')} AS displacement, {_SIDE.format('d')} AS direction, {q6('distance')} AS distance, {q6('distance - k0 - k1')} AS cross_term_residual
  FROM (SELECT *, 0 AS j, k0 AS k, u AS d FROM dparts UNION ALL SELECT *, 1, k1, w FROM dparts) z"""))
def exp_03b(spark, d):
    return rounded(_distance_rows(spark, d))


@query("exp_03_distance_variables", sql("dparts", f"""
  SELECT sample_id, t, guess, 'load' AS variable, {q6('k0 + k1')} AS contribution, {q6('k0*u + k1*w')} AS weighted_displacement, 2::BIGINT AS features, {_SIDE.format('(k0*u + k1*w)')} AS direction FROM dparts"""))
def exp_03c(spark, d):
    return rounded(explain.distance_variables(_distance_rows(spark, d), [ID, "t", "guess"]))


def raw_contributions(spark, d, shift=0.0):
    f = b.feat(spark, d).select(ID, F.posexplode("x").alias("j", "v"))
    names = F.array(*[F.lit(n) for n in NAMES])
    bump = F.when(F.col("j") % 7 == 0, shift).otherwise(0.0)
    return f.select(ID, F.get(names, F.col("j")).alias("feature"), (F.col("v") + bump).alias("contribution"))


_NAME = "'v' || (j // 8) || '__s' || (j % 8)"


@query("exp_04_base_variables", sql("featlong", f"SELECT sample_id, 'v' || (j // 8) AS variable, {q6('sum(v)')} AS signed_sum, {q6('sum(abs(v))')} AS absolute_sum, count(*) AS features FROM featlong GROUP BY 1, 2"))
def exp_04(spark, d):
    return rounded(explain.by_variable(raw_contributions(spark, d), [ID]))


@query("exp_05_faithfulness")
def exp_05(spark, d):
    m, center, held = _model(spark, d)
    return rounded(explain.faithfulness(held, m, center, NAMES))


@query("exp_06_stability", sql("featlong", f"""
  WITH a AS (SELECT sample_id, {_NAME} AS f, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY abs(v) DESC, {_NAME}) AS r FROM featlong),
  c AS (SELECT sample_id, {_NAME} AS f, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY abs(v + CASE WHEN j % 7 = 0 THEN 0.05 ELSE 0 END) DESC, {_NAME}) AS r FROM featlong),
  x AS (SELECT COALESCE(a.sample_id, c.sample_id) AS sample_id, a.r AS ra, c.r AS rb FROM (SELECT * FROM a WHERE r <= 5) a FULL JOIN (SELECT * FROM c WHERE r <= 5) c ON a.sample_id = c.sample_id AND a.f = c.f)
  SELECT sample_id, count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS common, {q6('count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL)/count(*)')} AS jaccard,
         CASE WHEN count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) >= 2 THEN {q6('corr(ra, rb)')} END AS rank_correlation FROM x GROUP BY 1"""))
def exp_06(spark, d):
    return rounded(explain.stability(raw_contributions(spark, d), raw_contributions(spark, d, 0.05), [ID]))


FACTORS = [0.001, 0.3]
_MOVED = ", ".join(f"CASE WHEN t > 0.5 THEN {f} + factor*(SELECT stddev_pop({f}) FROM traj WHERE sample_id % 5 <> 0) ELSE {f} END AS {f}" for f in b.FEATURES)
@query("exp_05_value_faithfulness", sql("traj cls", "SELECT sample_id, 5::BIGINT AS removed, true AS spread_known, true AS exceeds_follows_effects FROM cls"))
def exp_05b(spark, d):
    rows = _feature_rows(spark, d)
    train = rows.where("partition = 'train'")
    ridge = learn.fit_ridge(train, "x", "size")
    out = explain.value_faithfulness(rows, ridge.predict, learn.fit_medians(train))
    return out.select(
        ID, F.size("top_features").cast("long").alias("removed"), (F.col("random_k_std") >= 0).alias("spread_known"),
        (F.col("top_exceeds_random") == (F.col("top_k_effect") > F.col("random_k_effect"))).alias("exceeds_follows_effects"))


define_cte("moved", ["traj"], f"""
  SELECT factor, sample_id, t, {_MOVED} FROM traj CROSS JOIN (VALUES (0.0), {", ".join(f"({x})" for x in FACTORS)}) v(factor)""")
define_cte("movedfeat", ["moved"], """
  SELECT factor, sample_id, feature || '__mean' AS f, avg(x) AS v FROM (SELECT * FROM moved UNPIVOT (x FOR feature IN (f_click, f_view, f_purchase, f_signup, f_error))) z WHERE t > 0.5 AND t <= 12.5 GROUP BY 1, 2, 3
  UNION ALL SELECT factor, sample_id, feature || '__last', max_by(x, t) FROM (SELECT * FROM moved UNPIVOT (x FOR feature IN (f_click, f_view, f_purchase, f_signup, f_error))) z WHERE t > 0.5 AND t <= 12.5 GROUP BY 1, 2, 3""")
define_cte("movedz", ["movedfeat", "cls"], """
  SELECT factor, sample_id, f, (v - m)/s AS z FROM movedfeat JOIN (SELECT f, avg(v) AS m, CASE WHEN stddev_pop(v) >= 1e-9 THEN stddev_pop(v) ELSE 1 END AS s FROM movedfeat WHERE factor = 0 AND sample_id % 5 <> 0 GROUP BY 1) p USING (f)""")
define_cte("movedparts", ["movedz"], """
  WITH k AS (SELECT class, f, avg(z) AS c FROM movedz JOIN cls USING (sample_id) WHERE factor = 0 AND sample_id % 5 <> 0 GROUP BY 1, 2),
  g AS (SELECT factor, sample_id, class AS guess, d FROM (SELECT factor, sample_id, class, avg((z - c)**2) AS d FROM movedz JOIN k USING (f) GROUP BY 1, 2, 3) x QUALIFY ROW_NUMBER() OVER (PARTITION BY factor, sample_id ORDER BY d, class) = 1)
  SELECT z.factor, z.sample_id, z.f, guess, d, round((z.z - k.c)**2, 9) AS part, CASE WHEN d <= 1 THEN 'accepted ' || guess ELSE 'requires_review' END AS status FROM movedz z JOIN g ON g.factor = z.factor AND g.sample_id = z.sample_id JOIN k ON k.f = z.f AND k.class = g.guess""")


def _nearest_class(spark, d):
    """A decision that follows from the raw series: window features, the nearest class centre, and each feature's part of the distance."""
    names = [f"{f}__{s}" for s in ("mean", "last") for f in b.FEATURES]

    def features(raw):
        return win.window_summary(raw, b.FEATURES, [12], b.INJECTION).select(ID, F.array(*names).alias("x"))

    model = learn.fit_centroids(features(b.traj(spark, d)).join(b.cls(spark, d), ID).where(TRAIN), "class")

    def run(raw):
        out = model.predict(features(raw))
        mid = F.element_at(F.create_map(*[v for c, m in model.centers.items() for v in (F.lit(c), F.array(*[F.lit(float(y)) for y in m]))]), F.col("y_pred"))
        lit = lambda vs: F.array(*[F.lit(float(v)) for v in vs])
        z = F.zip_with(F.zip_with("x", lit(model.mean), lambda a, m: a - m), lit(model.spread), lambda a, s: a / s)
        cells = out.select(ID, F.posexplode(F.zip_with(z, mid, lambda a, m: F.round((a - m) * (a - m), 9))).alias("j", "contribution"))
        status = F.when(F.col("distance") <= 1, F.concat(F.lit("accepted "), "y_pred")).otherwise("requires_review")
        return out.select(ID, status.alias("status"), F.col("distance").alias("score")), cells.select(ID, F.get(F.array(*[F.lit(n) for n in names]), F.col("j")).alias("feature"), "contribution")

    return run


@query("exp_06_perturbation_stability", sql("movedparts", f"""
  WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY factor, sample_id ORDER BY part DESC, f) AS r FROM movedparts),
  a AS (SELECT q.factor, sample_id, f, r FROM r CROSS JOIN (VALUES {", ".join(f"({x})" for x in FACTORS)}) q(factor) WHERE r.factor = 0 AND r <= 5), c AS (SELECT factor, sample_id, f, r FROM r WHERE factor > 0 AND r <= 5),
  x AS (SELECT COALESCE(a.factor, c.factor) AS factor, COALESCE(a.sample_id, c.sample_id) AS sample_id, a.r AS ra, c.r AS rb FROM a FULL JOIN c ON a.factor = c.factor AND a.sample_id = c.sample_id AND a.f = c.f),
  s AS (SELECT factor, sample_id, count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS common, count(*) AS every, corr(CASE WHEN rb IS NOT NULL THEN ra END, CASE WHEN ra IS NOT NULL THEN rb END) AS rho FROM x GROUP BY 1, 2),
  st AS (SELECT DISTINCT factor, sample_id, status, d FROM movedparts)
  SELECT p.sample_id, p.factor::DOUBLE AS factor, o.status, p.status AS perturbed_status, o.status <> p.status AS status_changed, {q6('p.d - o.d')} AS score_change, common, {q6('common/every')} AS jaccard, CASE WHEN common >= 2 THEN {q6('rho')} END AS rank_correlation
  FROM st p JOIN st o ON o.factor = 0 AND o.sample_id = p.sample_id JOIN s ON s.factor = p.factor AND s.sample_id = p.sample_id WHERE p.factor > 0"""))
def exp_06b(spark, d):
    t = b.traj(spark, d)
    scales = t.where(TRAIN).agg(*[F.stddev_pop(f).alias(f"{f}_scale") for f in b.FEATURES])
    run = _nearest_class(spark, d)
    parts = [explain.perturbation_stability(t, scales, b.FEATURES, b.INJECTION, run, [ID], x).withColumn("factor", F.lit(x)) for x in FACTORS]
    return rounded(parts[0].unionByName(parts[1]))


@query("exp_07_uncertainty", sql("scored", f"""
  SELECT grp, y_pred AS top1, CASE y_pred WHEN 'A' THEN CASE WHEN p_n >= p_r THEN 'N' ELSE 'R' END WHEN 'N' THEN CASE WHEN p_a >= p_r THEN 'A' ELSE 'R' END ELSE CASE WHEN p_a >= p_n THEN 'A' ELSE 'N' END END AS top2,
         {q6('avg(conf - list_sort([p_a, p_n, p_r])[2])')} AS margin, {q6('avg(1 - conf)')} AS nonconformity, count(*) AS n FROM scored GROUP BY 1, 2, 3"""))
def exp_07(spark, d):
    u = explain.uncertainty(F.array("p_a", "p_n", "p_r"), b.LABELS)
    p = b.pred(spark, d).select("grp", *[c.alias(n) for n, c in u.items()])
    return rounded(p.groupBy("grp", "top1", "top2").agg(F.avg("margin").alias("margin"), F.avg("nonconformity").alias("nonconformity"), F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- streaming


BATCHES = 4


def _event_stream(spark, d):
    """The events as files that arrive one after another, each row up to a day after its time: order within and across files is mixed."""
    path = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    ev = b.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(86_400))
    ev = ordered.attach_row(ev.withColumn("_at", arrival), ev.agg(F.min(F.unix_seconds("ts")).alias("_a"), (F.max(F.unix_seconds("ts")) + 86_400).alias("_b")))
    ev = ev.withColumn("_k", F.floor((F.col("_at") - F.col("_a")) * BATCHES / (F.col("_b") - F.col("_a") + 1)))
    rows = ev.drop("_at", "_a", "_b")
    for k in range(BATCHES):
        rows.where(F.col("_k") == k).drop("_k").write.parquet(f"{path}/{k}")
    src = spark.readStream.schema(rows.drop("_k").schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
    return src.parquet(path)


@query("str_01_online_alarm", sql("", """
  SELECT sample_id, t AS first_alarm_s, 0::BIGINT AS late_rows FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id, island ORDER BY t) AS run FROM (
      SELECT *, sum(CASE WHEN above THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id ORDER BY t) AS island FROM (
        SELECT user_id AS sample_id, round(epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00'), 3) + 0.0 AS t, value > 20 AS above FROM events) z) y WHERE above) x
  WHERE run = 3 QUALIFY ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY t) = 1"""))
def str_01(spark, d):
    s = _event_stream(spark, d).select(F.col("user_id").alias(ID), "ts", r6(b._seconds("ts"), 3).alias("t"), F.col("value").alias("score"))
    path = f"{shared_dir(spark)}/alarms-{uuid.uuid4().hex}"
    online.drain(online.persistent_alarm_stream(s, 20.0, 3, "ts", "2 days"), path)
    told = spark.read.schema(online.ALARM_SCHEMA).parquet(f"{path}/data")
    return online.current_alarms(told).select(ID, "first_alarm_s", "late_rows")


@query("str_02_online_windowed_score", sql("", f"""
  WITH r AS (SELECT event_type, avg(value) AS center, stddev_samp(value) AS scale FROM events GROUP BY 1)
  SELECT user_id AS sample_id, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS day, count(*) AS n, {q6('avg((value-center)/scale)')} AS mean_score, {q6('max(abs((value-center)/scale))')} AS peak_score
  FROM events JOIN r USING (event_type) GROUP BY 1, 2"""))
def str_02(spark, d):
    ref = b.table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("center"), F.stddev_samp("value").alias("scale"))
    s = _event_stream(spark, d).select(F.col("user_id").alias(ID), "ts", "event_type", "value")
    out = online.windowed_score_stream(s, ref, ["event_type"], "value", "ts", "1 day", "2 days")
    path = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}"
    online.upsert(out.select(ID, F.col("window.start").alias("start"), "n", "mean_score", "peak_score"), path)
    got = online.current(spark, path, "sample_id long, start timestamp, n long, mean_score double, peak_score double", [ID, "start"])
    return rounded(got.select(ID, F.datediff("start", F.lit("2024-01-01")).cast("long").alias("day"), "n", "mean_score", "peak_score"))
