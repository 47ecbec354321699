"""ML: baselines, models, calibration, screening and grids on the embedding vectors."""

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tracewell.functions import scalars as sc
from tracewell.operators import bundle, calibrate, learn, metrics, splits
from tracewell.operators.ordered import attach_row
from tracewell.plans import bindings as b
from tracewell.plans.bindings import define_cte, sql
from tracewell.plans.registry import q6, query, r6, rounded
from tracewell.plans.sections.audits import initial_confounding, states
from tracewell.plans.sections.splits import SEEDS
from tracewell.plans.sections.windows import ID
from tracewell.session import cut_lineage, shared_dir
from tracewell.sources import sinks

LABELS = list(range(10))
TRAIN = f"{ID} % 5 <> 0"


@query("ml_01_baselines", sql("sev", f"SELECT count(*) AS n, {q6('avg(severity)')} AS train_mean, min_by(class, -n) AS majority FROM (SELECT *, count(*) OVER (PARTITION BY class) * 100 - ascii(class) / 256.0 AS n FROM sev WHERE sample_id % 5 <> 0) z"))
def ml_01(spark, d):
    tr = b.sev(spark, d).where(TRAIN)
    major = learn.majority_class(tr, "class").select("majority")
    stats = tr.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("severity")).alias("train_mean"))
    return attach_row(major, stats)


def _predictions(spark, d, fit):
    f = b.feat(spark, d)
    return fit(f.where(TRAIN)).predict(f.where(f"NOT ({TRAIN})")).select(ID, "label", "y_pred", r6(F.array_max("probs")).alias("confidence"))


@query("ml_02_logistic")
def ml_02(spark, d):
    return _predictions(spark, d, lambda t: learn.fit_logistic(t, "label", LABELS))


@query("ml_03_forest")
def ml_03(spark, d):
    return _predictions(spark, d, lambda t: learn.fit_forest(t, "label", LABELS))


@query("ml_04_boosted")
def ml_04(spark, d):
    f = b.feat(spark, d)
    fams = [0, 1, 2, 3, 4]
    m = learn.fit_boosted(f.where(TRAIN), "family", fams)
    return m.predict(f.where(f"NOT ({TRAIN})")).select(ID, "family", "y_pred", r6(F.array_max("probs")).alias("confidence"))


@query("ml_05_ridge", sql("bigtraj", f"""
  WITH s AS (SELECT avg(f_qty) AS mx, stddev_pop(f_qty) AS sx, avg(f_price) AS my FROM bigtraj), w AS (SELECT mx, sx, my, sum((f_qty - mx)/sx*(f_price - my))/(sum(((f_qty - mx)/sx)**2) + 10) AS w FROM bigtraj, s GROUP BY ALL)
  SELECT sample_id, t, {q6('my + (f_qty - mx)/sx*w', 4)} AS estimate FROM bigtraj, w"""))
def ml_05(spark, d):
    big = b.bigtraj(spark, d).select(ID, "t", F.array("f_qty").alias("x"), "f_price")
    m = learn.fit_ridge(big, "x", "f_price", 10.0)
    return rounded(big.select(ID, "t", m.predict(F.col("x")).alias("estimate")), 4)


@query("ml_06_tree_regressors")
def ml_06(spark, d):
    rows = b.bigtraj(spark, d).select(ID, "t", F.array("f_qty", "f_disc", "f_tax").alias("x"), "f_price")
    tr, te = cut_lineage(rows.where(TRAIN)), rows.where(f"NOT ({TRAIN})")  # aggregated once for every fit
    with ThreadPoolExecutor(2) as pool:
        forest, boosted = pool.submit(learn.fit_forest_regressor, tr, "f_price"), pool.submit(learn.fit_boosted_regressor, tr, "f_price")
        rf = learn.regress(forest.result(), te, out="forest")
        both = learn.regress(boosted.result(), rf, out="boosted")
    long = both.unpivot(["f_price"], ["forest", "boosted"], "model", "estimate")
    return rounded(metrics.regression(long, ["model"], "f_price", "estimate"), 2)


define_cte("holes", ["featlong"], "SELECT sample_id, label, j, CASE WHEN (sample_id + j) % 37 <> 0 THEN v END AS v FROM featlong")
define_cte("filled", ["holes"], """
  SELECT sample_id, label, h.j, COALESCE(v, m) AS v FROM holes h JOIN (SELECT j, median(v) AS m FROM holes WHERE sample_id % 5 <> 0 GROUP BY 1) q ON q.j = h.j""")
define_cte("zfeat", ["filled"], """
  SELECT sample_id, label, f.j, (v - m)/s AS z FROM filled f JOIN (SELECT j, avg(v) AS m, CASE WHEN stddev_pop(v) >= 1e-9 THEN stddev_pop(v) ELSE 1 END AS s FROM filled WHERE sample_id % 5 <> 0 GROUP BY 1) q ON q.j = f.j""")


def with_holes(spark, d):
    return b.feat(spark, d).withColumn("x", F.transform("x", lambda v, j: F.when((F.col(ID) + j) % 37 != 0, v)))


@query("ml_07_nearest_centroid", sql("zfeat", f"""
  SELECT sample_id, label, c AS y_pred, {q6('d')} AS distance FROM (
    SELECT t.sample_id, t.label, k.label AS c, avg((t.z - k.z)**2) AS d FROM zfeat t JOIN (SELECT label, j, avg(z) AS z FROM zfeat WHERE sample_id % 5 <> 0 GROUP BY 1, 2) k ON k.j = t.j WHERE t.sample_id % 5 = 0 GROUP BY 1, 2, 3) x
  QUALIFY ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY d, c) = 1"""))
def ml_07(spark, d):
    f = with_holes(spark, d)
    m = learn.fit_centroids(f.where(TRAIN), "label")
    return rounded(m.predict(f.where(f"NOT ({TRAIN})")).select(ID, "label", F.col("y_pred").cast("long").alias("y_pred"), "distance"))


@query("ml_08_median_imputation", sql("filled", f"SELECT sample_id, j, {q6('v')} AS v FROM filled"))
def ml_08(spark, d):
    f = with_holes(spark, d)
    fill = learn.fit_medians(f.where(TRAIN))
    out = f.select(ID, F.posexplode(learn.impute("x", fill)).alias("j", "v"))
    return rounded(out.withColumn("j", F.col("j").cast("long")))


@query("ml_09_platt_calibration")
def ml_09(spark, d):
    f = b.feat(spark, d)
    part = F.col(ID) % 5
    base = learn.fit_logistic(f.where(part > 1), "family", [0, 1, 2, 3, 4])
    platt = learn.fit_platt(base.predict(f.where(part == 1)), "family", [0, 1, 2, 3, 4])
    out = base.predict(f.where(part == 0)).withColumn("probs", platt.apply(F.col("probs")))
    return out.select(ID, "family", F.posexplode("probs").alias("k", "p")).withColumn("p", r6("p"))


FAMS = [0, 1, 2, 3, 4]


@query("ml_09_cross_fitted_calibration", sql("feat", f"""
  SELECT sample_id, family, 3::BIGINT AS folds, 'train_only_sigmoid_cv' AS status, 5::BIGINT AS labels, 1.0::DOUBLE AS total, true AS in_range FROM feat WHERE sample_id % 5 = 0"""))
def ml_09b(spark, d):
    f = b.feat(spark, d)
    model = calibrate.fit_calibrated(f.where(TRAIN), "family", FAMS, lambda rows: learn.fit_logistic(rows, "family", FAMS))
    out = model.predict(f.where(f"NOT ({TRAIN})"))
    total = F.aggregate("probs", F.lit(0.0), lambda acc, p: acc + p)
    return out.select(
        ID, "family", F.lit(model.folds).cast("long").alias("folds"), F.lit(model.status).alias("status"), F.size("probs").cast("long").alias("labels"), r6(total).alias("total"),
        F.forall("probs", lambda p: (p > 0) & (p < 1)).alias("in_range"))


@query("ml_10_align_probabilities", sql("pred", f"""
  SELECT row_id, y_true, grp, {q6('p_a/(p_a + p_r)')} AS p_first, 0.0::DOUBLE AS p_second, {q6('p_r/(p_a + p_r)')} AS p_third, count(*) AS n FROM pred GROUP BY ALL"""))
def ml_10(spark, d):
    p = b.pred(spark, d).withColumn("a", sc.align_probabilities(F.array("p_r", "p_n", "p_a"), ["R", "N", "A"], ["A", "X", "R"]))
    out = p.select("row_id", "y_true", "grp", *[r6(F.element_at("a", i + 1)).alias(n) for i, n in enumerate(("p_first", "p_second", "p_third"))])
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


@query("ml_11_input_groups", sql("states cls initconf", """
  WITH f AS (SELECT feature FROM (VALUES ('f_click'),('f_view'),('f_purchase'),('f_signup'),('f_error')) v(feature)),
  p AS (SELECT feature, class, count(*) AS n, count(*) FILTER (present) AS a, count(*) FILTER (changed) AS c, count(*) FILTER (low_cardinality) AS l FROM states JOIN cls USING (sample_id) GROUP BY 1, 2),
  q AS (SELECT *, a/n AS ca, (sum(a) OVER w - a)/(sum(n) OVER w - n) AS oa, c/n AS cc, (sum(c) OVER w - c)/(sum(n) OVER w - n) AS oc, l/n AS cl, (sum(l) OVER w - l)/(sum(n) OVER w - n) AS ol FROM p WINDOW w AS (PARTITION BY feature)),
  k AS (SELECT DISTINCT feature FROM q WHERE (ca >= 0.9 AND oa <= 0.1) OR (cc >= 0.9 AND oc <= 0.1) OR (cl >= 0.9 AND ol <= 0.1 AND cc >= 0.5)),
  i AS (SELECT DISTINCT feature FROM initconf WHERE max_pairwise_mean_diff > greatest(1e-6, global_class_mean_max*1e-6))
  SELECT 'A' AS input_group, feature FROM f UNION ALL SELECT 'B', feature FROM f WHERE feature NOT IN (SELECT feature FROM k)
  UNION ALL SELECT 'C', feature FROM f WHERE feature NOT IN (SELECT feature FROM k) AND feature NOT IN (SELECT feature FROM i)"""))
def ml_11(spark, d):
    from tracewell.operators import audit

    ini = initial_confounding(spark, d)
    leak = audit.leakage_screen(states(spark, d).join(b.cls(spark, d), ID), ini.select("feature", "class", "class_initial_condition_flag"))
    groups = learn.input_groups(b.FEATURES, leak, ini)
    return spark.createDataFrame([(g, f) for g, fs in groups.items() for f in fs], "input_group string, feature string")


define_cte("screen", ["featlong"], """
  SELECT variable, max(dep) AS dependency, max(sig) AS class_signal FROM (
    SELECT j // 8 AS variable, j, abs(corr(rx, ry)) AS dep FROM (
      SELECT j, rank() OVER (PARTITION BY j ORDER BY v) + (count(*) OVER (PARTITION BY j, v) - 1)/2.0 AS rx, rank() OVER (PARTITION BY j ORDER BY sample_id) AS ry FROM featlong WHERE sample_id % 5 <> 0) z GROUP BY 1, 2) a
  JOIN (SELECT j, ssb/(ssb + ssw + 1e-12) AS sig FROM (SELECT j, sum(n*(m-g)*(m-g)) AS ssb, sum(n*v) AS ssw FROM (SELECT *, sum(n*m) OVER (PARTITION BY j)/sum(n) OVER (PARTITION BY j) AS g FROM (
      SELECT j, label, count(*) AS n, avg(v) AS m, var_pop(v) AS v FROM featlong WHERE sample_id % 5 <> 0 GROUP BY 1, 2) z) y GROUP BY 1) x) c USING (j) GROUP BY 1""")


@query("ml_12_feature_screening", sql("screen", f"""
  SELECT variable, {q6('dependency')} AS dependency, {q6('class_signal')} AS class_signal, {q6('signal_median')} AS signal_median, CASE WHEN nleft >= 4 THEN rule ELSE pos > 4 END AS removed FROM (
    SELECT *, sum(CASE WHEN rule THEN 0 ELSE 1 END) OVER () AS nleft, ROW_NUMBER() OVER (ORDER BY class_signal DESC, variable) AS pos FROM (
      SELECT *, median(class_signal) OVER () AS signal_median, dependency >= 0.05 AND class_signal <= median(class_signal) OVER () AS rule FROM screen) z) y"""))
def ml_12(spark, d):
    cells = b.feat(spark, d).where(TRAIN).select(ID, "label", F.posexplode("x").alias("j", "v"))
    cells = cells.withColumn("variable", F.floor(F.col("j") / 8)).withColumnRenamed("j", "statistic")
    return rounded(learn.screen_features(cells, ID, "label", limit=0.05))


def _grid(spark, d):
    f = b.feat(spark, d)
    s = splits.repeated_stratified(f.select(ID, "family"), "family", ID, SEEDS).select(ID, "split_id", "partition")
    rows = f.select(ID, "x", "family").join(s, ID)
    fams = [0, 1, 2, 3, 4]
    models = {"logistic": lambda t: learn.fit_logistic(t, "family", fams), "forest": lambda t: learn.fit_forest(t, "family", fams)}
    return learn.evaluate_grid(rows, [f"seed_{k}" for k in SEEDS], models, [ID, "family"])


@query("ml_13_evaluation_grid")
def ml_13(spark, d):
    p = _grid(spark, d).withColumn("y_pred", F.col("y_pred").cast("long"))
    return rounded(metrics.classification(p, ["split_id", "partition", "model"], [0, 1, 2, 3, 4], "family"))


GRID_WINDOWS, GRID_SEEDS = [6, 12], SEEDS[:2]
GRID_GROUPS = {"A": b.FEATURES, "B": b.FEATURES[:2]}
define_cte("gridcells", ["long", "cls"], f"""
  SELECT s.split_id, s.partition, w.window_s, g.input_group, w.sample_id, s.class, w.feature, w.v FROM (
    SELECT sample_id, class, 'seed_' || seed AS split_id, CASE WHEN k < nt THEN 'test' WHEN k < 2*nt THEN 'validation' ELSE 'train' END AS partition FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY seed, class ORDER BY sha256(seed || '|' || sample_id), sample_id) - 1 AS k, greatest(1, CAST(round_even(0.2*count(*) OVER (PARTITION BY seed, class), 0) AS BIGINT)) AS nt
      FROM cls CROSS JOIN (VALUES {", ".join(f"({s})" for s in GRID_SEEDS)}) v(seed)) z) s
  JOIN (SELECT sample_id, window_s, feature, avg(x) AS v FROM long CROSS JOIN (VALUES (6), (12)) q(window_s) WHERE t > 0.5 AND t <= window_s + 0.5 GROUP BY 1, 2, 3) w USING (sample_id)
  JOIN (VALUES {", ".join(f"('{g}', '{f}')" for g, fs in GRID_GROUPS.items() for f in fs)}) g(input_group, feature) ON g.feature = w.feature""")
define_cte("gridpred", ["gridcells"], """
  WITH z AS (SELECT c.*, (v - m)/s AS z FROM gridcells c JOIN (SELECT split_id, window_s, input_group, feature, avg(v) AS m, CASE WHEN stddev_pop(v) >= 1e-9 THEN stddev_pop(v) ELSE 1 END AS s FROM gridcells WHERE partition = 'train' GROUP BY 1, 2, 3, 4) p USING (split_id, window_s, input_group, feature)),
  k AS (SELECT split_id, window_s, input_group, feature, class AS guess, avg(z) AS z FROM z WHERE partition = 'train' GROUP BY 1, 2, 3, 4, 5),
  n AS (SELECT split_id, window_s, input_group, partition, sample_id, class, guess AS y_pred FROM (
    SELECT z.split_id, z.window_s, z.input_group, z.partition, z.sample_id, z.class, k.guess, avg((z.z - k.z)**2) AS d FROM z JOIN k USING (split_id, window_s, input_group, feature) WHERE partition <> 'train' GROUP BY 1, 2, 3, 4, 5, 6, 7) y
    QUALIFY ROW_NUMBER() OVER (PARTITION BY split_id, window_s, input_group, sample_id ORDER BY d, guess) = 1),
  t AS (SELECT DISTINCT split_id, sample_id, class FROM gridcells WHERE partition = 'train'),
  h AS (SELECT split_id, class AS top FROM t GROUP BY 1, 2 QUALIFY ROW_NUMBER() OVER (PARTITION BY split_id ORDER BY count(*) DESC, class) = 1),
  e AS (SELECT split_id, min(class) AS top FROM t GROUP BY 1)
  SELECT mode, 'centroid' AS model, n.* FROM n CROSS JOIN (VALUES ('unweighted'), ('class_balanced')) v(mode)
  UNION ALL SELECT 'unweighted', 'heaviest_class', n.* REPLACE (top AS y_pred) FROM n JOIN h USING (split_id)
  UNION ALL SELECT 'class_balanced', 'heaviest_class', n.* REPLACE (top AS y_pred) FROM n JOIN e USING (split_id)""")
define_cte("gridmetrics", ["gridpred"], f"""
  SELECT split_id, window_s, input_group, mode, model, partition, sum(tp)/max(n) AS accuracy, avg(CASE WHEN support + predicted > 0 THEN 2*tp/(support + predicted) ELSE 0 END) AS macro_f1_fixed FROM (
    SELECT split_id, window_s, input_group, mode, model, partition, label, count(*) AS n, count(*) FILTER (class = label) AS support, count(*) FILTER (y_pred = label) AS predicted, count(*) FILTER (class = label AND y_pred = label) AS tp
    FROM gridpred CROSS JOIN (VALUES {", ".join(f"('{c}')" for c in b.CLASSES)}) l(label) GROUP BY ALL) z GROUP BY ALL""")


def _cells(spark, d):
    from tracewell.operators import windows as win

    feats = win.window_summary(b.traj(spark, d), b.FEATURES, GRID_WINDOWS, b.INJECTION)
    groups = F.explode(F.array(*[F.struct(F.lit(g).alias("input_group"), F.array(*[f"{f}__mean" for f in fs]).alias("x")) for g, fs in GRID_GROUPS.items()]))
    cells = feats.select(ID, F.col("window_s").cast("int").alias("window_s"), groups.alias("_g")).select(ID, "window_s", "_g.*")
    return cells.join(b.cls(spark, d), ID)


@query("ml_13_grid_selection", sql("gridmetrics", f"""
  SELECT split_id, window_s, input_group, mode, model, candidates, {", ".join(f"{q6(f'{p}.{m}')} AS {n}_{m}" for p, n in (("v", "validation"), ("t", "test")) for m in ("macro_f1_fixed", "accuracy"))} FROM (
    SELECT *, count(*) OVER (PARTITION BY split_id, window_s) AS candidates FROM gridmetrics WHERE partition = 'validation'
    QUALIFY ROW_NUMBER() OVER (PARTITION BY split_id, window_s ORDER BY round(macro_f1_fixed, 9) DESC, round(accuracy, 9) DESC, input_group, mode, model) = 1) v
  JOIN (SELECT * FROM gridmetrics WHERE partition = 'test') t USING (split_id, window_s, input_group, mode, model)"""))
def ml_13b(spark, d):
    rows = _cells(spark, d)
    assigned = splits.repeated_stratified(b.cls(spark, d), "class", ID, GRID_SEEDS)
    models = {"centroid": lambda t: learn.fit_centroids(t, "class"), "heaviest_class": lambda t: learn.fit_heaviest_class(t, "class")}
    pred = learn.evaluation_grid(rows, assigned, models, "class")
    axes = ["input_group", "mode", "model"]
    per = metrics.classification(pred, ["split_id", "window_s", *axes, "partition"], b.CLASSES, "class")
    return rounded(metrics.select_setting(per, ["split_id", "window_s"], axes))


@query("ml_14_two_stage")
def ml_14(spark, d):
    f = b.feat(spark, d)
    top, subs = learn.fit_two_stage(f.where(TRAIN), "family", "label", lambda t, c, labels: learn.fit_logistic(t, c, labels))
    out = learn.predict_two_stage(f.where(f"NOT ({TRAIN})"), top, subs)
    return out.select(ID, "label", "family", F.col("family_pred").cast("long").alias("family_pred"), F.col("y_pred").cast("long").alias("y_pred"), "subtype_status")


@query("ml_15_gated_unknown", sql("scored", "SELECT grp, y_true, CASE WHEN conf >= 0.42 THEN y_pred ELSE 'Unknown' END AS decision, count(*) AS n FROM scored GROUP BY 1, 2, 3"))
def ml_15(spark, d):
    p = b.pred(spark, d).select("grp", "y_true", learn.gated_label(F.array("p_a", "p_n", "p_r"), b.LABELS, 0.42).alias("decision"))
    return p.groupBy("grp", "y_true", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("ml_16_importance_table")
def ml_16(spark, d):
    f = b.feat(spark, d)
    m = learn.fit_forest(f.where(TRAIN), "label", LABELS)
    return rounded(learn.importance_table(spark, m, [f"x{j:02d}" for j in range(64)], 10))


@query("ml_17_frozen_bundle")
def ml_17(spark, d):
    f = b.feat(spark, d)
    fams = [0, 1, 2, 3, 4]
    m = learn.fit_logistic(f.where(TRAIN), "family", fams)
    path = f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    params = f.where(TRAIN).groupBy("family").agg(F.count(F.lit(1)).alias("train_rows"))
    learn.save_bundle(m, params, path)
    again = learn.load_bundle(path, fams)
    a = m.predict(f).select(ID, "y_pred", F.array_max("probs").alias("confidence"))
    c = again.predict(f).select(ID, "y_pred", F.array_max("probs").alias("confidence"))
    files = sinks.file_manifest(spark, path).agg(F.count(F.lit(1)).alias("files"))
    same = metrics.parity(a, c, [ID], ["y_pred"], ["confidence"]).agg(F.count(F.lit(1)).alias("rows"), F.min("passed").alias("identical"))
    return attach_row(same, files).select("rows", "identical", (F.col("files") > 0).alias("has_files"))


@query("ml_17_release_bundle", sql("traj cls", """
  SELECT count(*) AS rows, true AS identical, true AS all_files_ok, 3::BIGINT AS folds FROM cls"""))
def ml_17b(spark, d):
    """Decisions from the bundle that was written and read again against those of the one in memory."""
    from tracewell.operators import decide
    from tracewell.plans.sections.decisions import _bundle, _feature_rows

    fitted, rows = _bundle(spark, d), _feature_rows(spark, d).select(ID, "x")
    path = f"{shared_dir(spark)}/release-{uuid.uuid4().hex}"
    bundle.save(spark, fitted, path)
    again = bundle.load(spark, path)
    side = lambda which: decide.decide_rows(rows, which).select(ID, "y_pred", "status", "tier", "severity_status", F.array_join("conformal_set", "|").alias("members"), "confidence", "distance", "estimate")
    same = metrics.parity(side(fitted), side(again), [ID], ["y_pred", "status", "tier", "severity_status", "members"], ["confidence", "distance", "estimate"])
    one = same.agg(F.count(F.lit(1)).alias("rows"), F.min("passed").alias("identical"))
    files = bundle.check(spark, path).agg(F.min(F.col("status") == "ok").alias("all_files_ok"))
    return attach_row(one, files).withColumn("folds", F.lit(again.classifier.folds).cast("long"))
