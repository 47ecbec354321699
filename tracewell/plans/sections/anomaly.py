"""ANO: reference-based detectors."""

from pyspark.sql import functions as F

from tracewell.operators import aggregates as agg
from tracewell.operators import align, anomaly, gram, ranking
from tracewell.operators import windows as win
from tracewell.operators.quantiles import quantiles
from tracewell.plans import bindings as b
from tracewell.plans.bindings import define_cte, sql
from tracewell.plans.registry import q6, query, rounded
from tracewell.plans.sections.windows import ID
from tracewell.session import cut_lineage

BIG = ["f_qty", "f_price", "f_disc", "f_tax"]
WIDTH = 12.0


def reference(spark, d):
    """The supplier with the smallest id stands in for the normal trajectory.

    Its rows are few and staged: everything fitted on them sees the same sums, to the last digit.
    """
    big = b.bigtraj(spark, d)
    return cut_lineage(align.restrict(big, big.agg(F.min(ID).alias(ID))))


define_cte("refbig", ["bigtraj"], "SELECT * FROM bigtraj WHERE sample_id = (SELECT min(sample_id) FROM bigtraj)")
define_cte("robref", ["refbig"], """
  SELECT feature, max(c) AS center, greatest(1.4826*median(abs(x - c)), 0.01*median(abs(x)), 1e-12) AS scale FROM (
    SELECT *, median(x) OVER (PARTITION BY feature) AS c FROM refbig UNPIVOT (x FOR feature IN (f_qty, f_price, f_disc, f_tax))) z GROUP BY 1""")
define_cte("robz", ["bigtraj", "robref"], """
  SELECT sample_id, t, median(abs(x - center)/scale) AS robust_z FROM (SELECT * FROM bigtraj UNPIVOT (x FOR feature IN (f_qty, f_price, f_disc, f_tax))) l JOIN robref USING (feature) GROUP BY 1, 2""")


@query("ano_01_robust_z", sql("robz", f"SELECT sample_id, t, {q6('robust_z')} AS robust_z FROM robz"))
def ano_01(spark, d):
    center, scale, _ = anomaly.fit_robust(reference(spark, d), BIG)
    return rounded(b.bigtraj(spark, d).select(ID, "t", anomaly.robust_z(center, scale).alias("robust_z")))


define_cte("moments", ["featlong"], """
  SELECT a.j AS i, c.j AS j, sum(a.v*c.v)/(SELECT count(DISTINCT sample_id) FROM featlong) AS s FROM featlong a JOIN featlong c USING (sample_id) GROUP BY 1, 2""")


@query("ano_02_second_moments", sql("moments", f"SELECT i, j, {q6('s')} AS s FROM moments"))
def ano_02(spark, d):
    g = gram.gram_table(b.feat(spark, d), F.col("x"))
    return rounded(g.select(F.floor(F.col("pos") / 64).alias("i"), (F.col("pos") % 64).cast("long").alias("j"), (F.col("v") / F.col("n")).alias("s")))


define_cte("lw", ["moments", "featlong"], """
  SELECT least(beta, delta)/delta AS shrinkage, mu FROM (
    SELECT mu, (nrm - 2*mu*tr + 64*mu*mu)/64 AS delta, (q/n - nrm)/(64*n) AS beta FROM (
      SELECT sum(s*s) AS nrm, sum(CASE WHEN i = j THEN s END) AS tr, sum(CASE WHEN i = j THEN s END)/64 AS mu FROM moments) a
    CROSS JOIN (SELECT sum(r*r) AS q, count(*) AS n FROM (SELECT sample_id, sum(v*v) AS r FROM featlong GROUP BY 1) z) c) y""")


@query("ano_02_shrinkage", sql("lw", f"SELECT {q6('shrinkage')} AS shrinkage, {q6('mu')} AS mu FROM lw"))
def ano_02b(spark, d):
    g = gram.gram_table(b.feat(spark, d), F.col("x"))
    diag = F.floor(F.col("pos") / 64) == F.col("pos") % 64
    s = F.col("v") / F.col("n")
    one = g.agg(F.sum(s * s).alias("norm"), F.sum(F.when(diag, s)).alias("tr"), F.max("n").alias("n"), F.max("q").alias("q"))
    mu = F.col("tr") / 64
    delta = (F.col("norm") - 2 * mu * F.col("tr") + 64 * mu * mu) / 64
    beta = F.least((F.col("q") / F.col("n") - F.col("norm")) / (64 * F.col("n")), delta)
    return rounded(one.select((beta / delta).alias("shrinkage"), mu.alias("mu")))


# closed 2 x 2 form of the shrunk precision on (f_qty, f_price)
define_cte("z2", ["bigtraj", "robref"], """
  SELECT sample_id, t, (f_qty - (SELECT center FROM robref WHERE feature='f_qty'))/(SELECT scale FROM robref WHERE feature='f_qty') AS a,
         (f_price - (SELECT center FROM robref WHERE feature='f_price'))/(SELECT scale FROM robref WHERE feature='f_price') AS c FROM bigtraj""")
define_cte("prec2", ["z2"], """
  SELECT v11/det AS p11, v00/det AS p00, -v01/det AS p01 FROM (SELECT *, v00*v11 - v01*v01 AS det FROM (
    SELECT (1-l)*s00 + l*mu AS v00, (1-l)*s11 + l*mu AS v11, (1-l)*s01 AS v01 FROM (
      SELECT *, least((q/n - nrm)/(2*n), dl)/dl AS l FROM (SELECT *, (nrm - 2*mu*(s00+s11) + 2*mu*mu)/2 AS dl FROM (
        SELECT *, (s00+s11)/2 AS mu, s00*s00 + s11*s11 + 2*s01*s01 AS nrm FROM (
          SELECT avg(a*a) AS s00, avg(c*c) AS s11, avg(a*c) AS s01, sum((a*a + c*c)**2) AS q, count(*) AS n FROM z2 WHERE sample_id = (SELECT min(sample_id) FROM z2)) e) f) g) h) i) j""")


def two_feature_model(spark, d):
    center, scale, _ = anomaly.fit_robust(reference(spark, d), BIG[:2])
    lw = gram.ledoit_wolf(gram.fit_moments(reference(spark, d), anomaly.standardised(center, scale)))
    return center, scale, lw


@query("ano_03_mahalanobis", sql("z2 prec2", f"SELECT sample_id, t, {q6('sqrt(greatest(0, a*a*p11 + c*c*p00 + 2*a*c*p01))')} AS mahalanobis FROM z2 CROSS JOIN prec2"))
def ano_03(spark, d):
    center, scale, lw = two_feature_model(spark, d)
    z = anomaly.standardised(center, scale)
    return rounded(b.bigtraj(spark, d).select(ID, "t", F.sqrt(gram.quadratic_form(z, lw.precision)).alias("mahalanobis")))


@query("ano_04_pca_reconstruction")
def ano_04(spark, d):
    f = b.feat(spark, d)
    mean = f.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m")).orderBy("j").collect()
    mu = F.array(*[F.lit(r["m"]) for r in mean])
    z = F.zip_with("x", mu, lambda a, c: a - c)
    axes = gram.principal_axes(gram.fit_moments(f, z), 0.95)
    return rounded(f.select(ID, "label", gram.reconstruction_rmse(z, axes).alias("pca_error")))


@query("ano_05_threshold", sql("robz", f"SELECT 'robust_z' AS method, count(*) AS n, {q6('quantile_cont(robust_z, 0.995)')} AS threshold FROM robz WHERE sample_id = (SELECT min(sample_id) FROM robz)"))
def ano_05(spark, d):
    ref = reference(spark, d)
    center, scale, _ = anomaly.fit_robust(ref, BIG)
    s = ref.select(F.lit("robust_z").alias("method"), anomaly.robust_z(center, scale).alias("score"))
    return rounded(quantiles(s, ["method"], "score", {"threshold": 0.995}))


def big_events(spark, d):
    """First month in which a supplier ships more than 250 units."""
    return b.bigtraj(spark, d).groupBy(ID).agg(F.min(F.when(F.col("f_qty") > 250, F.col("t"))).alias("first_protection_s"))


@query("ano_06_detector_cases")
def ano_06(spark, d):
    model = anomaly.fit_reference(reference(spark, d), BIG)
    ids = [r[ID] for r in b.bigtraj(spark, d).agg(F.min(ID).alias(ID)).collect()]
    return rounded(anomaly.evaluate_detectors(b.bigtraj(spark, d), model, big_events(spark, d), ids, 2, WIDTH, b.INJECTION)[0])


@query("ano_06_detector_summary")
def ano_06b(spark, d):
    model = anomaly.fit_reference(reference(spark, d), BIG)
    ids = [r[ID] for r in b.bigtraj(spark, d).agg(F.min(ID).alias(ID)).collect()]
    return rounded(anomaly.evaluate_detectors(b.bigtraj(spark, d), model, big_events(spark, d), ids, 2, WIDTH, b.INJECTION)[1])


define_cte("robcases", ["robz", "bigtraj"], """
  SELECT z.*, limit_, CAST(z.sample_id % 12 AS DOUBLE) AS start_s, robust_z > limit_ AS above FROM robz z CROSS JOIN (SELECT quantile_cont(robust_z, 0.95) AS limit_ FROM robz WHERE sample_id = (SELECT min(sample_id) FROM robz)) q WHERE t > z.sample_id % 12""")


@query("ano_06_cases_after_start", sql("robcases bigtraj", f"""
  WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id, island ORDER BY t) AS run FROM (SELECT *, sum(CASE WHEN above THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id ORDER BY t) AS island FROM robcases) z WHERE above),
  a AS (SELECT sample_id, min(t) AS first_alarm_s FROM r WHERE run = 2 GROUP BY 1),
  p AS (SELECT sample_id, max(start_s) AS start_s, count(*) AS points, count(*) FILTER (above) AS points_above FROM robcases GROUP BY 1),
  e AS (SELECT sample_id, min(CASE WHEN f_qty > 250 THEN t END) AS first_protection_s FROM bigtraj GROUP BY 1)
  SELECT sample_id, 'robust_z' AS method, start_s, points, points_above, first_alarm_s, first_protection_s, first_alarm_s IS NOT NULL AS detected, COALESCE(first_alarm_s < first_protection_s, false) AS detected_before_event,
         first_protection_s - first_alarm_s AS lead_time_s, first_alarm_s - start_s AS delay_s FROM p LEFT JOIN a USING (sample_id) LEFT JOIN e USING (sample_id)"""))
def ano_06c(spark, d):
    ref = reference(spark, d)
    center, scale, _ = anomaly.fit_robust(ref, BIG)
    score = anomaly.robust_z(center, scale)
    limit = quantiles(ref.select(score.alias("s")), [], "s", {"q": 0.95}).first()["q"]
    long = b.bigtraj(spark, d).select(ID, "t", F.lit("robust_z").alias("method"), score.alias("score"), F.lit(limit).alias("limit"))
    starts = b.bigtraj(spark, d).select(ID, (F.col(ID) % 12).cast("double").alias("injection_s")).distinct()
    return anomaly.detector_cases(long, big_events(spark, d), starts, 2, WIDTH)


define_cte("gatescale", ["refbig"], """
  SELECT feature, CASE WHEN greatest(stddev_samp(x), 0.01*median(abs(x))) >= 1e-6 THEN greatest(stddev_samp(x), 0.01*median(abs(x))) END AS scale
  FROM refbig UNPIVOT (x FOR feature IN (f_qty, f_price)) GROUP BY 1""")


def _gate(src, keys):
    """Composite deviation from an interpolated reference and its legacy persistent alarm, in SQL."""
    kk = "".join(f", {k}" for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    join = " AND ".join([f"x.{k} = g.{k}" for k in keys]) or "true"
    return f"""
  WITH seg AS (SELECT t AS t0{kk}, lead(t) OVER w AS t1, f_qty AS q0, lead(f_qty) OVER w AS q1, f_price AS r0, lead(f_price) OVER w AS r1 FROM {src}_ref WINDOW w AS ({part}ORDER BY t)),
  al AS (SELECT x.*, CASE WHEN t1 IS NULL THEN q0 ELSE q0 + (q1-q0)*(t-t0)/(t1-t0) END AS qr, CASE WHEN t1 IS NULL THEN r0 ELSE r0 + (r1-r0)*(t-t0)/(t1-t0) END AS rr FROM {src} x JOIN seg g ON {join} AND ((t >= t0 AND t < t1) OR (t1 IS NULL AND t = t0))),
  sc AS (SELECT sample_id{kk}, t, (abs(f_qty-qr)/(SELECT scale FROM gatescale WHERE feature='f_qty') + abs(f_price-rr)/(SELECT scale FROM gatescale WHERE feature='f_price'))/2 AS composite FROM al),
  ru AS (SELECT *, composite > 1.0 AS above, sum(CASE WHEN composite > 1.0 THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id{kk} ORDER BY t) AS island FROM sc),
  po AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id{kk}, island ORDER BY t) AS pos FROM ru)
  SELECT sample_id{kk}, {q6('max(composite)')} AS peak_score, min(CASE WHEN above AND pos >= 3 THEN t END) AS first_alarm_s FROM po GROUP BY sample_id{kk}"""


define_cte("big", ["bigtraj"], "SELECT sample_id, t, f_qty, f_price FROM bigtraj")
define_cte("big_ref", ["big"], "SELECT * FROM big WHERE sample_id = (SELECT min(sample_id) FROM big)")


def gate_scales(spark, d):
    ref = win.to_long(reference(spark, d), [ID, "t"], BIG[:2])
    return agg.fit_scales(agg.baseline_scale(ref))


@query("ano_07_rule_gate", sql("big big_ref gatescale", _gate("big", [])))
def ano_07(spark, d):
    big = b.bigtraj(spark, d).select(ID, "t", *BIG[:2])
    return rounded(anomaly.deviation_gate(big, reference(spark, d).select(ID, "t", *BIG[:2]), BIG[:2], gate_scales(spark, d), 1.0, 3, 2.0, WIDTH))


define_cte("cond", ["big"], "SELECT *, sample_id % 4 AS cond FROM big")
define_cte("cond_ref", ["cond"], "SELECT * FROM cond WHERE sample_id IN (SELECT min(sample_id) FROM cond GROUP BY cond)")


@query("ano_08_condition_gate", sql("cond cond_ref gatescale", f"""
  SELECT a.*, a.sample_id = m.reference_id AS is_self, NOT (a.sample_id = m.reference_id AND (first_alarm_s IS NOT NULL OR peak_score > 1e-9)) AS self_quiet
  FROM ({_gate("cond", ["cond"])}) a JOIN (SELECT cond, min(sample_id) AS reference_id FROM cond GROUP BY 1) m USING (cond)"""))
def ano_08(spark, d):
    big = b.bigtraj(spark, d).select(ID, "t", *BIG[:2], (F.col(ID) % 4).alias("cond"))
    refs = big.groupBy("cond").agg(F.min(ID).alias("reference_id"))
    ref_rows = align.restrict(big, refs.select(F.col("reference_id").alias(ID)))
    out = anomaly.deviation_gate(big, ref_rows.drop(ID), BIG[:2], gate_scales(spark, d), 1.0, 3, 2.0, WIDTH, ["cond"])
    is_self = F.col(ID) == F.col("reference_id")
    quiet = ~(is_self & (F.col("first_alarm_s").isNotNull() | (F.col("peak_score") > 1e-9)))
    return rounded(out.join(refs, "cond").select(ID, "cond", "peak_score", "first_alarm_s", is_self.alias("is_self"), quiet.alias("self_quiet")))
