"""WIN: windowed features, rolling statistics, persistence."""

from pyspark.sql import functions as F

from tracewell.operators import aggregates as agg
from tracewell.operators import align, ordered
from tracewell.operators import windows as win
from tracewell.plans import bindings as b
from tracewell.plans.bindings import define_cte, sql
from tracewell.plans.registry import q6, query, rounded

ID = "sample_id"


def long_traj(spark, d):
    return win.to_long(b.traj(spark, d), [ID, "t"], b.FEATURES)


def reference(spark, d):
    return b.traj(spark, d).where(F.col(ID) == 0)


def events_row(spark, d):
    """First 'error' event per trajectory in days, NULL where there is none."""
    ev = b.table(spark, d, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("double")
    return ev.groupBy(F.col("user_id").alias(ID)).agg(F.min(F.when((F.col("event_type") == "error") & (F.col("value") > 30), day)).alias("first_protection_s"))


def scored(spark, d, features=None):
    """|x - ref| / scale per feature and their row median, against trajectory 0."""
    feats = features or b.FEATURES
    ref = reference(spark, d)
    scales = agg.fit_scales(agg.baseline_scale(win.to_long(ref, [ID, "t"], feats)))
    out = win.normalised_deviation(align.join_reference(b.traj(spark, d), ref, feats), {f: scales.get(f) for f in feats})
    scores = F.array_compact(F.array(*[f"{f}__score" for f in feats]))
    return out.withColumn("composite", row_median(scores))


def row_median(arr):
    """Median of a short array column, NULL when empty."""
    s = F.array_sort(arr)
    n = F.size(s)
    mid = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2
    return F.when(n > 0, mid)


define_cte("evt", [], f"""
  SELECT user_id AS sample_id, MIN(CASE WHEN event_type='error' AND value > 30 THEN CAST({b._DD} AS DOUBLE) END) AS first_protection_s
  FROM events GROUP BY 1""")
define_cte("scale0", ["long"], """
  SELECT feature, CASE WHEN greatest(stddev_samp(x), 0.01*median(abs(x))) >= 1e-6 THEN greatest(stddev_samp(x), 0.01*median(abs(x))) END AS scale
  FROM long WHERE sample_id = 0 GROUP BY feature""")
define_cte("devlong", ["long", "scale0"], """
  SELECT l.sample_id, l.t, l.feature, abs(l.x - r.x)/s.scale AS score
  FROM long l JOIN long r ON r.sample_id = 0 AND r.t = l.t AND r.feature = l.feature JOIN scale0 s ON s.feature = l.feature""")
define_cte("composite", ["devlong"], "SELECT sample_id, t, median(score) AS composite FROM devlong GROUP BY 1, 2")
define_cte("runs", ["composite"], """
  SELECT sample_id, t, composite, composite > 1.0 AS above,
         SUM(CASE WHEN composite > 1.0 THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id ORDER BY t) AS island FROM composite""")
define_cte("alarms", ["runs"], """
  SELECT sample_id, MIN(CASE WHEN above AND run >= 3 THEN t END) AS first_alarm_s FROM (
    SELECT *, SUM(CASE WHEN above THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, island ORDER BY t) AS run FROM runs) z GROUP BY 1""")


def _stats_sql(f):
    return ", ".join([
        f"{q6(f'max_by({f}, t) FILTER (t > 0.5)')} AS {f}__last",
        f"{q6(f'max_by({f}, t) FILTER (t > 0.5) - max_by({f}, t) FILTER (t <= 0.5)')} AS {f}__delta_t0",
        f"{q6(f'avg({f}) FILTER (t > 0.5)')} AS {f}__mean",
        f"{q6(f'stddev_pop({f}) FILTER (t > 0.5)')} AS {f}__std",
        f"{q6(f'coalesce(regr_slope({f}, t) FILTER (t > 0.5), 0)')} AS {f}__slope",
    ])


WINDOW_SQL = """
  SELECT sample_id, CAST(w.window_s AS DOUBLE) AS window_s, max(t) FILTER (t > 0.5) AS last_sample_s, count(*) FILTER (t > 0.5) AS n_points, %s
  FROM traj JOIN windows w ON t <= 0.5 + w.window_s GROUP BY 1, 2"""


@query("win_01_window_summary", sql("traj windows", (WINDOW_SQL % _stats_sql("f_click")).replace("JOIN windows w", "JOIN (SELECT * FROM windows WHERE window_s = 12) w")))
def win_01(spark, d):
    return rounded(win.window_summary(b.traj(spark, d), ["f_click"], [12], b.INJECTION))


@query("win_02_multi_window_dataset", sql("traj windows", WINDOW_SQL % ", ".join(_stats_sql(f) for f in b.CANDIDATES)))
def win_02(spark, d):
    return rounded(win.window_summary(b.traj(spark, d), b.CANDIDATES, b.WINDOWS, b.INJECTION))


@query("win_03_strict_pre_event", sql("traj windows evt", """
  SELECT r.sample_id, CAST(window_s AS DOUBLE) AS window_s, last_sample_s, first_protection_s,
         COALESCE(first_protection_s > last_sample_s, false) AS strict_pre_event
  FROM (SELECT sample_id, window_s, max(t) FILTER (t > 0.5) AS last_sample_s FROM traj JOIN windows w ON t <= 0.5 + w.window_s GROUP BY 1, 2) r
  LEFT JOIN evt e ON e.sample_id = r.sample_id"""))
def win_03(spark, d):
    rows = win.window_summary(b.traj(spark, d), ["f_click"], b.WINDOWS, b.INJECTION).select(ID, "window_s", "last_sample_s")
    return win.strict_pre_event(align.join_events(rows, events_row(spark, d)), "first_protection_s")


@query("win_04_landmark_dataset", sql("traj windows evt", f"""
  SELECT r.*, first_protection_s, first_protection_s - landmark_s AS remaining_s FROM (
    SELECT sample_id, CAST(w.window_s AS DOUBLE) AS landmark_s, max(t) FILTER (t > 0.5) AS last_sample_s, count(*) FILTER (t > 0.5) AS n_points, {_stats_sql("f_click")}
    FROM traj JOIN windows w ON t <= 0.5 + w.window_s GROUP BY 1, 2) r
  JOIN evt e ON e.sample_id = r.sample_id WHERE first_protection_s > landmark_s"""))
def win_04(spark, d):
    return rounded(win.landmark_dataset(b.traj(spark, d), events_row(spark, d), ["f_click"], b.WINDOWS, b.INJECTION))


@query("win_05_rate", sql("traj", f"""
  SELECT sample_id, t, {q6('f_click - lag(f_click) OVER w')} AS f_click__rate, {q6('f_view - lag(f_view) OVER w')} AS f_view__rate
  FROM traj WINDOW w AS (PARTITION BY sample_id ORDER BY t)"""))
def win_05(spark, d):
    return rounded(win.rates(b.traj(spark, d), ["f_click", "f_view"], 1.0, b.SEGMENT).select(ID, "t", "f_click__rate", "f_view__rate"))


def _slope_sql(f, k):
    return f"{q6(f'CASE WHEN count(*) OVER w{k} = {k + 1} THEN regr_slope({f}, t) OVER w{k} END')} AS {f}__slope_{k}"


_FRAMES = "WINDOW " + ", ".join(f"w{k} AS (PARTITION BY sample_id ORDER BY t ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)" for k in (3, 6))


@query("win_06_rolling_slope", sql("traj", f"""
  SELECT sample_id, t, {", ".join(_slope_sql(f, k) for f in ("f_click", "f_error") for k in (3, 6))} FROM traj {_FRAMES}"""))
def win_06(spark, d):
    out = win.rolling_slopes(b.traj(spark, d), ["f_click", "f_error"], [3, 6], 1.0, b.SEGMENT)
    return rounded(out.select(ID, "t", *[f"{f}__slope_{k}" for f in ("f_click", "f_error") for k in (3, 6)]))


@query("win_07_regular_grid_check", sql("bigtraj traj", """
  SELECT src, sample_id, count(*) AS rows, min(dt) AS step_min, max(dt) AS step_max, COALESCE(max(dt) - min(dt) <= 1e-6, true) AS regular FROM (
    SELECT 'daily' AS src, sample_id, t - lag(t) OVER (PARTITION BY sample_id ORDER BY t) AS dt FROM traj
    UNION ALL SELECT 'monthly', sample_id, t - lag(t) OVER (PARTITION BY sample_id ORDER BY t) FROM bigtraj) z GROUP BY 1, 2"""))
def win_07(spark, d):
    both = b.traj(spark, d).select(F.lit("daily").alias("src"), ID, "t").unionByName(b.bigtraj(spark, d).select(F.lit("monthly").alias("src"), ID, "t"))
    return regular_grid(both, ["src", ID])


def regular_grid(df, keys, t="t", width=b.SEGMENT, tolerance=1e-6):
    near = ordered.neighbour(ordered.time_bucket(df, t, width), keys, [t], {"_prev": t})
    dt = F.col(t) - F.col("_prev")
    return near.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(dt).alias("step_min"), F.max(dt).alias("step_max"),
        F.coalesce(F.max(dt) - F.min(dt) <= tolerance, F.lit(True)).alias("regular"),
    )


@query("win_08_feature_groups", sql("traj", f"""
  SELECT * FROM (
    SELECT 'A' AS feature_group, sample_id, t, {q6('f_click')} AS f_click, CAST(NULL AS DOUBLE) AS f_click__rate, CAST(NULL AS DOUBLE) AS f_click__slope_3 FROM traj
    UNION ALL SELECT 'B', sample_id, t, {q6('f_click')}, {q6('f_click - lag(f_click) OVER w3')}, NULL FROM traj {_FRAMES} QUALIFY t >= 1
    UNION ALL SELECT 'C', sample_id, t, {q6('f_click')}, {q6('f_click - lag(f_click) OVER w3')}, {q6('CASE WHEN count(*) OVER w3 = 4 THEN regr_slope(f_click, t) OVER w3 END')} FROM traj {_FRAMES} QUALIFY t >= 3) z"""))
def win_08(spark, d):
    parts = [
        win.feature_groups(b.traj(spark, d), ["f_click"], g, [3], 1.0, b.SEGMENT).withColumn("feature_group", F.lit(g)) for g in "ABC"
    ]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return rounded(out.select("feature_group", ID, "t", "f_click", "f_click__rate", "f_click__slope_3"))


@query("win_09_normalised_deviation", sql("devlong", f"SELECT sample_id, t, feature, {q6('score')} AS score FROM devlong"))
def win_09(spark, d):
    return rounded(score_long(spark, d))


@query("win_09_deviation_from_start", sql("long", f"""
  SELECT l.sample_id, l.t, l.feature, {q6('abs(l.x - r.x)/CASE WHEN abs(s.x) >= 1e-6 THEN abs(s.x) ELSE 1 END')} AS score
  FROM long l JOIN long r ON r.sample_id = 0 AND r.t = l.t AND r.feature = l.feature JOIN long s ON s.sample_id = 0 AND s.t = 0 AND s.feature = l.feature"""))
def win_09b(spark, d):
    ref = reference(spark, d)
    out = win.deviation_from_start(align.join_reference(b.traj(spark, d), ref, b.FEATURES), ref, b.FEATURES)
    long = out.unpivot([ID, "t"], [f"{f}__score" for f in b.FEATURES], "feature", "score")
    return rounded(long.withColumn("feature", F.regexp_replace("feature", "__score$", "")))


def score_long(spark, d):
    long = scored(spark, d).unpivot([ID, "t"], [f"{f}__score" for f in b.FEATURES], "feature", "score")
    return long.withColumn("feature", F.regexp_replace("feature", "__score$", ""))


@query("win_10_persistent_alarm_strict", sql("alarms", "SELECT * FROM alarms"))
def win_10a(spark, d):
    return win.persistent_alarm(scored(spark, d), "composite", 1.0, 3, b.SEGMENT)


@query("win_10_persistent_alarm_legacy", sql("runs", """
  SELECT sample_id, MIN(CASE WHEN above AND pos >= 3 THEN t END) AS first_alarm_s FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id, island ORDER BY t) AS pos FROM runs) z GROUP BY 1"""))
def win_10b(spark, d):
    return win.persistent_alarm(scored(spark, d), "composite", 1.0, 3, b.SEGMENT, semantics="legacy_off_by_one")


@query("win_11_alarm_vs_event", sql("alarms evt", """
  SELECT a.sample_id, first_alarm_s, first_protection_s, first_alarm_s IS NOT NULL AS detected,
         COALESCE(first_alarm_s < first_protection_s, false) AS detected_before_event,
         first_protection_s - first_alarm_s AS lead_time_s, first_alarm_s - 0.5 AS delay_s
  FROM alarms a LEFT JOIN evt e ON e.sample_id = a.sample_id"""))
def win_11(spark, d):
    return win.alarm_vs_event(win_10a(spark, d), events_row(spark, d), b.INJECTION)


@query("win_11_pre_injection_alarm", sql("runs", f"""
  SELECT sample_id, {q6('max(CASE WHEN t < 10 THEN composite END)')} AS pre_injection_max,
         COALESCE(max(CASE WHEN t < 10 THEN above END), false) AS pre_point_alarm,
         max(CASE WHEN t < 10 AND above AND run >= 3 THEN 1 ELSE 0 END) = 1 AS pre_persistent_alarm
  FROM (SELECT *, SUM(CASE WHEN above THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, island ORDER BY t) AS run FROM runs) z GROUP BY 1"""))
def win_11b(spark, d):
    return rounded(win.pre_injection_alarm(scored(spark, d), "composite", 1.0, 3, 10.0, b.SEGMENT))


@query("win_12_early_warning_summary", sql("devlong runs alarms evt", f"""
  WITH first_dev AS (
    SELECT sample_id, feature, MIN(CASE WHEN above AND run >= 3 THEN t END) AS first_dev, max(score) AS peak FROM (
      SELECT *, SUM(CASE WHEN above THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, feature, island ORDER BY t) AS run FROM (
        SELECT *, COALESCE(score > 1.0, false) AS above, SUM(CASE WHEN COALESCE(score > 1.0, false) THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id, feature ORDER BY t) AS island
        FROM devlong) z) y GROUP BY 1, 2),
  comp AS (SELECT sample_id, max(composite) AS peak FROM runs GROUP BY 1)
  SELECT f.sample_id, max(CASE WHEN feature='f_click' THEN first_dev END) AS f_click__first_deviation, {q6("max(CASE WHEN feature='f_click' THEN f.peak END)")} AS f_click__peak,
         max(CASE WHEN feature='f_error' THEN first_dev END) AS f_error__first_deviation, {q6("max(CASE WHEN feature='f_error' THEN f.peak END)")} AS f_error__peak,
         max(a.first_alarm_s) AS composite_first_alarm, {q6('max(c.peak)')} AS composite_peak, max(first_protection_s) AS first_protection_s,
         max(first_protection_s - first_alarm_s) AS lead_time_s
  FROM first_dev f JOIN alarms a ON a.sample_id=f.sample_id JOIN comp c ON c.sample_id=f.sample_id LEFT JOIN evt e ON e.sample_id=f.sample_id GROUP BY 1"""))
def win_12(spark, d):
    s = scored(spark, d)
    return rounded(early_warning_summary(s, events_row(spark, d), ["f_click", "f_error"], b.FEATURES, 1.0, 3, b.SEGMENT))


def early_warning_summary(s, events, shown, features, threshold, k, width):
    """One row per trajectory: first persistent deviation and peak per feature, composite alarm, lead time."""
    cols = [*[f"{f}__score" for f in shown], "composite"]
    long = s.unpivot([ID, "t"], cols, "signal", "score")
    first = win.persistent_alarm(long, "score", threshold, k, width, [ID, "signal"], out="first_deviation")
    peak = long.groupBy(ID, "signal").agg(F.max("score").alias("peak"))
    both = first.join(peak, [ID, "signal"])
    at = lambda sig, c, n: F.max(F.when(F.col("signal") == sig, F.col(c))).alias(n)
    wide = both.groupBy(ID).agg(
        *[at(f"{f}__score", "first_deviation", f"{f}__first_deviation") for f in shown],
        *[at(f"{f}__score", "peak", f"{f}__peak") for f in shown],
        at("composite", "first_deviation", "composite_first_alarm"), at("composite", "peak", "composite_peak"),
    )
    return wide.join(events, ID, "left").withColumn("lead_time_s", F.col("first_protection_s") - F.col("composite_first_alarm"))


@query("win_13_score_vector", sql("devlong", f"""
  SELECT sample_id, feature, {q6('median(score)')} AS median, {q6('avg(score)')} AS mean, {q6('max(score)')} AS max,
         {q6('max_by(score, t)')} AS last, {q6('median(score) FILTER (t <= 10)')} AS median_early
  FROM devlong WHERE score IS NOT NULL GROUP BY 1, 2"""))
def win_13(spark, d):
    return rounded(win.score_vector(score_long(spark, d), "score", 10.0))


@query("win_14_rank_features", sql("devlong", f"""
  SELECT t, feature, {q6('max_score')} AS max_score, rank FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY t ORDER BY max_score DESC NULLS LAST, feature) AS rank
    FROM (SELECT t, feature, max(score) AS max_score FROM devlong WHERE t IN (5, 10, 20) GROUP BY 1, 2) y) z WHERE rank <= 3"""))
def win_14(spark, d):
    out = win.rank_features_at(score_long(spark, d), "score", [5, 10, 20], 3)
    return rounded(out.withColumn("rank", F.col("rank").cast("long")))


@query("win_15_perturbation", sql("traj scale0", f"""
  SELECT sample_id, t, {q6("CASE WHEN t > 0.5 THEN f_click + 0.001*(SELECT stddev_pop(f_click) FROM traj) ELSE f_click END")} AS f_click,
         {q6("CASE WHEN t > 0.5 THEN f_error + 0.001*(SELECT stddev_pop(f_error) FROM traj) ELSE f_error END")} AS f_error FROM traj"""))
def win_15(spark, d):
    t = b.traj(spark, d)
    scales = t.agg(*[F.stddev_pop(f).alias(f"{f}_scale") for f in ("f_click", "f_error")])
    return rounded(win.perturb_after(t, scales, ["f_click", "f_error"], b.INJECTION).select(ID, "t", "f_click", "f_error"))


@query("win_16_screening_summary", sql("devlong scale0 long", f"""
  SELECT feature, {q6('scale')} AS scale, floor_used, n_alarm, {q6('peak')} AS peak, ROW_NUMBER() OVER (ORDER BY n_alarm, floor_used, peak DESC NULLS LAST, feature) AS position FROM (
    SELECT v.feature, max(s.scale) AS scale, bool_or(s.floor_used) AS floor_used, count(*) FILTER (v.score > 1.0) AS n_alarm, max(v.score) AS peak
    FROM devlong v JOIN (SELECT feature, greatest(stddev_samp(x), 0.01*median(abs(x))) AS scale, 0.01*median(abs(x)) > stddev_samp(x) AS floor_used
                         FROM long WHERE sample_id=0 GROUP BY 1) s ON s.feature = v.feature GROUP BY 1) z"""))
def win_16(spark, d):
    from pyspark.sql import Window

    from tracewell.operators.quantiles import medians

    ref = win.to_long(reference(spark, d), [ID, "t"], b.FEATURES)
    std = ref.groupBy("feature").agg(F.stddev_samp("x").alias("s"))
    mag = medians(ref.withColumn("m", F.abs("x")), ["feature"], "m", "med")
    scale = std.join(mag, "feature").select(
        "feature", F.greatest("s", 0.01 * F.col("med")).alias("scale"), (0.01 * F.col("med") > F.col("s")).alias("floor_used"))
    stats = score_long(spark, d).groupBy("feature").agg(F.count_if(F.col("score") > 1.0).alias("n_alarm"), F.max("score").alias("peak"))
    w = Window.partitionBy(F.lit(1)).orderBy("n_alarm", "floor_used", F.col("peak").desc_nulls_last(), "feature")  # one row per feature
    return rounded(scale.join(stats, "feature").withColumn("position", F.row_number().over(w).cast("long")))
