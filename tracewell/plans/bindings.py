"""Bindings of the engine's input shapes to the given tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.ordered import BUCKET, quantile_bucket, row_numbers

FEATURES = ["f_click", "f_view", "f_purchase", "f_signup", "f_error"]
CANDIDATES = FEATURES[:4]
CLASSES = ["click", "error", "purchase", "signup", "view"]
LABELS = ["A", "N", "R"]
INJECTION = 0.5
WINDOWS = [3, 6, 12, 24]
HORIZON_DAYS = 30
SEGMENT = 8.0  # days per time bucket
ORIGIN = "2024-01-01 00:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _seconds(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 - F.unix_timestamp(F.lit(ORIGIN))


def traj(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select(
        F.col("user_id").alias("sample_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("day"), "event_type", "value"
    )
    daily = ev.groupBy("sample_id", "day").agg(
        *[F.sum(F.when(F.col("event_type") == c[2:], F.col("value")).otherwise(0.0)).alias(c) for c in FEATURES]
    )
    grid = ev.select("sample_id").distinct().withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(HORIZON_DAYS - 1))))
    return grid.join(daily, ["sample_id", "day"], "left").select(
        "sample_id", F.col("day").cast("double").alias("t"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES]
    )


def faulty(spark: SparkSession, d: str) -> DataFrame:
    """`traj` with injected faults: missing cells, NaN, a missing column, repeated and truncated rows."""
    r = traj(spark, d).withColumn("_k", F.col("t").cast("long"))
    sid, k = F.col("sample_id"), F.col("_k")
    r = r.where((sid % 7 != 0) | (F.col("t") <= 5))
    r = r.withColumn("dup", F.explode(F.when((sid + k) % 101 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return r.select(
        "sample_id", "t", "dup", F.when((sid * 31 + k) % 97 != 0, F.col("f_click")).alias("f_click"),
        F.when((sid * 17 + k) % 89 == 0, F.lit(float("nan"))).otherwise(F.col("f_view")).alias("f_view"), "f_purchase",
        F.when(sid % 11 != 0, F.col("f_signup")).alias("f_signup"), "f_error",
    )


def faulty_file(spark: SparkSession, d: str) -> DataFrame:
    """`faulty` with each row's place in its source, `ord`; some rows stand behind the row of the next day."""
    sid, k = F.col("sample_id"), F.col("t").cast("long")
    return faulty(spark, d).withColumn("ord", 20 * k + F.col("dup") + F.when((sid + k) % 53 == 0, 25).otherwise(0))


def headers(spark: SparkSession, d: str) -> DataFrame:
    """Column names of each source of `faulty_file`: one lacks a feature, others have a name too many or one twice."""
    sid = F.col("sample_id")
    names = F.concat(
        F.array(*[F.lit(c) for c in ["t", *FEATURES[:3], FEATURES[4]]]), F.when(sid % 11 != 0, F.array(F.lit(FEATURES[3]))).otherwise(F.array().cast("array<string>")),
        F.when(sid % 13 == 0, F.array(F.lit("note"))).when(sid % 17 == 0, F.array(F.lit("f_view"))).otherwise(F.array().cast("array<string>")))
    return cls(spark, d).select(sid, F.explode(names).alias("column"))


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Events in an order in which neighbours are swapped, so that times fall now and then."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("sample_id"), F.col("event_id").bitwiseXOR(F.lit(341)).alias("ord"), F.floor(_seconds("ts")).cast("double").alias("t"))


def cls(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.col("user_id").alias("sample_id")).agg(
        F.min_by("event_type", F.struct((-F.col("n")).alias("n"), "event_type")).alias("class")
    )


def evlog(spark: SparkSession, d: str) -> DataFrame:
    text = (
        F.when(F.col("event_type") == "signup", "Malfunction #1 Fraction 0.5")
        .when(F.col("event_type") == "error", "Reactor Scram")
        .when(F.col("event_type") == "purchase", "HPI Pump #1 Position Change: 100%")
        .when(F.col("event_type") == "view", "Safety Injection")
        .otherwise("Turbine Trip")
    )
    return table(spark, d, "events").select(
        F.col("user_id").alias("sample_id"),
        F.col("event_id").alias("line_no"),
        F.concat(F.lit("  "), F.floor(_seconds("ts")).cast("string"), F.lit(" sec, "), text).alias("line"),
    )


def sev(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("class"), "c_acctbal")
    placed = quantile_bucket(c, ["class"], "c_acctbal")
    return row_numbers(placed, ["class"], ["c_acctbal", "sample_id"], "severity").select("sample_id", "class", "severity")


def bigtraj(spark: SparkSession, d: str) -> DataFrame:
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").alias("sample_id"), month.cast("double").alias("t"))
        .agg(
            F.sum("l_quantity").alias("f_qty"), F.sum("l_extendedprice").alias("f_price"),
            F.avg("l_discount").alias("f_disc"), F.avg("l_tax").alias("f_tax"), F.count(F.lit(1)).alias("n"),
        )
    )


def pred(spark: SparkSession, d: str) -> DataFrame:
    return pred_quantity(spark, d).drop("quantity")


def pred_quantity(spark: SparkSession, d: str) -> DataFrame:
    """`pred` with the number that a second model is to estimate."""
    li = table(spark, d, "lineitem")
    flag = lambda v: F.when(F.col("l_returnflag") == v, 0.8).otherwise(0.0)
    w = li.select(
        (F.col("l_orderkey") * 1000 + F.col("l_partkey") % 100 * 10 + F.col("l_linenumber")).alias("row_id"),
        F.col("l_returnflag").alias("y_true"), F.col("l_linestatus").alias("grp"), F.col("l_quantity").cast("double").alias("quantity"),
        (1 + F.col("l_quantity") / 50 + flag("A")).alias("w_a"),
        (1 + F.col("l_discount") * 10 + flag("N")).alias("w_n"),
        (1 + F.col("l_tax") * 12 + flag("R")).alias("w_r"),
    )
    total = F.col("w_a") + F.col("w_n") + F.col("w_r")
    return w.select("row_id", "y_true", "grp", "quantity", *[(F.col(f"w_{k}") / total).alias(f"p_{k}") for k in "anr"])


def feat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"),
        F.col("label").cast("long").alias("label"), F.floor(F.col("label") / 2).cast("long").alias("family"),
    )


def feature_dict(spark: SparkSession) -> DataFrame:
    rows = [(f, "process", "candidate") for f in CANDIDATES] + [("f_error", "direct", "exclude")]
    return spark.createDataFrame(rows, "feature string, `group` string, policy string")


FAMILY = {"click": "browse", "view": "browse", "purchase": "convert", "signup": "convert", "error": "fault"}
TIER = {"browse": "Tier A", "convert": "Tier B", "fault": "Tier C"}

# ---------------------------------------------------------------- SQL twins

_DD = "date_diff('day', TIMESTAMP '2024-01-01 00:00:00', ts)"
_SEC = "CAST(floor(epoch(ts)-epoch(TIMESTAMP '2024-01-01 00:00:00')) AS BIGINT)"
_MON = "((year(l_shipdate)-1995)*12+month(l_shipdate)-1)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "traj": ((), f"""
      SELECT g.user_id AS sample_id, CAST(g.day AS DOUBLE) AS t,
             COALESCE(f_click,0) AS f_click, COALESCE(f_view,0) AS f_view, COALESCE(f_purchase,0) AS f_purchase,
             COALESCE(f_signup,0) AS f_signup, COALESCE(f_error,0) AS f_error
      FROM (SELECT u.user_id, k.day FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN range(0,30) k(day)) g
      LEFT JOIN (SELECT user_id, {_DD} AS day,
                   SUM(CASE WHEN event_type='click' THEN value ELSE 0 END) AS f_click,
                   SUM(CASE WHEN event_type='view' THEN value ELSE 0 END) AS f_view,
                   SUM(CASE WHEN event_type='purchase' THEN value ELSE 0 END) AS f_purchase,
                   SUM(CASE WHEN event_type='signup' THEN value ELSE 0 END) AS f_signup,
                   SUM(CASE WHEN event_type='error' THEN value ELSE 0 END) AS f_error
                 FROM events GROUP BY 1, 2) a ON g.user_id=a.user_id AND g.day=a.day"""),
    "faulty": (("traj",), """
      SELECT sample_id, t, dup, CASE WHEN (sample_id*31 + CAST(t AS BIGINT)) % 97 <> 0 THEN f_click END AS f_click,
             CASE WHEN (sample_id*17 + CAST(t AS BIGINT)) % 89 = 0 THEN 'NaN'::DOUBLE ELSE f_view END AS f_view, f_purchase,
             CASE WHEN sample_id % 11 <> 0 THEN f_signup END AS f_signup, f_error
      FROM traj JOIN (VALUES (0), (1)) v(dup) ON dup = 0 OR (sample_id + CAST(t AS BIGINT)) % 101 = 0
      WHERE sample_id % 7 <> 0 OR t <= 5"""),
    "faultyfile": (("faulty",), """
      SELECT *, 20*CAST(t AS BIGINT) + dup + CASE WHEN (sample_id + CAST(t AS BIGINT)) % 53 = 0 THEN 25 ELSE 0 END AS ord FROM faulty"""),
    "headers": (("cls",), """
      SELECT sample_id, unnest(list_concat(['t','f_click','f_view','f_purchase','f_error'], CASE WHEN sample_id % 11 <> 0 THEN ['f_signup'] ELSE [] END,
             CASE WHEN sample_id % 13 = 0 THEN ['note'] WHEN sample_id % 17 = 0 THEN ['f_view'] ELSE [] END)) AS col FROM cls"""),
    "arrivals": ((), f"""
      SELECT user_id AS sample_id, xor(event_id, 341) AS ord, CAST({_SEC} AS DOUBLE) AS t FROM events"""),
    "long": (("traj",), "SELECT sample_id, t, feature, x FROM traj UNPIVOT (x FOR feature IN (f_click, f_view, f_purchase, f_signup, f_error))"),
    "cls": ((), """
      SELECT user_id AS sample_id, event_type AS class FROM (
        SELECT user_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, event_type) AS rn
        FROM events GROUP BY user_id, event_type) q WHERE rn=1"""),
    "evlog": ((), f"""
      SELECT user_id AS sample_id, event_id AS line_no,
             CONCAT('  ', CAST({_SEC} AS VARCHAR), ' sec, ',
               CASE event_type WHEN 'signup' THEN 'Malfunction #1 Fraction 0.5' WHEN 'error' THEN 'Reactor Scram'
                    WHEN 'purchase' THEN 'HPI Pump #1 Position Change: 100%' WHEN 'view' THEN 'Safety Injection'
                    ELSE 'Turbine Trip' END) AS line
      FROM events"""),
    "parsed": (("evlog",), r"""
      SELECT sample_id, line_no, CAST(regexp_extract(line, '^\s*(\d+(?:\.\d+)?)\s+sec,\s*(.+?)\s*$', 1) AS DOUBLE) AS t,
             regexp_extract(line, '^\s*(\d+(?:\.\d+)?)\s+sec,\s*(.+?)\s*$', 2) AS description
      FROM evlog WHERE regexp_matches(line, '^\s*(\d+(?:\.\d+)?)\s+sec,\s*(.+?)\s*$')"""),
    "sev": ((), """
      SELECT c_custkey AS sample_id, c_mktsegment AS class,
             ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS severity
      FROM customer"""),
    "bigtraj": ((), f"""
      SELECT l_suppkey AS sample_id, CAST({_MON} AS DOUBLE) AS t, SUM(l_quantity) AS f_qty, SUM(l_extendedprice) AS f_price,
             AVG(l_discount) AS f_disc, AVG(l_tax) AS f_tax, COUNT(*) AS n FROM lineitem GROUP BY 1, 2"""),
    "pred": (("predq",), "SELECT * EXCLUDE (quantity) FROM predq"),
    "predq": ((), """
      SELECT l_orderkey*1000+l_partkey%100*10+l_linenumber AS row_id, l_returnflag AS y_true, l_linestatus AS grp, CAST(l_quantity AS DOUBLE) AS quantity,
             w_a/(w_a+w_n+w_r) AS p_a, w_n/(w_a+w_n+w_r) AS p_n, w_r/(w_a+w_n+w_r) AS p_r
      FROM (SELECT *, 1+l_quantity/50+(CASE WHEN l_returnflag='A' THEN 0.8 ELSE 0.0 END) AS w_a,
                   1+l_discount*10+(CASE WHEN l_returnflag='N' THEN 0.8 ELSE 0.0 END) AS w_n,
                   1+l_tax*12+(CASE WHEN l_returnflag='R' THEN 0.8 ELSE 0.0 END) AS w_r FROM lineitem) q"""),
    "scored": (("pred",), """
      SELECT *, CASE WHEN p_a >= p_n AND p_a >= p_r THEN 'A' WHEN p_n >= p_r THEN 'N' ELSE 'R' END AS y_pred,
             greatest(p_a, p_n, p_r) AS conf FROM pred"""),
    "feat": ((), """
      SELECT vec_id AS sample_id, CAST(label AS BIGINT) AS label, CAST(floor(label/2) AS BIGINT) AS family, embedding AS x FROM embeddings"""),
    "featlong": (("feat",), """
      SELECT sample_id, label, family, i AS j, CAST(x[i+1] AS DOUBLE) AS v FROM feat, range(0,64) k(i)"""),
    "feature_dict": ((), """
      SELECT * FROM (VALUES ('f_click','process','candidate'),('f_view','process','candidate'),('f_purchase','process','candidate'),
             ('f_signup','process','candidate'),('f_error','direct','exclude')) v(feature, "group", policy)"""),
    "family": ((), """
      SELECT * FROM (VALUES ('click','browse'),('view','browse'),('purchase','convert'),('signup','convert'),('error','fault')) v(class, family)"""),
    "tier": ((), "SELECT * FROM (VALUES ('browse','Tier A'),('convert','Tier B'),('fault','Tier C')) v(family, tier)"),
    "windows": ((), "SELECT * FROM (VALUES (3),(6),(12),(24)) v(window_s)"),
}


def define_cte(name: str, needs: Sequence[str], body: str) -> None:
    CTES[name] = (tuple(needs), body)


def sql(needs: Sequence[str] | str, body: str) -> str:
    """Prefix `body` with the named common table expressions and what they need."""
    names = needs.split() if isinstance(needs, str) else list(needs)
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    body = body.strip()
    head = ", ".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
