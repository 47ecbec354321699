"""Text event logs: parsing, taxonomy matching and first-event tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ranking import top_per_group

# These patterns and category names must equal the published ones.
EVENT_LINE = r"^\s*(\d+(?:\.\d+)?)\s+sec,\s*(.+?)\s*$"
INJECTION = r"(?i)\bMalfunction\s*#\s*\d+\s+Fraction\b"
TAXONOMY = {
    "reactor_scram": r"\bReactor\s+Scram\b",
    "safety_relief_valve_open": r"\bSafety\s+Relief\s+Valve\b.*\bPosition\s+Change:\s*100\s*%",
    "hpi_pump_start": r"\bHPI\s+Pump\b.*\bPosition\s+Change:\s*100\s*%",
    "hpsi_start": r"\bHPSI\b.*\bstart\b",
    "safety_injection": r"\bSafety\s+Injection\b",
    "spray_start": r"\b(?:Containment|Pressurizer)?\s*Spray\b.*(?:\bstart\b|\bPosition\s+Change:\s*100\s*%)",
    "feedwater_isolation": r"\bFeed\s*water\b.*(?:\bisolat\w*\b|\bPosition\s+Change:\s*0\s*%)",
    "steam_isolation": r"\b(?:Main\s+)?Steam(?:\s+Line)?\b.*(?:\bisolat\w*\b|\bPosition\s+Change:\s*0\s*%)",
    "turbine_trip": r"\bTurbine\s+Trip\b|\bTurbine\b.*\bPosition\s+Change:\s*0\s*%",
    "pump_trip": r"\b(?:HPI|LPSI|RHR|Charging|Pump)\b.*(?:\btrip\b|\bPosition\s+Change:\s*0\s*%)",
}
NAMED_EVENTS = {
    "injection_s": r"Malfunction #\s*1 Fraction",
    "hpi_pump_1_s": r"HPI Pump #1 Position Change: 100%",
    "hpi_pump_2_s": r"HPI Pump #2 Position Change: 100%",
    "hpsi_start_s": r"HPSI start",
    "scram_s": r"Reactor Scram",
    "fw_isolation_s": r"FW isolation",
    "ctmt_spray_s": r"Ctmt Spray Starts",
    "accumulator_1_s": r"Accumulator Valve #1 Position Change: 100%",
    "sump_recirc_s": r"Sump Recirc",
    "core_uncovered_s": r"Core Uncovered",
}


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Keep event lines as (time, description); anything else is not an event."""
    stamp = F.regexp_extract(line, EVENT_LINE, 1)
    return (
        lines.withColumn("_stamp", stamp)
        .where(F.col("_stamp") != "")
        .withColumn("t", F.col("_stamp").cast("double"))
        .withColumn("description", F.regexp_extract(line, EVENT_LINE, 2))
        .drop("_stamp", line)
    )


def is_injection(description: str = "description") -> Column:
    return F.col(description).rlike(INJECTION)


def first_injection(parsed: DataFrame, id: str = "sample_id") -> DataFrame:
    """First injection line in file order."""
    hit = F.when(is_injection(), F.col("line_no"))
    return parsed.groupBy(id).agg(
        F.min_by("t", hit).alias("injection_s"), F.min_by("description", hit).alias("injection_event")
    )


def match_taxonomy(parsed: DataFrame, taxonomy: Mapping[str, str] = TAXONOMY) -> DataFrame:
    """One row per (non-injection event, matching category); an event may match several."""
    hits = F.array(*[
        F.when(F.col("description").rlike(f"(?i){rx}"), F.struct(F.lit(i).alias("tax_no"), F.lit(c).alias("category")))
        for i, (c, rx) in enumerate(taxonomy.items())
    ])
    out = parsed.where(~is_injection()).withColumn("_hit", F.explode(F.array_compact(hits)))
    return out.select("*", "_hit.tax_no", "_hit.category").drop("_hit")


def first_named_events(
    parsed: DataFrame, patterns: Mapping[str, str] = NAMED_EVENTS, id: str = "sample_id", earliest: bool = False
) -> DataFrame:
    """First time per named event as columns: first in file order, or the smallest time with `earliest`."""
    aggs = []
    for name, rx in patterns.items():
        hit = F.col("description").rlike(rx)
        aggs.append((F.min(F.when(hit, F.col("t"))) if earliest else F.min_by("t", F.when(hit, F.col("line_no")))).alias(name))
    return parsed.groupBy(id).agg(*aggs)


def first_protection(named: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Smallest of the candidate times and its name; ties go to the earlier candidate in the list."""
    best = F.array_min(F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("t"), F.lit(i).alias("i"), F.lit(c).alias("name"))) for i, c in enumerate(candidates)
    ])))
    return named.withColumn("_b", best).select("*", F.col("_b.t").alias("first_protection_s"), F.col("_b.name").alias("first_protection_event")).drop("_b")


def report_table(lines: DataFrame, taxonomy: Mapping[str, str] = TAXONOMY, id: str = "sample_id", examples: int = 8) -> DataFrame:
    """One row per log: injection, first protection with category, match count, categories, examples.

    Matches collapse to one row per (log, category) before anything is put in order, so a
    log of any length stays distributed; only the first `examples` lines are listed.
    """
    parsed = parse_lines(lines)
    hits = match_taxonomy(parsed, taxonomy)
    seen = F.struct("line_no", "tax_no")
    per_cat = hits.groupBy(id, "category").agg(
        F.min(seen).alias("seen"), F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "line_no", "description")).alias("first"))
    per_id = per_cat.groupBy(id).agg(
        F.min(F.struct(F.col("first.t").alias("t"), F.col("seen").alias("seen"), F.col("first.description").alias("d"), F.col("category").alias("c"))).alias("_p"),
        F.sum("n").alias("protection_match_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seen", "category"))), lambda s: s["category"]), ";").alias("protection_categories"),
    )  # at most one entry per category
    some = top_per_group(hits, [id], ["line_no", "tax_no"], examples).groupBy(id).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(plain_number("t"), F.lit(" sec, "), "description").alias("x")))), lambda s: s["x"]), " || ").alias("protection_match_examples"))
    base = lines.groupBy(id).agg(F.count(F.lit(1)).alias("report_line_count"))
    out = base.join(first_injection(parsed, id), id, "left").join(per_id, id, "left").join(some, id, "left")
    return out.select(
        id, "report_line_count", "injection_s", "injection_event", F.col("injection_s").isNotNull().alias("injection_parse_ok"),
        F.col("_p.t").alias("first_protection_s"), F.col("_p.d").alias("first_protection_event"), F.col("_p.c").alias("first_protection_category"),
        F.coalesce("protection_match_count", F.lit(0)).cast("long").alias("protection_match_count"),
        F.coalesce("protection_categories", F.lit("")).alias("protection_categories"),
        F.coalesce("protection_match_examples", F.lit("")).alias("protection_match_examples"),
        F.col("_p").isNotNull().alias("event_parse_ok"),
    )


def plain_number(c: str) -> Column:
    """Whole numbers without a fraction part, others as they are."""
    return F.when(F.col(c) == F.floor(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string"))


def parse_coverage(reports: DataFrame, classes: DataFrame, id: str = "sample_id", label: str = "class") -> DataFrame:
    """Per class: logs, and how many have an injection and a protection event."""
    return classes.join(reports, id, "left").groupBy(label).agg(
        F.count(F.lit(1)).alias("trajectories"), F.count("report_line_count").alias("reports"),
        F.count("injection_s").alias("injection_parsed"), F.count("first_protection_s").alias("protection_parsed"),
        F.avg(F.col("first_protection_s").isNotNull().cast("int")).alias("protection_rate"),
    )


def category_coverage(hits: DataFrame, classes: DataFrame, id: str = "sample_id", label: str = "class", examples: int = 3) -> DataFrame:
    """Per category: matches, trajectories, classes and a few distinct example descriptions."""
    both = hits.join(classes, id)
    stats = both.groupBy("category").agg(
        F.count(F.lit(1)).alias("matches"), F.countDistinct(id).alias("trajectories"), F.countDistinct(label).alias("classes"))
    some = top_per_group(hits.select("category", "description").distinct(), ["category"], ["description"], examples)
    text = some.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("description")), " || ").alias("examples"))
    return stats.join(text, "category", "left")


def event_table(inventory: DataFrame, reports: DataFrame, id: str = "sample_id") -> DataFrame:
    """One event row per trajectory; a trajectory without a log keeps an empty row."""
    return inventory.join(reports, id, "left").withColumn("report_exists", F.col("report_line_count").isNotNull())


def sensor_event_time(df: DataFrame, signal: str, eps: float = 1e-9, id: str = "sample_id", t: str = "t") -> DataFrame:
    """First time a signal is positive."""
    return df.groupBy(id).agg(F.min(F.when(F.col(signal) > eps, F.col(t))).alias(f"{signal}_first_positive_s"))
