"""Column-level helpers: coercion, guards, labels, names, tolerance, probabilities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(col: str) -> Column:
    """Text to double; anything unreadable, NaN or infinite becomes NULL."""
    v = F.expr(f"try_cast(`{col}` AS DOUBLE)")
    return F.when(is_finite(v), v)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def finite_or_fail(col: str) -> Column:
    """The value, or a job failure naming the column."""
    return F.when(is_finite(F.col(col)), F.col(col)).otherwise(F.raise_error(F.lit(f"{col} contains missing or non-finite values")))


def phase_label(t: Column, injection: float, event: Column) -> Column:
    """Phase of a row; unknown when the event time is missing."""
    return (
        F.when(t < injection, "normal_or_pre_fault")
        .when(event.isNull(), "unknown")
        .when(t < event, "early")
        .otherwise("post_protection")
    )


def relative_change(f: str, window: Column | float) -> dict[str, Column]:
    """Scale-free change features from a window summary's columns."""
    last, delta, mean = F.col(f"{f}__last"), F.col(f"{f}__delta_t0"), F.col(f"{f}__mean")
    t0 = last - delta
    w = window if isinstance(window, Column) else F.lit(float(window))
    scale = F.greatest(F.abs(t0), F.abs(last), F.abs(mean), F.lit(1.0))
    return {
        f"{f}__delta": delta,
        f"{f}__mean_minus_t0": mean - t0,
        f"{f}__relative_delta": delta / scale,
        f"{f}__relative_slope": F.col(f"{f}__slope") * w / scale,
        f"{f}__relative_std": F.col(f"{f}__std") / scale,
    }


def padded_id(prefix: str, n: Column, width: int = 3) -> Column:
    return F.format_string(f"{prefix}%0{width}d", n)


def strip_padding(c: Column, prefix: str) -> Column:
    return F.regexp_replace(c, f"^{prefix}0+(?=[0-9])", prefix)  # a zero id keeps one digit


def base_variable(c: Column) -> Column:
    return F.element_at(F.split(c, "__"), 1)


def statistic(c: Column) -> Column:
    return F.element_at(F.split(c, "__"), -1)


def severity_band(c: Column) -> Column:
    return F.when(c <= 10, "low_1_10").when(c <= 90, "middle_11_90").otherwise("high_91_100")


def map_label(c: Column, mapping: Mapping[str, str], default: str = "unknown_or_other") -> Column:
    """Literal lookup table with a fallback."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(table, c), F.lit(default))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol |b|."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def argmax_label(probs: Column, labels: Sequence[str]) -> Column:
    """Label of the largest probability, the first one on ties."""
    at = F.array_position(probs, F.array_max(probs)).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in labels]), at)


def top_two_margin(probs: Column) -> Column:
    s = F.array_sort(probs)
    return F.when(F.size(s) > 1, F.element_at(s, -1) - F.element_at(s, -2)).otherwise(F.element_at(s, -1))


def label_set(probs: Column, labels: Sequence[str], cutoff: Column | float) -> Column:
    """Labels whose probability reaches the cutoff (1e-12 slack)."""
    c = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    names = F.array(*[F.lit(x) for x in labels])
    keep = F.filter(F.arrays_zip(probs.alias("p"), names.alias("l")), lambda s: s["p"] >= c - 1e-12)
    return F.transform(keep, lambda s: s["l"])


def align_probabilities(probs: Column, model_labels: Sequence[str], labels: Sequence[str]) -> Column:
    """Probabilities in the fixed label order, renormalised; uniform when they sum to zero."""
    where = {x: i for i, x in enumerate(model_labels)}
    raw = F.array(*[F.element_at(probs, where[x] + 1) if x in where else F.lit(0.0) for x in labels])
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(raw, lambda x: x / total)).otherwise(
        F.array(*[F.lit(1.0 / len(labels)) for _ in labels])
    )


def json_safe(c: Column) -> Column:
    """NaN and infinities to NULL."""
    return F.when(is_finite(c), c)
