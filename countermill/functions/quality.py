"""Validity predicates and quality grades as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from countermill.vocab import NEAR_OVERFLOW, OVERFLOW_THRESHOLD, QUALITY, STATUS


def _label(code: Column, names: dict[str, int]) -> Column:
    pairs = [F.lit(x) for name, value in names.items() for x in (value, name)]
    return F.try_element_at(F.create_map(*pairs), code)


def quality_name(code: Column) -> Column:
    return _label(code, QUALITY)


def status_name(code: Column) -> Column:
    return _label(code, STATUS)


def is_valid_range(raw: Column, low: Column, high: Column) -> Column:
    """Inclusive range; a NULL bound is open."""
    return F.coalesce(raw >= low, F.lit(True)) & F.coalesce(raw <= high, F.lit(True))


def is_valid_range_strict(raw: Column, low: Column, high: Column) -> Column:
    """Inclusive range; a NULL bound fails."""
    return F.coalesce((raw >= low) & (raw <= high), F.lit(False))


def is_valid_rate(rate: Column, limit: Column) -> Column:
    return F.coalesce(F.abs(rate) <= limit, F.lit(True))


def is_valid_rate_by_name(rate: Column, name: Column) -> Column:
    return is_valid_rate(rate, F.when(name.contains("Temperature"), F.lit(10.0)).otherwise(F.lit(1000.0)))


def overflow_limit(tag_value: Column, tag_type: Column) -> Column:
    """Threshold from a typed channel tag: default without a tag, NULL (no check) unless it is a long."""
    return F.when(tag_value.isNull(), F.lit(OVERFLOW_THRESHOLD).cast("bigint")).when(
        tag_type == "long", tag_value.try_cast("bigint")
    )


def near_overflow(count: Column, limit: int = NEAR_OVERFLOW) -> Column:
    return count > F.lit(limit)


def grade_quality(
    raw: Column,
    rate: Column,
    low: Column,
    high: Column,
    rate_limit: Column,
    overflow_threshold: Column,
    overflow_check: Column,
) -> Column:
    """Quality code; the first rule that hits wins: range, rate, overflow."""
    overflows = F.coalesce(overflow_check, F.lit(True)) & (
        raw > F.coalesce(overflow_threshold, F.lit(OVERFLOW_THRESHOLD))
    )
    return (
        F.when(~is_valid_range(raw, low, high), F.lit(QUALITY["Bad"]))
        .when(~is_valid_rate(rate, rate_limit), F.lit(QUALITY["Uncertain"]))
        .when(overflows, F.lit(QUALITY["Overflow"]))
        .otherwise(F.lit(QUALITY["Good"]))
    )


def grade_quality_custom(raw: Column, rate: Column, name: Column) -> Column:
    """Example of a business grade: production limits by channel name and a flat rate limit."""
    return (
        F.when(raw < 0, F.lit(QUALITY["Bad"]))
        .when(name.contains("Production") & (raw > 1000000), F.lit(QUALITY["Uncertain"]))
        .when(F.abs(rate) > 1000, F.lit(QUALITY["Uncertain"]))
        .otherwise(F.lit(QUALITY["Good"]))
    )
