"""Scaling, offset and rounding of counter values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, decimals: Column) -> Column:
    """Round to a per-row number of places, ties to even; adding 0.0 turns -0.0 into 0.0."""
    unit = F.pow(F.lit(10.0), decimals.cast("double"))
    return F.rint(value * unit) / unit + F.lit(0.0)


def transform_value(raw: Column, scale: Column, offset: Column, decimals: Column) -> Column:
    return round_half_even(raw * scale + offset, decimals)


def transform_temperature(
    raw: Column, scale: Column, offset: Column, decimals: Column, name: Column, tags: Column
) -> Column:
    """Like transform_value, but temperature channels tagged as fahrenheit are converted first."""
    value = raw * scale + offset
    fahrenheit = name.contains("Temperature") & (F.try_element_at(tags, F.lit("unit")) == "fahrenheit")
    converted = F.when(F.coalesce(fahrenheit, F.lit(False)), value * 9.0 / 5.0 + 32.0).otherwise(value)
    return round_half_even(converted, F.coalesce(decimals, F.lit(2)))
