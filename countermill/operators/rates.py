"""Sliding counter rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countermill.operators.slices import with_oldest
from countermill.vocab import OPEN_RATE_WINDOW_SECONDS, RATE_WINDOW_SECONDS, SECOND_US, UINT32_MAX

SERIES = ["device_id", "channel"]


def rate_between(old_us: Column, old: Column, new_us: Column, new: Column, wrap: str | None) -> Column:
    """Counts per second between two points; NULL unless time advances.

    A drop counts as a wrap: `compat` adds 2^32 - 1 as the original pipeline does, `exact` adds
    2^32, and None leaves the drop negative.
    """
    change = new - old
    if wrap is not None:
        turn = {"compat": UINT32_MAX, "exact": UINT32_MAX + 1}[wrap]
        change = F.when(change < 0, change + F.lit(turn)).otherwise(change)
    elapsed = new_us - old_us
    return F.when(elapsed > 0, change / (F.when(elapsed > 0, elapsed) / F.lit(float(SECOND_US))))


def counter_rate(
    df: DataFrame,
    window_seconds: int | Column = RATE_WINDOW_SECONDS,
    inclusive: bool = True,
    wrap: str | None = "compat",
    gate: Column | None = None,
    value: str = "raw_value",
    keys: list[str] = SERIES,
    slice_seconds: int | None = None,
) -> DataFrame:
    """Add `rate`: from the oldest point within the window to each row, per device and channel.

    Input carries `us` and `seq`; order is event time, then arrival. Rows whose `gate` is false
    stay out of the history and have no rate. `window_seconds` may be a column, so that every series has
    the window of its own settings.
    """
    slice_us = slice_seconds * SECOND_US if slice_seconds else None
    own = isinstance(window_seconds, Column)
    window_us = window_seconds.cast("bigint") * F.lit(SECOND_US) if own else window_seconds * SECOND_US
    found = with_oldest(
        df, keys, value, window_us, inclusive=inclusive, gate=gate, slice_us=slice_us
    )
    old = F.col("oldest")
    return found.withColumn("rate", rate_between(old["us"], old["value"], F.col("us"), F.col(value), wrap)).drop("oldest")


def counter_rate_open(df: DataFrame, window_seconds: int | Column = OPEN_RATE_WINDOW_SECONDS, **options) -> DataFrame:
    """The script variant: the lower bound is exclusive and drops stay negative."""
    return counter_rate(df, window_seconds, inclusive=False, wrap=None, **options)


def counter_rate_plain(df: DataFrame, window_seconds: int = RATE_WINDOW_SECONDS, **options) -> DataFrame:
    """Inclusive window without wrap correction."""
    return counter_rate(df, window_seconds, wrap=None, **options)


def rate_gate(df: DataFrame, processed: str = "processed_value", **options) -> DataFrame:
    """Rates over rows with a processed value only; other rows are kept with a NULL rate."""
    return counter_rate(df, gate=F.col(processed).isNotNull(), **options)
