"""Row filters over polls, channels and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countermill.functions import quality as Q
from countermill.vocab import HIGH_RATE, NEAR_OVERFLOW, QUALITY


def enabled_channels(channels: DataFrame) -> DataFrame:
    return channels.filter(F.coalesce(F.col("enabled"), F.lit(True)))


def successful_polls(polls: DataFrame) -> DataFrame:
    """Polls that delivered registers; the others only touch device health."""
    return polls.filter(F.col("success") & F.col("registers").isNotNull())


def drop_unread(counts: DataFrame, count: str = "count") -> DataFrame:
    return counts.filter(F.col(count).isNotNull())


def failed_channels(counts: DataFrame, count: str = "count") -> DataFrame:
    return counts.filter(F.col(count).isNull())


def near_overflow(counts: DataFrame, count: str = "count", limit: int = NEAR_OVERFLOW) -> DataFrame:
    return counts.filter(Q.near_overflow(F.col(count), limit))


def good_readings(readings: DataFrame) -> DataFrame:
    return readings.filter(F.col("quality") == QUALITY["Good"])


def high_rate_alerts(readings: DataFrame, device_id: str | None = None, limit: float = HIGH_RATE) -> DataFrame:
    """Readings above a rate, of one device or of all."""
    hit = F.col("rate") > limit
    return readings.filter(hit if device_id is None else (F.col("device_id") == device_id) & hit)


def has_tag(readings: DataFrame, key: str) -> DataFrame:
    return readings.filter(F.map_contains_key("tags", key))
