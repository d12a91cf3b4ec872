"""Shapes and writers of published readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countermill.operators.filters import good_readings
from countermill.vocab import AUDIT_SOURCE, POINT_MEASUREMENT, TOPIC_PREFIX


def utc_time(us: Column) -> Column:
    """The second of a time in UTC, as a time without zone: the same in a session of any zone."""
    seconds = ((us - F.pmod(us, F.lit(1000000))) / 1000000).cast("decimal(18,6)")
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def iso_time(us: Column, trim: bool = False) -> Column:
    """ISO text in UTC; the fraction appears only when there is one, with or without end zeros."""
    whole = F.translate(utc_time(us).cast("string"), " ", "T")
    digits = F.concat(F.lit("."), F.lpad(F.pmod(us, F.lit(1000000)).cast("string"), 6, "0"))
    fraction = F.regexp_replace(digits, "0+$", "") if trim else digits
    return F.concat(whole, F.when(us % 1000000 != 0, fraction).otherwise(F.lit("")), F.lit("+00:00"))


def to_points(readings: DataFrame, device: Column, location: Column, count: str = "count") -> DataFrame:
    """Time-series points: measurement, tags, time and fields; a missing rate leaves no field."""
    point = F.struct(
        F.lit(POINT_MEASUREMENT).alias("measurement"),
        F.struct(
            device.alias("device"), location.alias("location"), F.col("channel").cast("string").alias("channel")
        ).alias("tags"),
        iso_time(F.col("us")).alias("time"),
        F.struct(F.col(count).alias("count"), F.col("rate").alias("rate")).alias("fields"),
    )
    return readings.select(point.alias("p"), "us").select("p.*", "us")


def point_json(points: DataFrame) -> DataFrame:
    """Points as JSON text; to_json leaves NULL fields out."""
    return points.select(F.to_json(F.struct("measurement", "tags", "time", "fields")).alias("value"))


def write_points(points: DataFrame, path: str, mode: str = "append", partition_by: tuple[str, ...] = ("date",)) -> None:
    """Points as files, in folders per day by default.

    Ranges of (day, device, time) make few, sorted files per day that a reader can skip by
    device, and cut a busy device over several tasks. `partition_by` may name `device` as well
    where there are few of them.
    """
    dated = points.withColumns(
        {"device": F.col("tags.device"), "date": utc_time(F.col("us")).cast("date")}
    ).repartitionByRange("date", "device", "us")
    dated.sortWithinPartitions("date", "device", "us").write.mode(mode).partitionBy(*partition_by).parquet(path)


def to_messages(readings: DataFrame) -> DataFrame:
    """Message topic and JSON value per reading, ready for a key/value sink."""
    value = F.to_json(
        F.struct(
            F.col("device_id").alias("DeviceId"),
            F.col("channel").alias("Channel"),
            F.col("raw_value").alias("RawValue"),
            F.col("processed_value").alias("ProcessedValue"),
            iso_time(F.col("us"), trim=True).alias("Timestamp"),
            F.col("quality").alias("Quality"),
            F.col("rate").alias("Rate"),
        ),
        {"ignoreNullFields": "false"},
    )
    return readings.select(
        F.concat_ws(".", F.lit(TOPIC_PREFIX), "device_id", F.col("channel").cast("string")).alias("topic"),
        value.alias("value"),
    )


def audit_trail(readings: DataFrame, user_id: str | None, batch_id: str | None) -> DataFrame:
    """Good readings as audit entries."""
    return good_readings(readings).select(
        F.timestamp_micros("us").alias("Timestamp"),
        F.col("device_id").alias("DeviceId"),
        F.col("channel").alias("Channel"),
        F.col("processed_value").alias("Value"),
        F.lit(AUDIT_SOURCE).alias("Source"),
        F.lit(user_id).cast("string").alias("UserId"),
        F.lit(batch_id).cast("string").alias("BatchId"),
    )
