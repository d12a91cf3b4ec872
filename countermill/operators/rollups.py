"""Windowed roll-ups; each works on a batch and on a stream of readings.

All of them are aggregates with map-side partial results, so a window or a line with very many
readings reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countermill.operators.slices import fill_forward
from countermill.vocab import CV_LIMIT

LATEST = ("us", "seq")


def late_data(rows: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Bound how long a stream waits for late rows; without effect on a batch."""
    return rows.withWatermark(ts, delay)


def window_columns(window: str = "window") -> list[Column]:
    return [F.col(window)["start"].alias("window_start"), F.col(window)["end"].alias("window_end")]


def tumbling_buffer(rows: DataFrame, length: str = "5 seconds", ts: str = "ts") -> DataFrame:
    """Put every row into its buffer: no shuffle, and no list of rows that could outgrow a task.

    Group by `window_start` to work on whole buffers; empty ones do not appear.
    """
    slot = F.window(ts, length)
    return rows.withColumn("_w", slot).select(
        *rows.columns, F.col("_w")["start"].alias("window_start"), F.col("_w")["end"].alias("window_end")
    )


def tumbling_window(
    rows: DataFrame, aggregates: list[Column], length: str = "1 hour", keys: list[str] | tuple = (), ts: str = "ts"
) -> DataFrame:
    """Aggregates per tumbling window and key."""
    grouped = rows.groupBy(F.window(ts, length), *keys).agg(*aggregates)
    rest = [c for c in grouped.columns if c != "window"]
    return grouped.select(*window_columns(), *rest)


def non_empty_batches(rows: DataFrame, length: str = "5 seconds", ts: str = "ts") -> DataFrame:
    """Buffers that hold at least one row, with their size."""
    return tumbling_window(rows, [F.count(F.lit(1)).alias("readings")], length, ts=ts)


def sample_latest(rows: DataFrame, length: str = "1 second", keys: list[str] | tuple = (), ts: str = "ts") -> DataFrame:
    """The last row of each interval, over the whole stream or per key."""
    values = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(F.window(ts, length), *keys).agg(
        F.max_by(F.struct(*values), F.struct(*LATEST)).alias("_r")
    )
    return latest.select(*window_columns(), *keys, "_r.*")


def group_stream(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Running totals per key, such as device or tag."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("readings"),
        F.max("us").alias("last_us"),
        F.max_by("raw_value", F.struct(*LATEST)).alias("last_raw"),
    )


def line_dashboard(readings: DataFrame, length: str = "10 seconds", tag: str = "line") -> DataFrame:
    """Per production line and interval: readings, latest value and mean rate."""
    lined = readings.filter(F.map_contains_key("tags", tag)).withColumn("line", F.try_element_at("tags", F.lit(tag)))
    return tumbling_window(
        lined,
        [
            F.count(F.lit(1)).alias("readings"),
            F.max_by("processed_value", F.struct(*LATEST)).alias("last_value"),
            F.round(F.avg("rate"), 6).alias("avg_rate"),
        ],
        length,
        ["line"],
    )


def line_health(health: DataFrame) -> DataFrame:
    """Latest health of each line; rows carry `line`."""
    return health.groupBy("line").agg(
        F.max_by(F.struct("device_id", "status", "us"), F.struct("us", "seq")).alias("_h"),
        F.count(F.lit(1)).alias("updates"),
    ).select("line", "_h.device_id", "_h.status", "_h.us", "updates")


def rate_variability(
    readings: DataFrame, length: str = "1 hour", limit: float = CV_LIMIT, keys: list[str] | tuple = ("device_id",)
) -> DataFrame:
    """Coefficient of variation of the rate per device and interval, with a flag above the limit.

    A missing rate counts as 0; without a mean there is no coefficient and no flag.
    """
    rate = F.coalesce("rate", F.lit(0.0))
    stats = tumbling_window(
        readings,
        [
            F.count(F.lit(1)).alias("readings"),
            F.stddev_pop(rate).alias("_spread"),
            F.avg(rate).alias("_mean"),
        ],
        length,
        list(keys),
    )
    cv = F.round(F.col("_spread") / F.when(F.col("_mean") != 0, F.col("_mean")), 6)
    return stats.select("window_start", "window_end", *keys, "readings", cv.alias("cv")).withColumn(
        "needs_inspection", F.coalesce(F.col("cv") > limit, F.lit(False))
    )


def throughput_latency(readings: DataFrame, length: str = "1 minute") -> DataFrame:
    """Readings and mean acquisition time per interval."""
    return tumbling_window(
        readings,
        [
            F.count(F.lit(1)).alias("readings"),
            F.round(F.avg(F.col("acquisition_us") / 1000.0), 6).alias("avg_latency_ms"),
        ],
        length,
    )


def quality_counts(readings: DataFrame) -> DataFrame:
    return readings.groupBy("device_id", "channel", "quality").agg(F.count(F.lit(1)).alias("readings"))


def cycle_overrun(polls: DataFrame, interval_ms: int, cycle: Column | None = None) -> DataFrame:
    """Poll cycles that take longer than the interval.

    Channels of a device are read in turn, devices side by side: a cycle lasts as long as its
    slowest device. `cycle` numbers the round of a poll, such as `slice_start(us, interval)` where every
    device takes its own clock; without it polls of one time are one round. It becomes `us`.
    """
    if cycle is not None:
        polls = polls.withColumn("us", cycle)
    per_device = polls.groupBy("us", "device_id").agg(F.sum("acquisition_us").alias("device_us"))
    cycles = per_device.groupBy("us").agg(F.max("device_us").alias("cycle_us"), F.count(F.lit(1)).alias("devices"))
    return cycles.filter(F.col("cycle_us") > F.lit(interval_ms * 1000))


def poll_gaps(polls: DataFrame, interval_ms: int, slice_us: int | None = None) -> DataFrame:
    """Readings that come later than the interval after the one before on their channel."""
    options = {} if slice_us is None else {"slice_us": slice_us}
    before = fill_forward(
        polls, ["device_id", "channel"], {"previous_us": F.col("us")}, inclusive=False, **options
    )
    gap = F.col("us") - F.col("previous_us")
    return before.withColumn("gap_us", gap).filter(gap > F.lit(interval_ms * 1000))


def order_by_time(readings: DataFrame) -> DataFrame:
    """All devices merged into one time order."""
    return readings.orderBy("us", "device_id", "channel", "seq")


def take_n(readings: DataFrame, n: int) -> DataFrame:
    """The first n readings in time."""
    return order_by_time(readings).limit(n)
