"""The two pipelines from stored polls to readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countermill.functions.quality import near_overflow, quality_name
from countermill.functions.registers import block_counter, decode_failure, decode_registers
from countermill.operators.filters import drop_unread, enabled_channels, successful_polls
from countermill.operators.hooks import Rules
from countermill.operators.joins import SERIES, join_channel_config
from countermill.operators.rates import counter_rate, counter_rate_open
from countermill.vocab import NEAR_OVERFLOW, OPEN_RATE_WINDOW_SECONDS, QUALITY, RATE_WINDOW_SECONDS


def with_micros(polls: DataFrame) -> DataFrame:
    """Add `us`, the poll time in microseconds, as the order and arithmetic of windows need it."""
    return polls if "us" in polls.columns else polls.withColumn("us", F.unix_micros("ts"))


def decode_polls(polls: DataFrame, channels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Successful polls of enabled channels with raw and processed value, or why there is none.

    The join brings only the numeric settings: names and tag maps would make the shuffle of the
    rate window several times wider and are joined after it.
    """
    columns = list(dict.fromkeys((*rules.transformer_columns, *rules.validator_columns)))
    joined = join_channel_config(successful_polls(with_micros(polls)), channels, [*columns, "unit"])
    decoded = joined.withColumn("error_message", decode_failure(F.col("registers"))).withColumn(
        "raw_value", F.when(F.col("error_message").isNull(), decode_registers(F.col("registers")))
    )
    return decoded.withColumn(
        "processed_value", F.when(F.col("raw_value").isNotNull(), rules.transformer(F.col))
    ).drop("registers", "success", "error")


def error_reading(decoded: DataFrame) -> DataFrame:
    """Polls that could not be decoded, as readings: raw 0, no value or rate, configuration error."""
    return decoded.filter(F.col("error_message").isNotNull()).select(
        "device_id",
        "channel",
        "seq",
        "us",
        F.lit(0).cast("bigint").alias("raw_value"),
        F.lit(None).cast("double").alias("processed_value"),
        F.lit(None).cast("double").alias("rate"),
        F.lit(QUALITY["ConfigurationError"]).alias("quality"),
        "unit",
        "acquisition_us",
        "error_message",
    )


def grade_readings(rated: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Quality of rated rows, with the error form for those that could not be decoded."""
    failed = F.col("error_message").isNotNull()
    graded = rated.withColumn(
        "quality", F.when(failed, F.lit(QUALITY["ConfigurationError"])).otherwise(rules.validator(F.col))
    )
    return graded.select(
        "device_id",
        "channel",
        "seq",
        F.timestamp_micros("us").alias("ts"),
        "us",
        F.when(failed, F.lit(0).cast("bigint")).otherwise(F.col("raw_value")).alias("raw_value"),
        "processed_value",
        "rate",
        "quality",
        quality_name(F.col("quality")).alias("quality_name"),
        "unit",
        "acquisition_us",
        "error_message",
    )


def tag_readings(readings: DataFrame, channels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Attach the tag map of the enabled channel; error readings carry none."""
    tagged = enabled_channels(channels).select(*SERIES, rules.tagger(F.col).alias("_tags"))
    empty = F.create_map().cast("map<string,string>")
    joined = readings.join(tagged, SERIES, "left")
    return joined.withColumn("tags", F.when(F.col("error_message").isNull(), F.col("_tags")).otherwise(empty)).drop(
        "_tags"
    )


def process_readings(
    polls: DataFrame,
    channels: DataFrame,
    rules: Rules = Rules(),
    window_seconds: int = RATE_WINDOW_SECONDS,
    with_tags: bool = True,
    slice_seconds: int | None = None,
) -> DataFrame:
    """Stored polls to readings: join, decode, transform, rate, grade, tags.

    One shuffle of the polls, on (device, channel, time slice), for the rate.
    """
    decoded = decode_polls(polls, channels, rules)
    rated = counter_rate(
        decoded, window_seconds, gate=F.col("processed_value").isNotNull(), slice_seconds=slice_seconds
    )
    graded = grade_readings(rated, rules)
    return tag_readings(graded, channels, rules) if with_tags else graded


def validate_value(rows: DataFrame, channels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Grade (device, channel, raw_value, rate) rows that are no readings yet."""
    joined = join_channel_config(rows, channels, list(rules.validator_columns))
    return joined.withColumn("quality", rules.validator(F.col)).drop(*rules.validator_columns)


def decode_register_block(blocks: DataFrame, channels: list[int] | Column) -> DataFrame:
    """One row per (device cycle, channel) of a block read; the count is NULL past the block's end."""
    listed = channels if isinstance(channels, Column) else F.array(*[F.lit(c) for c in channels])
    exploded = blocks.withColumn("channel", F.explode(listed))
    return exploded.withColumn("count", block_counter(F.col("registers"), F.col("channel"))).drop("registers")


def read_and_log(
    blocks: DataFrame,
    channels: list[int] | Column = (0, 1),
    window_seconds: int = OPEN_RATE_WINDOW_SECONDS,
    overflow_threshold: int = NEAR_OVERFLOW,
    calculate_rate: bool = True,
) -> DataFrame:
    """The script pipeline: block decode, unread channels dropped, open rate, overflow flag."""
    listed = channels if isinstance(channels, Column) else list(channels)
    counts = drop_unread(decode_register_block(with_micros(blocks), listed))
    if calculate_rate:
        counts = counter_rate_open(counts, window_seconds, value="count")
    else:
        counts = counts.withColumn("rate", F.lit(None).cast("double"))
    return counts.withColumn("near_overflow", near_overflow(F.col("count"), overflow_threshold))


def read_and_log_fleet(blocks: DataFrame, settings: DataFrame) -> DataFrame:
    """The script pipeline for a fleet whose devices have settings of their own.

    `settings` has a row per device: `channels` (array), `rate_window` in seconds, `overflow_threshold` and
    `calculate_rate`. Blocks of other devices are left out. All windows, whatever their number, are answered
    by one sort; where no rate is wanted, rows are kept with a NULL one and stay out of the work on it.
    """
    wanted = settings.select("device_id", "channels", "rate_window", "overflow_threshold", "calculate_rate")
    joined = with_micros(blocks).join(wanted, "device_id")
    counts = drop_unread(decode_register_block(joined, F.col("channels")).drop("channels"))
    rated = counter_rate_open(
        counts, F.col("rate_window"), value="count", gate=F.col("calculate_rate") & F.col("rate_window").isNotNull()
    )
    flagged = rated.withColumn("near_overflow", F.col("count") > F.col("overflow_threshold"))
    return flagged.drop("rate_window", "overflow_threshold", "calculate_rate")
