"""Polls and readings against the configuration tables.

No side is hinted: Spark broadcasts a dimension only when its size is below
`spark.sql.autoBroadcastJoinThreshold`, and otherwise shuffles, where adaptive execution splits
the partitions of a busy device.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countermill.operators.filters import enabled_channels, successful_polls

SERIES = ["device_id", "channel"]


def join_channel_config(polls: DataFrame, channels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each poll of an enabled channel with that channel's settings."""
    wanted = enabled_channels(channels)
    if columns is not None:
        wanted = wanted.select(*SERIES, *[c for c in columns if c not in SERIES])
    return polls.join(wanted, SERIES, "inner")


def join_device_tags(readings: DataFrame, devices: DataFrame) -> DataFrame:
    """Readings with the tags of their device as `device_tags`; unknown devices keep their readings."""
    return readings.join(devices.select("device_id", F.col("tags").alias("device_tags")), "device_id", "left")


def join_line(rows: DataFrame, lines: DataFrame, tag: str = "line") -> DataFrame:
    """Production line of each row: its own tag when it has tags, else the (device_id, line) mapping."""
    mapped = rows.join(lines.select("device_id", F.col("line").alias("_line")), "device_id", "left")
    own = F.try_element_at("tags", F.lit(tag)) if "tags" in rows.columns else F.lit(None).cast("string")
    return mapped.withColumn("line", F.coalesce(own, F.col("_line"))).drop("_line")


def version_runs(versions: DataFrame, keys: list[str], valid_from: str, run: int) -> DataFrame:
    """The versions of a key as runs of at most `run`, each an array in order of time, with the time from
    which the run holds and the one at which the next begins (NULL for the last). Of versions that start at
    the same time the greatest settings hold."""
    settings = [c for c in versions.columns if c not in keys and c != valid_from]
    in_time = Window.partitionBy(*keys).orderBy(*map(F.col, (valid_from, *settings)))
    numbered = versions.filter(F.col(valid_from).isNotNull()).select(
        *keys,
        F.struct(valid_from, *settings).alias("version"),
        F.floor((F.row_number().over(in_time) - 1) / run).alias("run"),
    )
    runs = numbered.groupBy(*keys, "run").agg(F.array_sort(F.collect_list("version")).alias("versions"))
    start = F.col("versions")[0][valid_from]
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy("run"))
    return runs.select(*[F.col(k).alias(f"_{k}") for k in keys], start.alias("_start"), following.alias("_next"), "versions")


def config_as_of(
    readings: DataFrame,
    versions: DataFrame,
    keys: list[str] = ["device_id"],
    valid_from: str = "valid_from_us",
    run: int = 16,
) -> DataFrame:
    """Add `config`: the settings in force at each reading; a version holds from its start, inclusive.

    Versions are a small side: a key has one row with its versions in time order, or, beyond `run`
    versions, one row per run of them. A reading meets the one row that holds at its time and looks its
    version up there, so readings are neither sorted nor put together with versions they do not need.
    Readings before the first version, without a time or of a key without versions have a NULL config.
    """
    runs = version_runs(versions, keys, valid_from, run)
    meets = (F.col("us") >= F.col("_start")) & (F.col("_next").isNull() | (F.col("us") < F.col("_next")))
    for k in keys:
        meets = F.col(k).eqNullSafe(F.col(f"_{k}")) & meets
    started = F.filter("versions", lambda v: v[valid_from] <= F.col("us"))
    return readings.join(runs, meets, "left").select(*readings.columns, F.try_element_at(started, F.lit(-1)).alias("config"))


def unread_channels(polls: DataFrame, channels: DataFrame) -> DataFrame:
    """Enabled channels of a polled device without a successful read in that device's cycle."""
    cycles = polls.groupBy("device_id", "us").agg(F.count(F.lit(1)).alias("polls"))
    expected = cycles.join(enabled_channels(channels).select("device_id", "channel"), "device_id").drop("polls")
    return expected.join(successful_polls(polls), ["device_id", "us", "channel"], "left_anti")


def known_devices(events: DataFrame, devices: DataFrame) -> DataFrame:
    """Events of configured devices; all others are ignored."""
    return events.join(devices.select("device_id"), "device_id", "left_semi")
