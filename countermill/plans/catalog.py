"""One runnable query per operator over the test tables; `oracle.py` holds the same in SQL.

Times are compared as microseconds and maps as text. The event log is sparse, so rates use a
window of a day here; the default windows are covered by the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countermill.functions import health as H
from countermill.functions import quality as Q
from countermill.functions import registers as R
from countermill.functions import scaling as S
from countermill.functions import tags as G
from countermill.operators import config_rules, filters, health, hooks, joins, rates, readings, rollups
from countermill.operators.slices import slice_start
from countermill.plans import bindings as B
from countermill.session import work_folder
from countermill.sources import device_config, polls, sinks
from countermill.streaming.health import stream_health as run_stream_health
from countermill.streaming.delivery import batch_writer, closed_windows, committed, replay, write_windows
from countermill.streaming.delivery import fan_out as run_fan_out
from countermill.streaming.delivery import late_rows as read_late_rows
from countermill.streaming.delivery import stream_process as run_stream_process
from countermill.streaming.rates import stream_rate as run_stream_rate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DAY = 86400


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- shared inputs


def _polls(spark, sf):
    return B.event_polls(spark, sf)


def _decoded(spark, sf):
    """Successful polls with raw value and all settings of their channel."""
    polls = filters.successful_polls(_polls(spark, sf)).withColumn("raw_value", R.decode_registers(F.col("registers")))
    return joins.join_channel_config(polls, B.fleet_channels(spark, sf))


def _readings(spark, sf, with_tags=False):
    return readings.process_readings(
        _polls(spark, sf), B.fleet_channels(spark, sf), window_seconds=DAY, with_tags=with_tags
    )


def _probes(spark, sf):
    """A connection probe half a minute after each purchase event."""
    events = spark.read.schema(B.EVENTS_SCHEMA).parquet(f"{sf}/events.parquet")
    return events.filter(F.col("event_type") == "purchase").select(
        F.concat(F.lit("DEV_"), F.col("user_id")).alias("device_id"),
        (B._us("ts") + 30000000).alias("us"),
        (F.col("event_id") + 1000000000).alias("seq"),
        (F.col("value") > 20).alias("success"),
        F.lit(None).cast("string").alias("error"),
    )


def _health(spark, sf):
    events = health.health_events(_polls(spark, sf), _probes(spark, sf))
    return health.health_history(events, start_us=B.START_US)


def _read_health(spark, sf):
    return health.health_history(health.health_events(_polls(spark, sf)), start_us=B.START_US)


def _numbered(spark, sf):
    """Plain counters of the event polls, for the rate variants."""
    polls = filters.successful_polls(_polls(spark, sf))
    return polls.select(
        "device_id", "channel", "us", "seq", R.decode_registers(F.col("registers")).alias("raw_value")
    ).filter(F.col("raw_value").isNotNull())


RATE_COLUMNS = ["device_id", "channel", "us", "seq", "raw_value", "rate"]
READING_COLUMNS = [
    "device_id",
    "channel",
    "seq",
    "us",
    "raw_value",
    "processed_value",
    "rate",
    "quality",
    "quality_name",
    "unit",
    "acquisition_us",
    "error_message",
]
HEALTH_COLUMNS = [
    "device_id",
    "us",
    "seq",
    "kind",
    "status",
    "status_name",
    "is_connected",
    "last_successful_read_us",
    "consecutive_failures",
    "last_error",
    "total_reads",
    "successful_reads",
    "success_rate",
]


def _violations(found: DataFrame) -> DataFrame:
    return found.withColumn("members", F.array_join("members", ","))


def _micros(df: DataFrame) -> DataFrame:
    """Window bounds as microseconds."""
    return df.withColumn("window_start", F.unix_micros("window_start")).withColumn(
        "window_end", F.unix_micros("window_end")
    )


# ---------------------------------------------------------------- sources and sinks


@query
def read_register_log(spark, sf):
    return _polls(spark, sf).select(
        "device_id",
        "channel",
        F.array_join("registers", ",").alias("registers"),
        "us",
        "success",
        "acquisition_us",
        "error",
        "seq",
    )


@query
def rejected_polls(spark, sf):
    """Polls from JSON lines, and the lines that are none, by their number where it can be read."""
    found = polls.judged_register_log(spark, B.faulty_poll_files(spark, sf), "json")
    number = F.get_json_object("record", "$.seq").cast("bigint")
    kept = polls.accepted(found).select(F.lit("").alias("reason"), "seq", "us")
    return kept.unionByName(
        polls.rejected(found).select("reason", F.when(F.col("reason") != "corrupt_record", number).alias("seq")),
        allowMissingColumns=True,
    )


@query
def rejected_events(spark, sf):
    """Health events of which some have no time: those that are folded, and those that cannot be."""
    events = B.lifecycle_log(spark, sf).withColumn("us", F.when(F.col("seq") % 61 != 4, F.col("us")))
    folded = health.health_epochs(events, start_us=B.START_US).select("device_id", "us", "seq", F.lit("").alias("reason"))
    return folded.unionByName(health.rejected_events(events).select("device_id", "us", "seq", "reason"))


@query
def stream_register_log(spark, sf):
    stream = B.event_polls_stream(spark, sf).select(
        "device_id", "channel", "us", "success", "acquisition_us", "error", "seq"
    )
    return replay(stream, work_folder(spark, "stream-log"))


@query
def load_device_config(spark, sf):
    """Documents as files of lines; one that is no JSON has no rows, a mistyped setting has its default."""
    devices, channels = device_config.load_device_config(spark, B.config_files(spark, sf), lines=True)
    return devices.withColumn("location", F.try_element_at("tags", F.lit("location"))).select(
        "fleet_id", "device_id", "ip_address", "port", "unit_id", "timeout_ms", "location"
    ).join(
        channels.select(
            "device_id",
            "channel",
            "name",
            "scale_factor",
            "unit",
            "register_count",
            "enabled",
            "max_value",
            "overflow_threshold",
            "overflow_check",
        ),
        "device_id",
    )


@query
def document_findings(spark, sf):
    """Documents that are no JSON, and settings that do not have their type."""
    found = device_config.document_findings(spark, B.config_files(spark, sf), lines=True)
    named = F.when(F.col("rule") != "malformed_document", F.col("fleet_id"))
    return _violations(found).withColumn("fleet_id", named)


@query
def apply_config_defaults(spark, sf):
    merged = device_config.apply_config_defaults(B.script_configs(spark, sf), device_config.SCRIPT_DEFAULTS)
    return merged.select(
        "device_id",
        "modbus.host",
        F.col("modbus.retries").cast("bigint").alias("retries"),
        "modbus.port",
        F.array_join(F.col("counters.channels"), ",").alias("channels"),
        F.col("counters.rate_window").cast("bigint").alias("rate_window"),
        "counters.overflow_threshold",
        "influxdb.database",
        "logging.poll_interval",
        F.col("device.location").alias("location"),
    )


@query
def legacy_channel_list(spark, sf):
    merged = device_config.apply_config_defaults(B.script_configs(spark, sf), device_config.SCRIPT_DEFAULTS)
    return device_config.legacy_channel_list(merged.select("device_id", F.col("counters.channels").alias("channels")))


def _points(spark, sf):
    counts = readings.read_and_log(B.event_blocks(spark, sf), [0, 1, 2, 3], window_seconds=DAY)
    located = counts.join(B.fleet_devices(spark, sf).select("device_id", "location"), "device_id", "left")
    return sinks.to_points(located, F.col("device_id"), F.col("location"))


def _flat_points(points: DataFrame) -> DataFrame:
    return points.select(
        "measurement",
        F.col("tags.device").alias("device"),
        F.col("tags.location").alias("location"),
        F.col("tags.channel").alias("channel"),
        "time",
        F.col("fields.count").alias("count"),
        F.col("fields.rate").alias("rate"),
    )


@query
def to_points(spark, sf):
    return _flat_points(_points(spark, sf))


@query
def write_points(spark, sf):
    folder = work_folder(spark, "points")
    sinks.write_points(_points(spark, sf), f"{folder}/points")
    return _flat_points(spark.read.parquet(f"{folder}/points"))


@query
def to_messages(spark, sf):
    value = F.from_json(
        "value",
        "DeviceId string, Channel int, RawValue bigint, ProcessedValue double, Timestamp string, Quality int, Rate double",
    )
    return sinks.to_messages(_readings(spark, sf)).withColumn("v", value).select("topic", "v.*")


@query
def audit_trail(spark, sf):
    trail = sinks.audit_trail(_readings(spark, sf), "operator", "batch-1")
    return trail.withColumn("Timestamp", F.unix_micros("Timestamp"))


# ---------------------------------------------------------------- scalar functions


@query
def decode_registers(spark, sf):
    return _polls(spark, sf).select(
        "device_id", "seq", F.size("registers").alias("words"), R.decode_registers(F.col("registers")).alias("raw_value")
    )


@query
def decode_register_block(spark, sf):
    return readings.decode_register_block(B.event_blocks(spark, sf), [0, 1, 2, 3])


@query
def transform_value(spark, sf):
    c = F.col
    value = S.transform_value(c("raw_value"), c("scale_factor"), c("offset"), c("decimal_places"))
    return _decoded(spark, sf).select("device_id", "channel", "seq", "raw_value", value.alias("processed_value"))


@query
def transform_temperature(spark, sf):
    c = F.col
    value = S.transform_temperature(
        c("raw_value"), c("scale_factor"), c("offset"), c("decimal_places"), c("name"), c("tags")
    )
    return _decoded(spark, sf).select("device_id", "channel", "seq", value.alias("processed_value"))


def _tag_call(device_tags=None):
    c = F.col
    return G.enrich_tags(
        c("tags"),
        c("name"),
        c("description"),
        c("start_register"),
        c("register_count"),
        c("scale_factor"),
        c("offset"),
        device_tags,
    )


@query
def enrich_tags(spark, sf):
    rows = _decoded(spark, sf)
    devices = B.fleet_devices(spark, sf).select("device_id", F.col("tags").alias("device_tags"))
    joined = rows.join(devices, "device_id", "left")
    return joined.select("device_id", "seq", G.tags_text(_tag_call(F.col("device_tags"))).alias("tags"))


@query
def enrich_tags_compat(spark, sf):
    return _decoded(spark, sf).select("device_id", "seq", G.tags_text(_tag_call()).alias("tags"))


@query
def shift_tag(spark, sf):
    rows = joins.join_device_tags(_polls(spark, sf), B.fleet_devices(spark, sf))
    none = F.lit(None).cast("map<string,string>")
    tags = G.shift_tag(none, F.col("device_tags"), F.timestamp_micros("us"), zone="Asia/Tokyo")
    return rows.select("device_id", "seq", G.tags_text(tags).alias("tags"))


@query
def error_reading(spark, sf):
    decoded = readings.decode_polls(_polls(spark, sf), B.fleet_channels(spark, sf))
    return readings.error_reading(decoded)


@query
def quality_name(spark, sf):
    rows = _readings(spark, sf)
    return rows.groupBy("quality").agg(F.count(F.lit(1)).alias("readings")).select(
        "quality", Q.quality_name(F.col("quality")).alias("name"), "readings"
    )


@query
def status_name(spark, sf):
    rows = _health(spark, sf)
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("updates")).select(
        "status", Q.status_name(F.col("status")).alias("name"), "updates"
    )


@query
def success_rate(spark, sf):
    counts = _polls(spark, sf).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("ok")
    )
    return counts.withColumn("success_rate", H.success_rate(F.col("total"), F.col("ok")))


@query
def health_score(spark, sf):
    latest = health.latest_per_device(_health(spark, sf))
    score = H.health_score(F.col("total_reads"), F.col("successful_reads"), F.col("consecutive_failures"))
    return latest.select("device_id", F.round(score, 6).alias("health_score"))


# ---------------------------------------------------------------- filters


@query
def enabled_channels(spark, sf):
    return filters.enabled_channels(B.fleet_channels(spark, sf)).select("device_id", "channel", "name")


@query
def successful_polls(spark, sf):
    return filters.successful_polls(_polls(spark, sf)).select("device_id", "channel", "us", "seq")


@query
def drop_unread(spark, sf):
    return filters.drop_unread(readings.decode_register_block(B.event_blocks(spark, sf), [0, 1, 2, 3]))


@query
def failed_channels(spark, sf):
    blocks = readings.decode_register_block(B.event_blocks(spark, sf), [0, 1, 2, 3])
    return filters.failed_channels(blocks).select("device_id", "channel", "us", "seq")


@query
def near_overflow(spark, sf):
    blocks = readings.decode_register_block(B.event_blocks(spark, sf), [0, 1, 2, 3])
    return filters.near_overflow(blocks, limit=4200000000)


@query
def is_valid_range(spark, sf):
    c = F.col
    ok = Q.is_valid_range(c("raw_value"), c("min_value"), c("max_value"))
    return _decoded(spark, sf).filter(c("raw_value").isNotNull()).select("device_id", "seq", ok.alias("valid"))


@query
def is_valid_range_strict(spark, sf):
    c = F.col
    ok = Q.is_valid_range_strict(c("raw_value"), c("min_value"), c("max_value"))
    return _decoded(spark, sf).filter(c("raw_value").isNotNull()).select("device_id", "seq", ok.alias("valid"))


def _rated_channels(spark, sf):
    limits = B.fleet_channels(spark, sf).select("device_id", "channel", "name", "max_rate_of_change")
    return rates.counter_rate(_numbered(spark, sf), DAY).join(limits, ["device_id", "channel"])


@query
def is_valid_rate(spark, sf):
    ok = Q.is_valid_rate(F.col("rate"), F.col("max_rate_of_change"))
    return _rated_channels(spark, sf).select("device_id", "seq", "rate", ok.alias("valid"))


@query
def is_valid_rate_by_name(spark, sf):
    ok = Q.is_valid_rate_by_name(F.col("rate"), F.col("name"))
    return _rated_channels(spark, sf).select("device_id", "seq", "rate", ok.alias("valid"))


@query
def good_readings(spark, sf):
    return filters.good_readings(_readings(spark, sf)).select(*READING_COLUMNS)


@query
def high_rate_alerts(spark, sf):
    return filters.high_rate_alerts(_readings(spark, sf), limit=10100).select(
        "device_id", "channel", "seq", "us", "rate"
    )


@query
def has_tag(spark, sf):
    tagged = filters.has_tag(_readings(spark, sf, with_tags=True), "line")
    return tagged.select("device_id", "seq", F.try_element_at("tags", F.lit("line")).alias("line"))


@query
def non_empty_batches(spark, sf):
    return _micros(rollups.non_empty_batches(_polls(spark, sf), "5 seconds"))


# ---------------------------------------------------------------- grading


@query
def grade_quality(spark, sf):
    rows = rates.counter_rate(_numbered(spark, sf), DAY)
    return readings.validate_value(rows, B.fleet_channels(spark, sf)).select(*RATE_COLUMNS, "quality")


@query
def overflow_threshold(spark, sf):
    _, channels = device_config.load_device_config(spark, B.config_files(spark, sf), lines=True)
    return channels.select("device_id", "channel", "overflow_threshold", "overflow_check")


@query
def grade_quality_custom(spark, sf):
    grade = Q.grade_quality_custom(F.col("raw_value"), F.col("rate"), F.col("name"))
    return _rated_channels(spark, sf).select("device_id", "seq", grade.alias("quality"))


@query
def validate_value(spark, sf):
    """Grades of line values against the channel limits, without any reading."""
    items = B.lineitem_polls(spark, sf)
    limits = B.supplier_channels(spark, sf).withColumns(
        {
            "min_value": F.lit(200000).cast("bigint"),
            "max_value": F.when(F.col("channel") != 3, F.lit(9000000)).cast("bigint"),
            "max_rate_of_change": F.lit(40.0),
            "overflow_threshold": F.lit(8000000).cast("bigint"),
            "overflow_check": F.col("channel") != 5,
        }
    )
    values = filters.successful_polls(items).select(
        "device_id",
        "channel",
        "seq",
        R.decode_registers(F.col("registers")).alias("raw_value"),
        (F.col("acquisition_us") / 1000.0).alias("rate"),
    )
    graded = readings.validate_value(values, limits)
    return graded.groupBy("device_id", "channel", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum("raw_value").alias("total"))


# ---------------------------------------------------------------- joins


@query
def join_channel_config(spark, sf):
    joined = joins.join_channel_config(_polls(spark, sf), B.fleet_channels(spark, sf), ["name", "unit"])
    return joined.select("device_id", "channel", "seq", "name", "unit")


@query
def join_device_tags(spark, sf):
    joined = joins.join_device_tags(_polls(spark, sf), B.fleet_devices(spark, sf))
    return joined.select("device_id", "seq", G.tags_text(F.col("device_tags")).alias("device_tags"))


@query
def join_line(spark, sf):
    rows = _readings(spark, sf, with_tags=True).select("device_id", "seq", "tags")
    return joins.join_line(rows, B.device_lines(spark, sf)).select("device_id", "seq", "line")


@query
def config_as_of(spark, sf):
    found = joins.config_as_of(_polls(spark, sf).drop("ts"), B.config_versions(spark, sf))
    return found.select(
        "device_id", "seq", F.col("config.version").alias("version"), F.col("config.scale_factor").alias("scale_factor")
    )


@query
def unread_channels(spark, sf):
    return joins.unread_channels(B.lineitem_polls(spark, sf), B.supplier_channels(spark, sf))


@query
def known_devices(spark, sf):
    lined = B.device_lines(spark, sf)
    return joins.known_devices(_polls(spark, sf), lined).select("device_id", "seq", "us")


# ---------------------------------------------------------------- windows


@query
def counter_rate(spark, sf):
    return rates.counter_rate(_numbered(spark, sf), DAY).select(*RATE_COLUMNS)


@query
def counter_rate_open(spark, sf):
    return rates.counter_rate_open(_numbered(spark, sf), DAY).select(*RATE_COLUMNS)


@query
def counter_rate_plain(spark, sf):
    return rates.counter_rate_plain(_numbered(spark, sf), DAY).select(*RATE_COLUMNS)


@query
def rate_gate(spark, sf):
    """Values outside the channel range become NULL and stay out of the history."""
    c = F.col
    rows = _decoded(spark, sf).withColumn(
        "processed_value", F.when(Q.is_valid_range(c("raw_value"), c("min_value"), c("max_value")), c("raw_value") * 1.0)
    )
    narrow = rows.select("device_id", "channel", "us", "seq", "raw_value", "processed_value")
    return rates.rate_gate(narrow, window_seconds=DAY).select("device_id", "channel", "seq", "processed_value", "rate")


@query
def health_history(spark, sf):
    return _health(spark, sf).select(*HEALTH_COLUMNS)


@query
def last_successful_read(spark, sf):
    events = health.health_events(_polls(spark, sf), _probes(spark, sf))
    return health.last_successful_read(events, B.START_US)


@query
def health_epochs(spark, sf):
    epochs = health.health_epochs(B.lifecycle_log(spark, sf), start_us=B.START_US)
    return epochs.select(*HEALTH_COLUMNS)


@query
def cycle_overrun(spark, sf):
    """Rounds of a week, in which every device takes its polls by its own clock."""
    weeks = slice_start(F.col("us"), 7 * DAY * 1000000)
    return rollups.cycle_overrun(B.lineitem_polls(spark, sf), 600, weeks)


@query
def cycle_overrun_shared(spark, sf):
    """Polls of one time are one round."""
    return rollups.cycle_overrun(B.lineitem_polls(spark, sf), 120)


@query
def poll_gaps(spark, sf):
    gaps = rollups.poll_gaps(B.lineitem_polls(spark, sf), 30 * 86400 * 1000)
    return gaps.select("device_id", "channel", "us", "seq", "previous_us", "gap_us")


# ---------------------------------------------------------------- aggregates


@query
def service_health(spark, sf):
    return health.service_health(health.latest_per_device(_health(spark, sf)))


@query
def device_health_summary(spark, sf):
    return health.device_health_summary(_health(spark, sf)).withColumn("health_score", F.round("health_score", 6))


@query
def line_dashboard(spark, sf):
    return _micros(rollups.line_dashboard(_readings(spark, sf, with_tags=True)))


@query
def line_health(spark, sf):
    lined = joins.join_line(_health(spark, sf), B.device_lines(spark, sf))
    return rollups.line_health(lined.filter(F.col("line").isNotNull()))


@query
def rate_variability(spark, sf):
    return _micros(rollups.rate_variability(filters.good_readings(_readings(spark, sf))))


@query
def throughput_latency(spark, sf):
    return _micros(rollups.throughput_latency(filters.successful_polls(_polls(spark, sf))))


@query
def quality_counts(spark, sf):
    return rollups.quality_counts(_readings(spark, sf))


@query
def duplicate_keys(spark, sf):
    return config_rules.duplicate_keys(B.rule_channels(spark, sf), ["device_id", "channel"])


@query
def poll_load(spark, sf):
    load = config_rules.poll_load(B.rule_fleets(spark, sf), B.rule_devices(spark, sf), B.rule_channels(spark, sf))
    return load.select("fleet_id", "devices", "enabled_channels", "estimated_cycle_ms", "too_short")


# ---------------------------------------------------------------- order, limit, sets


@query
def order_by_time(spark, sf):
    return rollups.order_by_time(_numbered(spark, sf))


@query
def take_n(spark, sf):
    return rollups.take_n(_numbered(spark, sf), 5)


@query
def latest_per_device(spark, sf):
    return health.latest_per_device(_health(spark, sf)).select(*HEALTH_COLUMNS)


@query
def health_events(spark, sf):
    changes = B.lifecycle_log(spark, sf).filter(F.col("kind").isin("add", "remove", "update"))
    log = health.health_events(B.lineitem_polls(spark, sf), _probes(spark, sf), changes)
    return log.groupBy("device_id", "us", "kind").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("success").alias("ok"), F.max("error").alias("error")
    )


@query
def all_violations(spark, sf):
    return _violations(
        config_rules.all_violations(B.rule_fleets(spark, sf), B.rule_devices(spark, sf), B.rule_channels(spark, sf))
    )


# ---------------------------------------------------------------- configuration rules


@query
def validate_channels(spark, sf):
    return _violations(config_rules.validate_channels(B.rule_channels(spark, sf))).drop("fleet_id")


@query
def validate_devices(spark, sf):
    return _violations(config_rules.validate_devices(B.rule_devices(spark, sf), B.rule_channels(spark, sf)))


@query
def validate_fleet(spark, sf):
    return _violations(
        config_rules.validate_fleet(B.rule_fleets(spark, sf), B.rule_devices(spark, sf), B.rule_channels(spark, sf))
    )


@query
def config_gate(spark, sf):
    """Devices of documents without any finding: of the rules, of types, or of the document as a whole."""
    devices, _, _ = device_config.gated_config(spark, B.config_files(spark, sf), lines=True)
    return devices.select("fleet_id", "device_id", "ip_address")


@query
def device_gate(spark, sf):
    """Devices whose own and channel settings have no finding."""
    devices, channels = B.rule_devices(spark, sf).drop("fleet_id"), B.rule_channels(spark, sf)
    return config_rules.config_gate(devices, config_rules.validate_devices(devices, channels)).select(
        "device_id", "ip_address"
    )


# ---------------------------------------------------------------- streams


def _replayed(spark, sf, shape, mode="append", keys=None, source=B.arrived_polls):
    """A stream run three times from one checkpoint, after each part of the log that arrives."""
    folder = work_folder(spark, "stream")
    for _ in B.arrivals(spark, sf, f"{folder}/in"):
        result = replay(shape(source(spark, f"{folder}/in")), f"{folder}/run", mode, keys)
    return result


@query
def stream_process(spark, sf):
    channels = B.fleet_channels(spark, sf)
    return _replayed(
        spark,
        sf,
        lambda polls: run_stream_process(polls, channels, window_seconds=DAY, with_tags=False).select(*READING_COLUMNS),
    )


@query
def stream_rate(spark, sf):
    def rated(polls):
        counters = filters.successful_polls(polls).select(
            "device_id", "channel", "us", "seq", R.decode_registers(F.col("registers")).alias("raw_value")
        )
        return run_stream_rate(counters.filter(F.col("raw_value").isNotNull()), DAY, gate=None)

    return _replayed(spark, sf, rated)


@query
def stream_health(spark, sf):
    """Reads and probes, with devices that are updated, removed and added again on the way."""

    def folded(events):
        return run_stream_health(B.lifecycle_of(events), start_us=B.START_US)

    return _replayed(spark, sf, folded, "update", source=B.arrived_events).select(*HEALTH_COLUMNS)


@query
def tumbling_buffer(spark, sf):
    buffers = _replayed(
        spark, sf, lambda polls: rollups.tumbling_buffer(polls.select("device_id", "seq", "ts"), "1 minute")
    )
    return _micros(buffers).select("device_id", "seq", "window_start", "window_end")


@query
def tumbling_window(spark, sf):
    def totals(polls):
        aggregates = [F.count(F.lit(1)).alias("polls"), F.count_if("success").alias("ok")]
        return rollups.tumbling_window(rollups.late_data(polls, "1 hour"), aggregates, "1 hour", ["device_id"])

    keys = ["window_start", "window_end", "device_id"]
    return _micros(_replayed(spark, sf, totals, "update", keys)).select(*keys, "polls", "ok")


@query
def sample_latest(spark, sf):
    def latest(polls):
        rows = polls.select("device_id", "channel", "us", "seq", "ts")
        return rollups.sample_latest(rollups.late_data(rows, "1 hour"), "1 second").drop("ts")

    keys = ["window_start", "window_end"]
    return _micros(_replayed(spark, sf, latest, "update", keys)).select(*keys, "device_id", "channel", "us", "seq")


@query
def group_stream(spark, sf):
    def totals(polls):
        rows = filters.successful_polls(polls).withColumn("raw_value", R.decode_registers(F.col("registers")))
        return rollups.group_stream(rows.filter(F.col("raw_value").isNotNull()), ["device_id"])

    return _replayed(spark, sf, totals, "update", ["device_id"]).select("device_id", "readings", "last_us", "last_raw")


@query
def fan_out(spark, sf):
    """Two subscribers on one stream: all failures, and the number of polls per device."""
    folder = work_folder(spark, "fan-out")
    log = f"{folder}/commits"
    writers = {
        "failures": batch_writer(f"{folder}/failures", lambda df: df.filter(~F.col("success"))),
        "counts": batch_writer(f"{folder}/counts", lambda df: df.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"))),
    }
    for _ in B.arrivals(spark, sf, f"{folder}/in"):
        stream = B.arrived_polls(spark, f"{folder}/in").select("device_id", "seq", "success")
        run_fan_out(stream, writers, f"{folder}/checkpoint", log=log).awaitTermination()
    failures = committed(spark, f"{folder}/failures", log).groupBy("device_id").agg(F.count(F.lit(1)).alias("failures"))
    counts = committed(spark, f"{folder}/counts", log).groupBy("device_id").agg(F.sum("n").alias("polls"))
    return counts.join(failures, "device_id", "left")


def _late_windows(spark, sf):
    """Hourly counts of a log whose events come late now and then; the folder that holds them."""
    folder = work_folder(spark, "late")
    for _ in B.arrivals(spark, sf, f"{folder}/in", late=True):
        polls = B.arrived_polls(spark, f"{folder}/in").select("device_id", "seq", "us")
        partials = {"polls": F.count(F.lit(1))}
        write_windows(polls, f"{folder}/out", f"{folder}/checkpoint", 3600, partials, 3600).awaitTermination()
    return f"{folder}/out"


@query
def late_data(spark, sf):
    """Hourly counts that the watermark has closed."""
    hours = closed_windows(spark, _late_windows(spark, sf), {"polls": F.sum("polls")}, 3600, 3600)
    return hours.select(
        F.col("window_us").alias("window_start"), (F.col("window_us") + 3600000000).alias("window_end"), "polls"
    )


@query
def late_rows(spark, sf):
    """The polls that came after their hour had been closed."""
    return read_late_rows(spark, _late_windows(spark, sf)).select("device_id", "seq", "us")


# ---------------------------------------------------------------- extension points


def _custom_rules():
    validator = hooks.custom_validator(
        lambda c: Q.grade_quality_custom(c("raw_value"), c("rate"), c("name")), ("name",)
    )
    return hooks.custom_transformer(
        lambda c: S.transform_temperature(
            c("raw_value"), c("scale_factor"), c("offset"), c("decimal_places"), c("name"), c("tags")
        ),
        ("scale_factor", "offset", "decimal_places", "name", "tags"),
        base=validator,
    )


@query
def custom_validator(spark, sf):
    rules = hooks.custom_validator(
        lambda c: Q.grade_quality_custom(c("raw_value"), c("rate"), c("name")), ("name",)
    )
    rows = readings.process_readings(_polls(spark, sf), B.fleet_channels(spark, sf), rules, DAY, with_tags=False)
    return rows.select("device_id", "seq", "rate", "quality", "quality_name")


@query
def custom_transformer(spark, sf):
    rows = readings.process_readings(
        _polls(spark, sf), B.fleet_channels(spark, sf), _custom_rules(), DAY, with_tags=False
    )
    return rows.select("device_id", "seq", "processed_value", "quality")


@query
def custom_processor(spark, sf):
    """A processor that doubles the first word and has no rate."""

    def doubling(polls, channels):
        joined = joins.join_channel_config(filters.successful_polls(polls), channels, ["unit"])
        first = F.coalesce(R.word(F.col("registers"), 0), F.lit(0).cast("bigint"))
        return joined.select(
            "device_id", "channel", "seq", first.alias("raw_value"), (first * 2.0).alias("processed_value"), "unit"
        )

    return hooks.custom_processor(_polls(spark, sf), B.fleet_channels(spark, sf), doubling)


# ---------------------------------------------------------------- whole pipelines


@query
def process_readings(spark, sf):
    rows = _readings(spark, sf, with_tags=True)
    return rows.select(*READING_COLUMNS, G.tags_text(F.col("tags")).alias("tags"))


@query
def read_and_log(spark, sf):
    rows = readings.read_and_log(
        B.event_blocks(spark, sf), [0, 1, 2, 3], window_seconds=DAY, overflow_threshold=4200000000
    )
    return rows.select("device_id", "channel", "us", "seq", "count", "rate", "near_overflow")


@query
def read_and_log_fleet(spark, sf):
    rows = readings.read_and_log_fleet(B.event_blocks(spark, sf), B.block_settings(spark, sf))
    return rows.select("device_id", "channel", "us", "seq", "count", "rate", "near_overflow")
