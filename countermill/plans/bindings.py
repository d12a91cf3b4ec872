"""The test tables seen as polls, configuration and health events.

No table holds register polls, so they are derived row by row: nothing here shuffles, and the
work of every query grows with the tables it reads. `oracle.py` states the same in SQL.

* `events` is the poll log of a fleet: a device per user, error events are failed reads, and the
  counter runs at about 10,000 counts per second and wraps every five days.
* `customer` is that fleet's configuration: a device per customer with four channels.
* `lineitem` is a second poll log with many channels per cycle, `supplier` its devices.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countermill.session import require_utc, work_folder
from countermill.sources.polls import read_register_log, stream_register_log

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

START_US = 1704067200000000  # 2024-01-01, where the event log begins


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return require_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _us(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _counter() -> Column:
    turn = F.lit(4294967296)
    return F.pmod(
        F.expr("unix_micros(cast(ts AS timestamp)) div 100")
        + F.col("user_id") * 7919
        + F.floor(F.col("value") * 100).cast("bigint"),
        turn,
    )


def _words(counter: Column) -> list[Column]:
    return [counter.bitwiseAND(65535).cast("int"), F.shiftright(counter, 16).cast("int")]


def event_polls_mapping() -> dict[str, Column]:
    """Poll columns from the event columns. One poll in fifty each is empty, short or long."""
    low, high = _words(_counter())
    shape = F.col("event_id") % 50
    registers = (
        F.when(F.col("event_type") == "error", F.lit(None))
        .when(shape == 7, F.array().cast("array<int>"))
        .when(shape == 8, F.array(low))
        .when(shape == 9, F.array(low, high, F.lit(17)))
        .otherwise(F.array(low, high))
    )
    return {
        "device_id": F.concat(F.lit("DEV_"), F.col("user_id")),
        "channel": (F.col("user_id") % 4).cast("int"),
        "registers": registers,
        "ts": F.col("ts"),
        "success": F.col("event_type") != "error",
        "acquisition_us": (F.col("event_id") % 97 + 1) * 1000,
        "error": F.when(F.col("event_type") == "error", F.lit("read failed")),
        "seq": F.col("event_id"),
    }


def event_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_register_log(
        spark, f"{sf_dir}/events.parquet", schema=EVENTS_SCHEMA, mapping=event_polls_mapping()
    )


def event_polls_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A stream takes folders or patterns; this pattern fits one file as well as a folder of parts.
    return stream_register_log(
        spark, f"{sf_dir}/events.parque[t]", schema=EVENTS_SCHEMA, mapping=event_polls_mapping()
    )


def faulty_poll_files(spark: SparkSession, sf_dir: str) -> str:
    """The poll log as files of JSON lines in the shared folder; some lines are cut off, and some polls
    have no device, no channel or no time."""
    n = F.col("seq")
    polls = event_polls(spark, sf_dir).select(
        F.when(n % 43 != 7, F.col("device_id")).alias("device_id"),
        F.when(n % 59 != 8, F.col("channel")).alias("channel"),
        "registers",
        F.when(n % 47 != 9, F.col("ts")).alias("ts"),
        "success",
        "acquisition_us",
        "error",
        "seq",
    )
    line = F.to_json(F.struct(*polls.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    cut = F.expr("substring(line, 1, length(line) - 6)")
    lines = polls.select("seq", line.alias("line")).select(F.when(n % 41 == 3, cut).otherwise(F.col("line")))
    folder = work_folder(spark, "polls")
    lines.write.text(folder)
    return folder


ARRIVALS = 3
TEN_DAYS_US = 864000000000


def arrivals(spark: SparkSession, sf_dir: str, folder: str, late: bool = False) -> Iterator[int]:
    """The event log as it comes in: ten days at a time are written to the folder, then it is the caller's
    turn to run a stream. With `late`, one event in 97 arrives up to twenty days behind."""
    events = _table(spark, sf_dir, "events").select(*EVENTS_SCHEMA.names)
    due = F.floor((_us("ts") - F.lit(START_US)) / F.lit(TEN_DAYS_US))
    if late:
        due = due + F.when(F.col("event_id") % 97 == 5, F.lit(2)).otherwise(F.lit(0))
    for n in range(ARRIVALS):
        events.filter(F.least(due, F.lit(ARRIVALS - 1)) == n).write.mode("append").parquet(folder)
        yield n


def arrived_events(spark: SparkSession, folder: str) -> DataFrame:
    return require_utc(spark).readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 64).parquet(folder)


def arrived_polls(spark: SparkSession, folder: str) -> DataFrame:
    return stream_register_log(spark, folder, schema=EVENTS_SCHEMA, mapping=event_polls_mapping())


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block reads of four channels; one in ten is a word short of its last channel."""
    low, high = _words(_counter())
    pairs = [F.array(low, ((high + k) % 65536).cast("int")) for k in range(4)]
    block = F.flatten(F.array(*pairs))
    events = require_utc(spark).read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    registers = F.when(F.col("event_type") == "error", F.lit(None)).when(
        F.col("event_id") % 10 == 3, F.slice(block, 1, 7)
    ).otherwise(block)
    return events.select(
        F.concat(F.lit("DEV_"), F.col("user_id")).alias("device_id"),
        registers.alias("registers"),
        _us("ts").alias("us"),
        F.col("event_id").alias("seq"),
    )


def block_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of the script pipeline per customer device: windows of six hours to two days, two thresholds,
    no rate for one in seven, two channels for one in five."""
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        F.concat(F.lit("DEV_"), k).alias("device_id"),
        F.when(k % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(*map(F.lit, range(4)))).alias("channels"),
        F.when(k % 3 == 0, F.lit(21600)).when(k % 3 == 1, F.lit(86400)).otherwise(F.lit(172800)).alias("rate_window"),
        F.when(k % 2 == 0, F.lit(4200000000)).otherwise(F.lit(4000000000)).alias("overflow_threshold"),
        (k % 7 != 3).alias("calculate_rate"),
    )


def lineitem_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls of the second fleet: a cycle is a ship date, a channel a line number."""
    items = _table(spark, sf_dir, "lineitem")
    counter = F.floor(F.col("l_extendedprice") * 100).cast("bigint")
    failed = F.col("l_returnflag") == "R"
    return items.select(
        F.concat(F.lit("SUP_"), F.col("l_suppkey")).alias("device_id"),
        F.col("l_linenumber").cast("int").alias("channel"),
        F.when(~failed, F.array(*_words(counter))).alias("registers"),
        _us("l_shipdate").alias("us"),
        (~failed).alias("success"),
        (F.col("l_quantity").cast("bigint") * 1000).alias("acquisition_us"),
        F.when(failed, F.lit("read failed")).alias("error"),
        (F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def _choose(n: Column, *values: object, kind: str) -> Column:
    out = F.when(n == 0, F.lit(values[0]))
    for at, value in enumerate(values[1:], 1):
        out = out.when(n == at, value if isinstance(value, Column) else F.lit(value))
    return out.cast(kind)


def fleet_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four channels per customer device, with different scales, limits and overflow tags."""
    base = _table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", "c_acctbal", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("channel")
    )
    n, key = F.col("channel"), F.col("c_custkey")
    label = F.concat(_choose(n, "Production_", "Temperature_", "Flow_", "Channel_", kind="string"), key)
    tags = F.map_filter(
        F.create_map(
            F.lit("channel_type"),
            F.lit("counter"),
            F.lit("unit"),
            _choose(n, None, "fahrenheit", "litres", None, kind="string"),
            F.lit("line"),
            F.when(n != 3, F.col("c_mktsegment")),
        ),
        lambda _, v: v.isNotNull(),
    )
    return base.select(
        F.concat(F.lit("DEV_"), key).alias("device_id"),
        n.alias("channel"),
        label.alias("name"),
        _choose(n, F.concat(F.lit("Counter "), key), "Probe", "  ", None, kind="string").alias("description"),
        ((n != 3) | (F.col("c_acctbal") >= 0)).alias("enabled"),
        (n * 2).alias("start_register"),
        F.lit(2).alias("register_count"),
        _choose(n, 1.0, 0.1, 0.01, 0.5, kind="double").alias("scale_factor"),
        _choose(n, 0.0, -273.15, 0.0, 100.0, kind="double").alias("offset"),
        _choose(n, "parts", "celsius", "litres", "counts", kind="string").alias("unit"),
        _choose(n, 0, 2, 1, 0, kind="int").alias("decimal_places"),
        _choose(n, 0, None, 1000000, 0, kind="bigint").alias("min_value"),
        _choose(n, 4294967295, 4000000000, None, 4200000000, kind="bigint").alias("max_value"),
        _choose(n, None, 10000.0, 10050.0, 12000.0, kind="double").alias("max_rate_of_change"),
        _choose(n, 4000000000, 4294000000, 4294000000, 3900000000, kind="bigint").alias("overflow_threshold"),
        (n != 2).alias("overflow_check"),
        tags.alias("tags"),
    )


def fleet_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer")
    location = F.concat(F.lit("site_"), F.col("c_nationkey"))
    return customers.select(
        F.concat(F.lit("DEV_"), F.col("c_custkey")).alias("device_id"),
        F.col("c_name").alias("name"),
        location.alias("location"),
        F.create_map(F.lit("location"), location, F.lit("line"), F.col("c_mktsegment")).alias("tags"),
    )


def device_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The device to line mapping; devices of customers in debt are on none."""
    return _table(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0).select(
        F.concat(F.lit("DEV_"), F.col("c_custkey")).alias("device_id"), F.col("c_mktsegment").alias("line")
    )


def supplier_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven channels per supplier device; the last is off where the balance is negative."""
    lines = F.explode(F.sequence(F.lit(1), F.lit(7))).alias("channel")
    return _table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", lines).select(
        F.concat(F.lit("SUP_"), F.col("s_suppkey")).alias("device_id"),
        "channel",
        ((F.col("channel") != 7) | (F.col("s_acctbal") >= 0)).alias("enabled"),
    )


def config_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-up events as configuration changes of their device."""
    events = require_utc(spark).read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    return events.filter(F.col("event_type") == "signup").select(
        F.concat(F.lit("DEV_"), F.col("user_id")).alias("device_id"),
        _us("ts").alias("valid_from_us"),
        F.col("event_id").alias("version"),
        (F.lit(1.0) + (F.col("event_id") % 5)).alias("scale_factor"),
    )


def lifecycle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = require_utc(spark).read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    return lifecycle_of(events)


def lifecycle_of(events: DataFrame) -> DataFrame:
    """The event log as health events: sign-ups change the fleet, the others are reads."""
    turn = F.col("event_id") % 4
    change = (
        F.when(turn == 0, F.lit("add"))
        .when(turn == 1, F.lit("remove"))
        .when(turn == 2, F.lit("update"))
        .otherwise(F.lit("probe"))
    )
    kind = F.when(F.col("event_type") == "signup", change).otherwise(F.lit("read"))
    return events.select(
        F.concat(F.lit("DEV_"), F.col("user_id")).alias("device_id"),
        _us("ts").alias("us"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("read failed "), F.col("event_id"))).alias("error"),
    )


def rule_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel settings with faults, a channel per part; some keys occur twice."""
    parts = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return parts.select(
        F.concat(F.lit("RULE_"), F.floor(k / 8).cast("bigint")).alias("device_id"),
        F.when(k % 101 == 0, F.lit(300))
        .when(k % 103 == 0, F.lit(-1))
        .when(k % 107 == 0, (k + 1) % 8)
        .otherwise(k % 8)
        .cast("int")
        .alias("channel"),
        F.when(k % 109 == 0, F.lit(" "))
        .when(k % 113 == 0, F.repeat(F.col("p_name"), 20))
        .otherwise(F.col("p_name"))
        .alias("name"),
        (F.col("p_size") > 3).alias("enabled"),
        F.when(k % 127 == 0, F.lit(65530)).otherwise(k % 100).cast("int").alias("start_register"),
        F.when(k % 127 == 0, F.lit(10)).when(k % 131 == 0, F.lit(0)).otherwise(F.lit(2)).alias("register_count"),
        F.when(k % 137 == 0, F.lit(0.0)).otherwise(F.lit(1.0)).alias("scale_factor"),
        F.when(k % 139 == 0, F.lit(-1)).otherwise(k % 4).cast("int").alias("decimal_places"),
        F.when(k % 149 == 0, F.lit(9000)).otherwise(F.lit(0)).cast("bigint").alias("min_value"),
        F.when(k % 3 != 0, F.col("p_size") * 100).cast("bigint").alias("max_value"),
        F.when(k % 151 == 0, F.lit(-1.0)).when(k % 2 == 0, F.lit(1000.0)).alias("max_rate_of_change"),
    )


def rule_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device settings with faults, a device per customer and some of them twice."""
    base = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    twice = base.withColumn(
        "copy", F.explode(F.when(F.col("c_custkey") % 50 == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    k = F.col("c_custkey")
    ip = (
        F.when(k % 21 == 0, F.lit(""))
        .when(k % 22 == 0, F.lit("300.1.2.3"))
        .when(k % 23 == 0, F.lit("fe80::1"))
        .otherwise(F.concat(F.lit("10.0."), (k % 256).cast("string"), F.lit(".9")))
    )
    return twice.select(
        F.concat(F.lit("FLEET_"), F.col("c_nationkey")).alias("fleet_id"),
        F.when(k % 24 == 0, F.concat(F.lit("RULE_"), F.lpad(k.cast("string"), 50, "0")))
        .otherwise(F.concat(F.lit("RULE_"), k))
        .alias("device_id"),
        ip.alias("ip_address"),
        F.when(k % 15 == 0, F.lit(0)).otherwise(F.lit(502)).alias("port"),
        F.when(k % 16 == 0, F.lit(256)).otherwise(F.lit(1)).alias("unit_id"),
        F.when(k % 17 == 0, F.lit(0)).otherwise(F.lit(3000)).alias("timeout_ms"),
        F.when(k % 18 == 0, F.lit(-1)).otherwise(F.lit(3)).alias("max_retries"),
        F.when(k % 19 == 0, F.lit(20000)).otherwise(F.lit(1000)).alias("retry_delay_ms"),
        F.when(k % 25 == 0, F.lit(500)).otherwise(F.lit(8192)).alias("receive_buffer_size"),
        F.when(k % 26 == 0, F.lit(100000)).otherwise(F.lit(8192)).alias("send_buffer_size"),
        F.when(k % 27 == 0, F.lit(5)).otherwise(F.lit(60)).alias("rate_window_seconds"),
        F.when(k % 28 == 0, F.lit(500)).otherwise(F.lit(4294000000)).cast("bigint").alias("overflow_threshold"),
    )


def rule_fleets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleet settings with faults, a fleet per nation; devices and channels belong to them."""
    k = F.col("n_nationkey")
    return _table(spark, sf_dir, "nation").select(
        F.concat(F.lit("FLEET_"), k).alias("fleet_id"),
        F.when(k % 5 == 0, F.lit(50)).otherwise(F.lit(5000)).alias("poll_interval_ms"),
        F.when(k % 6 == 0, F.lit(1000)).otherwise(F.lit(30000)).alias("health_check_interval_ms"),
        F.when(k % 7 == 0, F.lit(0)).otherwise(F.lit(50)).alias("max_concurrent_devices"),
        F.when(k % 8 == 0, F.lit(50)).otherwise(F.lit(10000)).alias("data_buffer_size"),
        F.when(k % 9 == 0, F.lit(0)).otherwise(F.lit(100)).alias("batch_size"),
        F.when(k % 10 == 0, F.lit(50)).otherwise(F.lit(5000)).alias("batch_timeout_ms"),
        F.when(k % 11 == 0, F.lit(0)).otherwise(F.lit(5)).alias("max_consecutive_failures"),
        F.when(k % 12 == 0, F.lit(0)).otherwise(F.lit(5)).alias("device_timeout_minutes"),
    )


def config_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON configuration document per supplier, as text; some settings are left out, some have another
    type than they should, and the threshold tag is a number, a quoted number or a word."""
    k = F.col("s_suppkey")
    limit = F.when(k % 3 == 0, F.lit("1000000")).when(k % 3 == 1, F.lit('"often"')).otherwise(F.lit("2000000"))

    def channel(n: int) -> Column:
        return F.struct(
            F.lit(n).alias("ChannelNumber"),
            F.concat(F.lit(f"Part_{n}_"), k).alias("Name"),
            F.when(k % 2 == 0, F.lit(0.5)).alias("ScaleFactor"),
            F.when(k % 13 == 5, F.lit("no")).alias("Enabled"),
            (k * 10 + n).alias("MaxValue"),
            F.struct(F.parse_json(F.when(k % 7 == 2, F.lit('"5000"')).otherwise(limit)).alias("overflow_threshold")).alias("Tags"),
        )

    device = F.struct(
        F.concat(F.lit("SUP_"), k).alias("DeviceId"),
        F.concat(F.lit("10.1.0."), (k % 250).cast("string")).alias("IpAddress"),
        F.when(k % 4 == 0, F.lit("5020")).when(k % 11 == 3, F.lit("abc")).alias("Port"),
        F.create_map(F.lit("location"), F.concat(F.lit("nation_"), F.col("s_nationkey"))).alias("Tags"),
        F.array(channel(0), channel(1)).alias("Channels"),
    )
    body = F.struct(
        F.concat(F.lit("FLEET_"), k).alias("FleetId"),
        F.when(k % 19 == 7, F.lit(50)).otherwise(F.lit(1000)).alias("PollIntervalMs"),
        F.when(k % 17 == 4, F.lit(2.5)).alias("BatchSize"),
        F.array(device).alias("Devices"),
    )
    text = F.to_json(F.struct(body.alias("AdamLogger")))
    # One document in 23 is cut off before its end.
    cut = F.expr("substring(document, 1, length(document) - 3)")
    documents = _table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("document"))
    return documents.select(F.when(F.col("s_suppkey") % 23 == 6, cut).otherwise(F.col("document")).alias("document"))


def config_files(spark: SparkSession, sf_dir: str) -> str:
    """The documents as files of lines in the shared folder."""
    folder = work_folder(spark, "config")
    config_documents(spark, sf_dir).write.text(folder)
    return folder


def script_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script configurations per supplier with parts missing."""
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("SUP_"), k).alias("device_id"),
        F.struct(
            F.when(k % 2 == 0, F.concat(F.lit("10.2.0."), k % 250)).alias("host"), F.when(k % 3 == 0, k % 7).alias("retries")
        ).alias("modbus"),
        F.when(
            k % 4 != 0,
            F.struct(
                F.when(k % 4 != 1, F.sequence(F.lit(0), (k % 4).cast("int"))).alias("channels"),
                F.when(k % 5 == 0, F.lit(30)).alias("rate_window"),
            ),
        ).alias("counters"),
    )
