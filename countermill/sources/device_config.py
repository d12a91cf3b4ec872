"""Nested device configuration to the two dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countermill.functions.quality import overflow_limit
from countermill.operators import config_rules
from countermill.schemas import FLEET_CONFIG_JSON
from countermill.vocab import OVERFLOW_THRESHOLD

# What a missing setting stands for.
CHANNEL_DEFAULTS = {
    "channel": 0,
    "name": "",
    "enabled": True,
    "start_register": 0,
    "register_count": 2,
    "scale_factor": 1.0,
    "offset": 0.0,
    "unit": "counts",
    "decimal_places": 0,
}

# The same for a device.
DEVICE_DEFAULTS = {
    "device_id": "",
    "ip_address": "",
    "port": 502,
    "unit_id": 1,
    "timeout_ms": 3000,
    "max_retries": 3,
    "retry_delay_ms": 1000,
    "receive_buffer_size": 8192,
    "send_buffer_size": 8192,
    "keep_alive": True,
    "enable_nagle": False,
    "enable_rate_calculation": True,
    "rate_window_seconds": 60,
    "enable_data_validation": True,
    "overflow_threshold": OVERFLOW_THRESHOLD,
}

# The same for a fleet.
FLEET_DEFAULTS = {
    "poll_interval_ms": 5000,
    "health_check_interval_ms": 30000,
    "max_concurrent_devices": 10,
    "data_buffer_size": 10000,
    "batch_size": 100,
    "batch_timeout_ms": 5000,
    "max_consecutive_failures": 5,
    "device_timeout_minutes": 5,
}

# The sections of the script's configuration.
SCRIPT_DEFAULTS = {
    "modbus": {
        "host": "192.168.1.100",
        "port": 502,
        "unit_id": 1,
        "timeout": 3,
        "retry_on_empty": True,
        "retry_on_invalid": True,
        "retries": 3,
        "retry_delay": 1.0,
    },
    "influxdb": {
        "host": "localhost",
        "port": 8086,
        "username": "",
        "password": "",
        "database": "adam_counters",
        "ssl": False,
        "verify_ssl": False,
        "timeout": 5,
        "retries": 3,
    },
    "logging": {
        "poll_interval": 5.0,
        "log_level": "INFO",
        "log_file": "adam_logger.log",
        "max_log_size": "10MB",
        "backup_count": 5,
    },
    "counters": {
        "channels": [0, 1],
        "calculate_rate": True,
        "rate_window": 60,
        "overflow_threshold": 4294967000,
    },
    "device": {
        "name": "ADAM-6051",
        "location": "default",
        "description": "Counter monitoring device",
    },
}


def _default(value) -> Column:
    return F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)


def _merge_struct(column: Column, fields: list[str], defaults: dict) -> Column:
    parts = []
    for name in dict.fromkeys([*fields, *defaults]):
        own = column[name] if name in fields else None
        if name not in defaults:
            parts.append(own.alias(name))
        elif own is None:
            parts.append(_default(defaults[name]).alias(name))
        else:
            parts.append(F.coalesce(own, _default(defaults[name])).alias(name))
    return F.struct(*parts)


def apply_config_defaults(config: DataFrame, defaults: dict) -> DataFrame:
    """Fill missing settings; a set value wins. A nested dict fills the struct column of its name."""
    out = []
    for name in dict.fromkeys([*config.columns, *defaults]):
        have = name in config.columns
        if name not in defaults:
            out.append(F.col(name))
        elif isinstance(defaults[name], dict):
            kind = config.schema[name].dataType if have else T.StructType()
            section = _merge_struct(F.col(name) if have else F.lit(None), kind.fieldNames(), defaults[name])
            out.append(section.alias(name))
        else:
            out.append((F.coalesce(F.col(name), _default(defaults[name])) if have else _default(defaults[name])).alias(name))
    return config.select(*out)


def _snake(name: str) -> str:
    special = {"ChannelNumber": "channel"}
    return special.get(name) or "".join(f"_{c.lower()}" if c.isupper() else c for c in name).lstrip("_")


def _as_text(kind: T.DataType) -> T.DataType:
    """The shape of a document as it is read: every setting as its text, tags with the type they have."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_text(kind.elementType))
    return T.MapType(T.StringType(), T.VariantType()) if isinstance(kind, T.MapType) else T.StringType()


def _typed(value: Column, kind: T.DataType) -> Column:
    """A setting from its text; NULL where the text is none of that type. A number may be quoted."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: F.try_variant_get(v, "$", "string"))
    if isinstance(kind, T.BooleanType):
        word = F.lower(F.trim(value))
        return F.when(word.isin("true", "false"), word == "true")
    return F.trim(value).try_cast(kind)


def _flat(struct: str, schema: T.StructType, skip: tuple[str, ...] = ()) -> list[Column]:
    return [_typed(F.col(f"{struct}.{f.name}"), f.dataType).alias(_snake(f.name)) for f in schema.fields if f.name not in skip]


def _mistyped(struct: str, schema: T.StructType) -> Column:
    """The settings of a struct whose text does not have their type, as an array of (member, value)."""
    plain = [f for f in schema.fields if not isinstance(f.dataType, (T.StringType, T.MapType, T.ArrayType))]
    faults = [
        F.when(
            F.col(f"{struct}.{f.name}").isNotNull() & _typed(F.col(f"{struct}.{f.name}"), f.dataType).isNull(),
            F.struct(F.lit(f.name).alias("member"), F.col(f"{struct}.{f.name}").alias("value")),
        )
        for f in plain
    ]
    return F.filter(F.array(*faults), lambda fault: fault.isNotNull())


DEVICE_JSON = FLEET_CONFIG_JSON["Devices"].dataType.elementType
CHANNEL_JSON = DEVICE_JSON["Channels"].dataType.elementType


def mistyped_settings(documents: DataFrame) -> DataFrame:
    """A finding for each setting whose value cannot be read as its type, in the form of the rules'
    findings. Such a setting takes its default in the tables, so the gate has to see these findings."""
    devices = documents.select(F.col("config.FleetId").alias("fleet_id"), F.explode("config.Devices").alias("d"))
    channels = devices.select("fleet_id", F.col("d.DeviceId").alias("device_id"), F.explode("d.Channels").alias("c"))
    none = F.lit(None)
    levels = [
        ("fleet", documents.select(F.col("config.FleetId").alias("fleet_id"), "config"), none, none, "config", FLEET_CONFIG_JSON),
        ("device", devices, F.col("d.DeviceId"), none, "d", DEVICE_JSON),
        ("channel", channels, F.col("device_id"), _typed(F.col("c.ChannelNumber"), T.IntegerType()), "c", CHANNEL_JSON),
    ]
    found = None
    for level, rows, device, channel, struct, schema in levels:
        faults = rows.select(
            F.lit(level).alias("level"),
            F.lit("document").alias("stage"),
            "fleet_id",
            device.cast("string").alias("device_id"),
            channel.cast("int").alias("channel"),
            F.explode(_mistyped(struct, schema)).alias("fault"),
        ).select(
            "level",
            "stage",
            "fleet_id",
            "device_id",
            "channel",
            F.lit("mistyped_setting").alias("rule"),
            F.concat(F.lit("The value of "), F.col("fault.member"), F.lit(" does not have its type: "), F.col("fault.value")).alias("message"),
            F.array("fault.member").alias("members"),
        )
        found = faults if found is None else found.unionByName(faults)
    return found


def read_config_documents(
    spark: SparkSession, path: str, root: str | None = "AdamLogger", lines: bool = False
) -> DataFrame:
    """Configuration documents, one per file or, with `lines`, one per line.

    `root` names the section that holds the settings; a document without it is taken as the
    settings themselves. A document is one row, so keep large fleets as lines of few devices. One that
    names no fleet is a fleet of its own, named by its file and, with `lines`, the digest of its line.
    """
    return parse_config_documents(_texts(spark, path, lines), "value", root).drop("_document")


def _texts(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    file = F.col("_metadata.file_path")
    name = F.concat(file, F.lit("#"), F.md5("value")) if lines else file
    return spark.read.text(path, wholetext=not lines).withColumn("_document", name)


def malformed_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A finding for each document that is no JSON, in the form of the rules' findings, under the fleet
    name that the document stands for. Add it to the violations, so that the gate sees it."""
    broken = _texts(spark, path, lines).filter(F.try_parse_json("value").isNull() & (F.trim("value") != ""))
    none = F.lit(None)
    return broken.select(
        F.lit("fleet").alias("level"),
        F.lit("document").alias("stage"),
        F.col("_document").alias("fleet_id"),
        none.cast("string").alias("device_id"),
        none.cast("int").alias("channel"),
        F.lit("malformed_document").alias("rule"),
        F.lit("The configuration document is not valid JSON").alias("message"),
        F.array().cast("array<string>").alias("members"),
    )


def parse_config_documents(documents: DataFrame, column: str, root: str | None = "AdamLogger") -> DataFrame:
    """Parse JSON documents held in a text column into a struct column `config` that holds every setting
    as its text; the tables of fleets, devices and channels give them their types."""
    body = F.col(column)
    if root:
        body = F.coalesce(F.get_json_object(body, f"$.{root}"), body)
    config = F.from_json(body, _as_text(FLEET_CONFIG_JSON))
    if "_document" in documents.columns:
        parsed = documents.withColumn("config", config)
        fleet = F.coalesce("config.FleetId", "_document")
        return parsed.withColumn("config", F.col("config").withField("FleetId", fleet)).drop(column)
    return documents.withColumn("config", config).drop(column)


def fleets_of(documents: DataFrame) -> DataFrame:
    flat = documents.select(*_flat("config", FLEET_CONFIG_JSON, ("Devices",)))
    return apply_config_defaults(flat, FLEET_DEFAULTS)


def document_findings(spark: SparkSession, path: str, root: str | None = "AdamLogger", lines: bool = False) -> DataFrame:
    """All findings that come from the documents themselves: those that are no JSON, and mistyped settings."""
    documents = parse_config_documents(_texts(spark, path, lines), "value", root)
    return malformed_documents(spark, path, lines).unionByName(mistyped_settings(documents))


def _device_rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("config.FleetId").alias("fleet_id"), F.explode("config.Devices").alias("d"))


def devices_of(documents: DataFrame) -> DataFrame:
    """One row per device, defaults applied."""
    flat = _device_rows(documents).select("fleet_id", *_flat("d", DEVICE_JSON, ("Channels",)))
    return apply_config_defaults(flat, DEVICE_DEFAULTS)


def channels_of(documents: DataFrame) -> DataFrame:
    """One row per device channel, defaults applied.

    The overflow threshold is a channel tag. A JSON whole number counts as long; anything else, a quoted
    number too, switches the check off.
    """
    flat = (
        _device_rows(documents)
        .select("fleet_id", F.col("d.DeviceId").alias("device_id"), F.explode("d.Channels").alias("c"))
        .select(
            "fleet_id", "device_id", *_flat("c", CHANNEL_JSON), F.try_element_at("c.Tags", F.lit("overflow_threshold")).alias("_tag")
        )
    )
    kind = F.when(F.schema_of_variant("_tag") == "BIGINT", F.lit("long"))
    limit = overflow_limit(F.try_variant_get("_tag", "$", "string"), kind)
    return (
        apply_config_defaults(flat, CHANNEL_DEFAULTS)
        .withColumn("overflow_threshold", F.coalesce(limit, F.lit(OVERFLOW_THRESHOLD)))
        .withColumn("overflow_check", limit.isNotNull())
        .drop("_tag")
    )


def load_device_config(
    spark: SparkSession, path: str, root: str | None = "AdamLogger", lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The device and channel tables of the configuration files below `path`."""
    documents = read_config_documents(spark, path, root, lines)
    return devices_of(documents), channels_of(documents)


def gated_config(
    spark: SparkSession, path: str, root: str | None = "AdamLogger", lines: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The devices that may run, their channels, and all findings that keep others from it: those of the
    rules and those of the documents themselves, so that no caller can leave the latter out."""
    documents = read_config_documents(spark, path, root, lines)
    devices, channels = devices_of(documents), channels_of(documents)
    found = config_rules.validate_fleet(
        fleets_of(documents), devices, channels, document_findings(spark, path, root, lines)
    )
    allowed = config_rules.config_gate(devices, found)
    owners = allowed.select("fleet_id", "device_id").distinct()
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in ("fleet_id", "device_id")]
    return allowed, channels.alias("c").join(owners.alias("o"), same, "left_semi"), found


def legacy_channel_list(configs: DataFrame, channels: str = "channels") -> DataFrame:
    """One row per device and listed channel."""
    return configs.withColumn("channel", F.explode(channels)).drop(channels)
