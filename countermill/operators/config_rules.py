"""Configuration rules as data-quality queries: one row per finding.

Attribute rules look at one field, object rules at several. The service evaluates the object rules
of a channel only when its attribute rules pass; `stage` lets a query apply that as a filter.
A duplicate key gives one finding per key, so that no list of keys has to be gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countermill.functions.text import is_blank
from countermill.operators.filters import enabled_channels
from countermill.vocab import MS_PER_CHANNEL

# Rule, column, lowest, highest, member and message of the range rules.
CHANNEL_RANGES = [
    ("channel_number_range", "channel", 0, 255, "ChannelNumber", "ChannelNumber must be between 0 and 255"),
    ("start_register_range", "start_register", 0, 65535, "StartRegister", "StartRegister must be between 0 and 65535"),
    ("register_count_range", "register_count", 1, 4, "RegisterCount", "RegisterCount must be between 1 and 4"),
    ("decimal_places_range", "decimal_places", 0, 10, "DecimalPlaces", "DecimalPlaces must be between 0 and 10"),
]

DEVICE_RANGES = [
    ("port_range", "port", 1, 65535, "Port", "Port must be between 1 and 65535"),
    ("unit_id_range", "unit_id", 1, 255, "UnitId", "UnitId must be between 1 and 255"),
    ("timeout_range", "timeout_ms", 500, 30000, "TimeoutMs", "Timeout must be between 500ms and 30 seconds"),
    ("max_retries_range", "max_retries", 0, 10, "MaxRetries", "MaxRetries must be between 0 and 10"),
    ("retry_delay_range", "retry_delay_ms", 100, 10000, "RetryDelayMs", "RetryDelayMs must be between 100ms and 10 seconds"),
    (
        "receive_buffer_range",
        "receive_buffer_size",
        1024,
        65536,
        "ReceiveBufferSize",
        "ReceiveBufferSize must be between 1KB and 64KB",
    ),
    ("send_buffer_range", "send_buffer_size", 1024, 65536, "SendBufferSize", "SendBufferSize must be between 1KB and 64KB"),
    (
        "rate_window_range",
        "rate_window_seconds",
        10,
        3600,
        "RateWindowSeconds",
        "RateWindowSeconds must be between 10 seconds and 1 hour",
    ),
    (
        "overflow_threshold_range",
        "overflow_threshold",
        1000000,
        4294967295,
        "OverflowThreshold",
        "OverflowThreshold must be reasonable for 32-bit counters",
    ),
]

FLEET_RANGES = [
    (
        "poll_interval_range",
        "poll_interval_ms",
        100,
        300000,
        "PollIntervalMs",
        "PollIntervalMs must be between 100ms and 5 minutes",
    ),
    (
        "health_check_range",
        "health_check_interval_ms",
        5000,
        300000,
        "HealthCheckIntervalMs",
        "HealthCheckIntervalMs must be between 5 seconds and 5 minutes",
    ),
    (
        "concurrency_range",
        "max_concurrent_devices",
        1,
        50,
        "MaxConcurrentDevices",
        "MaxConcurrentDevices must be between 1 and 50",
    ),
    ("data_buffer_range", "data_buffer_size", 100, 100000, "DataBufferSize", "DataBufferSize must be between 100 and 100,000"),
    ("batch_size_range", "batch_size", 1, 1000, "BatchSize", "BatchSize must be between 1 and 1,000"),
    ("batch_timeout_range", "batch_timeout_ms", 100, 30000, "BatchTimeoutMs", "BatchTimeoutMs must be between 100ms and 30 seconds"),
    (
        "consecutive_failures_range",
        "max_consecutive_failures",
        1,
        100,
        "MaxConsecutiveFailures",
        "MaxConsecutiveFailures must be between 1 and 100",
    ),
    (
        "device_timeout_range",
        "device_timeout_minutes",
        1,
        60,
        "DeviceTimeoutMinutes",
        "DeviceTimeoutMinutes must be between 1 and 60 minutes",
    ),
]

# Dotted quads with numbers up to 255, or an IPv6 form; short IPv4 forms are not taken. An IPv6 address has
# eight groups, or at most seven around one `::`; a dotted quad may stand for the last two.
_QUAD = r"((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)"
_GROUP = "[0-9A-Fa-f]{1,4}"
IPV4 = rf"^{_QUAD}$"
IPV6 = "|".join(
    (
        rf"^({_GROUP}:){{7}}{_GROUP}$",
        rf"^({_GROUP}:){{6}}{_QUAD}$",
        rf"^(?=(:*{_GROUP}){{0,7}}:*$)(({_GROUP}:)*{_GROUP})?::(({_GROUP}:)*{_GROUP})?$",
        rf"^(?=(:*{_GROUP}){{0,5}}:+{_QUAD}$)(({_GROUP}:)*{_GROUP})?::({_GROUP}:)*{_QUAD}$",
    )
)


def _finding(stage: str, rule: str, broken: Column, message: Column | str, *members: str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(
        F.coalesce(broken, F.lit(False)),
        F.struct(
            F.lit(stage).alias("stage"),
            F.lit(rule).alias("rule"),
            text.alias("message"),
            F.array(*[F.lit(m) for m in members]).alias("members"),
        ),
    )


def _ranges(rules: list[tuple]) -> list[Column]:
    return [
        _finding("attribute", rule, (F.col(column) < low) | (F.col(column) > high), message, member)
        for rule, column, low, high, member, message in rules
    ]


def _report(rows: DataFrame, level: str, findings: list[Column]) -> DataFrame:
    """Violation rows; keys that a level does not have are NULL."""
    found = rows.withColumn("_f", F.explode(F.filter(F.array(*findings), F.isnotnull)))

    def key(name: str, kind: str) -> Column:
        return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)

    return found.select(
        F.lit(level).alias("level"),
        "_f.stage",
        key("fleet_id", "string"),
        key("device_id", "string"),
        key("channel", "int"),
        "_f.rule",
        "_f.message",
        "_f.members",
    )


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def _owner(devices: DataFrame, channels: DataFrame) -> list[str]:
    """What names the device of a channel: the same id may stand in two fleets."""
    return [c for c in ("fleet_id", "device_id") if c in devices.columns and c in channels.columns]


def _with(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Left join on the columns both have; a missing fleet is a fleet like any other."""
    keys = [c for c in rows.columns if c in more.columns]
    same = [rows[c].eqNullSafe(more[c]) for c in keys]
    return rows.join(more, same, "left").select(*[rows[c] for c in rows.columns], *[more[c] for c in more.columns if c not in keys])


def validate_channels(channels: DataFrame) -> DataFrame:
    blank = is_blank(F.col("name"))
    findings = [
        *_ranges(CHANNEL_RANGES),
        _finding("attribute", "name_required", blank, "Channel name is required", "Name"),
        _finding(
            "attribute", "name_length", F.length("name") > 100, "Channel name must be 100 characters or less", "Name"
        ),
        _finding("object", "name_blank", blank, "Channel name is required and cannot be empty", "Name"),
        _finding(
            "object",
            "min_above_max",
            F.col("min_value") > F.col("max_value"),
            "MinValue cannot be greater than MaxValue",
            "MinValue",
            "MaxValue",
        ),
        _finding("object", "scale_zero", F.col("scale_factor") == 0, "ScaleFactor cannot be zero", "ScaleFactor"),
        _finding(
            "object",
            "rate_limit_not_positive",
            F.col("max_rate_of_change") <= 0,
            "MaxRateOfChange must be positive if specified",
            "MaxRateOfChange",
        ),
        _finding(
            "object",
            "register_count_not_positive",
            F.col("register_count") <= 0,
            "RegisterCount must be positive",
            "RegisterCount",
        ),
        _finding(
            "object",
            "register_end",
            F.col("start_register") + F.col("register_count") > 65535,
            "StartRegister + RegisterCount exceeds maximum Modbus address range",
            "StartRegister",
            "RegisterCount",
        ),
    ]
    return _report(channels, "channel", findings)


def validate_devices(devices: DataFrame, channels: DataFrame) -> DataFrame:
    """Findings of devices, of their channels (prefixed) and of duplicate channel numbers."""
    id_blank, ip = is_blank(F.col("device_id")), F.col("ip_address")
    ip_valid = F.coalesce(ip.rlike(IPV4) | ip.rlike(IPV6), F.lit(False))
    checked = _with(devices, channels.select(*_owner(devices, channels)).distinct().withColumn("_listed", F.lit(True)))
    findings = [
        *_ranges(DEVICE_RANGES),
        _finding("attribute", "device_id_required", id_blank, "DeviceId is required", "DeviceId"),
        _finding(
            "attribute", "device_id_length", F.length("device_id") > 50, "DeviceId must be 50 characters or less", "DeviceId"
        ),
        _finding("attribute", "ip_required", is_blank(ip), "IP Address is required", "IpAddress"),
        _finding("object", "device_id_blank", id_blank, "DeviceId is required and cannot be empty", "DeviceId"),
        _finding("object", "ip_invalid", ~ip_valid, "Valid IP address is required", "IpAddress"),
        _finding(
            "object", "no_channels", F.col("_listed").isNull(), "At least one channel must be configured", "Channels"
        ),
    ]
    own = _report(checked, "device", findings)

    fleet = ["fleet_id"] if "fleet_id" in channels.columns else []
    twice = _report(
        duplicate_keys(channels, [*fleet, "device_id", "channel"]),
        "device",
        [
            _finding(
                "object",
                "duplicate_channel",
                F.lit(True),
                F.concat(F.lit("Duplicate channel numbers are not allowed: "), F.col("channel")),
                "Channels",
            )
        ],
    )
    cascade = validate_channels(channels).withColumn(
        "message", F.concat(F.lit("Channel "), F.col("channel"), F.lit(": "), F.col("message"))
    )
    return own.unionByName(twice).unionByName(cascade)


def poll_load(fleets: DataFrame, devices: DataFrame, channels: DataFrame) -> DataFrame:
    """Per fleet: devices, enabled channels and estimated cycle time at 50 ms per channel."""
    owner = _owner(devices, channels)
    per_device = enabled_channels(channels).groupBy(*owner).agg(F.count(F.lit(1)).alias("_n"))
    per_fleet = (
        _with(devices, per_device)
        .groupBy("fleet_id")
        .agg(F.count(F.lit(1)).alias("devices"), F.sum(F.coalesce("_n", F.lit(0))).alias("enabled_channels"))
    )
    counted = _with(fleets, per_fleet)
    zero = F.lit(0).cast("bigint")
    enabled = F.coalesce("enabled_channels", zero)
    return counted.select(
        *fleets.columns,
        F.coalesce("devices", zero).alias("devices"),
        enabled.alias("enabled_channels"),
        (enabled * MS_PER_CHANNEL).alias("estimated_cycle_ms"),
        (enabled * MS_PER_CHANNEL > F.col("poll_interval_ms")).alias("too_short"),
    )


def validate_fleet(
    fleets: DataFrame, devices: DataFrame, channels: DataFrame, documents: DataFrame | None = None
) -> DataFrame:
    """Findings of the fleet settings, of its devices (prefixed) and of the fleet as a whole, and with
    `documents` the findings of the documents that the tables come from.

    A fleet without devices passes.
    """
    load = poll_load(fleets, devices, channels)
    count, most = F.col("devices"), F.col("max_concurrent_devices")
    findings = [
        *_ranges(FLEET_RANGES),
        _finding(
            "object",
            "too_many_devices",
            count > most,
            F.concat(
                F.lit("Number of devices ("),
                count,
                F.lit(") exceeds MaxConcurrentDevices ("),
                most,
                F.lit("). This may impact performance."),
            ),
            "Devices",
            "MaxConcurrentDevices",
        ),
        _finding(
            "object",
            "poll_too_short",
            F.col("too_short"),
            F.concat(
                F.lit("Polling interval ("),
                F.col("poll_interval_ms"),
                F.lit("ms) may be too short for "),
                F.col("enabled_channels"),
                F.lit(" channels. Consider increasing to at least "),
                F.col("estimated_cycle_ms"),
                F.lit("ms."),
            ),
            "PollIntervalMs",
        ),
    ]
    own = _report(load, "fleet", findings)
    twice = _report(
        duplicate_keys(devices, ["fleet_id", "device_id"]),
        "fleet",
        [
            _finding(
                "object",
                "duplicate_device",
                F.lit(True),
                F.concat(F.lit("Duplicate device IDs found: "), F.col("device_id")),
                "Devices",
            )
        ],
    ).withColumn("device_id", F.lit(None).cast("string"))
    cascade = validate_devices(devices, channels).withColumn(
        "message", F.concat(F.lit("Device '"), F.coalesce("device_id", F.lit("")), F.lit("': "), F.col("message"))
    )
    found = own.unionByName(twice).unionByName(cascade)
    return found if documents is None else found.unionByName(documents)


def all_violations(fleets: DataFrame, devices: DataFrame, channels: DataFrame) -> DataFrame:
    """Every finding of the three levels once, without the prefixes of the cascades."""
    fleet = validate_fleet(fleets, devices, channels).filter(F.col("level") == "fleet")
    device = validate_devices(devices, channels).filter(F.col("level") == "device")
    return fleet.unionByName(device).unionByName(validate_channels(channels)).distinct()


def service_view(violations: DataFrame) -> DataFrame:
    """Drop the object findings of channels that already have an attribute finding."""
    keys = ["device_id", "channel"]
    stopped = violations.filter((F.col("level") == "channel") & (F.col("stage") == "attribute")).select(*keys).distinct()
    shadowed = stopped.select(*keys, F.lit("channel").alias("level"), F.lit("object").alias("stage"))
    return violations.join(shadowed, [*keys, "level", "stage"], "left_anti").select(*violations.columns)


def config_gate(devices: DataFrame, violations: DataFrame) -> DataFrame:
    """Devices that may run. Any finding of its fleet blocks a device, performance ones included."""
    keys = ["fleet_id"] if "fleet_id" in devices.columns else []
    if not keys:
        return devices.join(violations.select("device_id").distinct(), "device_id", "left_anti")
    owners = devices.select("fleet_id", "device_id").distinct()
    unnamed = violations.filter(F.col("fleet_id").isNull())
    blocked = (
        violations.filter(F.col("fleet_id").isNotNull() | F.col("device_id").isNull())
        .select("fleet_id")
        .union(owners.join(unnamed, "device_id", "left_semi").select("fleet_id"))
        .distinct()
        .withColumnRenamed("fleet_id", "_blocked")
    )
    return devices.join(blocked, F.col("fleet_id").eqNullSafe(F.col("_blocked")), "left_anti").select(*devices.columns)


def require_valid(violations: DataFrame) -> None:
    """Stop the job when there is any finding; only one row is fetched to tell."""
    first = violations.select("message").head(1)
    if first:
        raise ValueError(f"Invalid logger configuration: {first[0]['message']}")
