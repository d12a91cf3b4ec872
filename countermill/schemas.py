"""Row shapes of the data model."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


_S, _I, _L, _D, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)
TAGS = T.MapType(_S, _S)

# One stored register poll; `seq` is the arrival order.
REGISTER_LOG = _struct(
    ("device_id", _S, False),
    ("channel", _I, False),
    ("registers", T.ArrayType(_I)),
    ("ts", _TS, False),
    ("success", _B, False),
    ("acquisition_us", _L),
    ("error", _S),
    ("seq", _L, False),
)

CHANNELS = _struct(
    ("device_id", _S, False),
    ("channel", _I, False),
    ("name", _S),
    ("description", _S),
    ("enabled", _B),
    ("start_register", _I),
    ("register_count", _I),
    ("scale_factor", _D),
    ("offset", _D),
    ("unit", _S),
    ("decimal_places", _I),
    ("min_value", _L),
    ("max_value", _L),
    ("max_rate_of_change", _D),
    ("overflow_threshold", _L),
    ("overflow_check", _B),
    ("tags", TAGS),
)

DEVICES = _struct(
    ("device_id", _S, False),
    ("ip_address", _S),
    ("port", _I),
    ("unit_id", _I),
    ("timeout_ms", _I),
    ("max_retries", _I),
    ("retry_delay_ms", _I),
    ("receive_buffer_size", _I),
    ("send_buffer_size", _I),
    ("rate_window_seconds", _I),
    ("overflow_threshold", _L),
    ("keep_alive", _B),
    ("enable_nagle", _B),
    ("enable_rate_calculation", _B),
    ("enable_data_validation", _B),
    ("tags", TAGS),
)

FLEETS = _struct(
    ("fleet_id", _S, False),
    ("poll_interval_ms", _I),
    ("health_check_interval_ms", _I),
    ("max_concurrent_devices", _I),
    ("data_buffer_size", _I),
    ("batch_size", _I),
    ("batch_timeout_ms", _I),
    ("max_consecutive_failures", _I),
    ("device_timeout_minutes", _I),
)

READING = _struct(
    ("device_id", _S, False),
    ("channel", _I, False),
    ("seq", _L),
    ("ts", _TS),
    ("raw_value", _L),
    ("processed_value", _D),
    ("rate", _D),
    ("quality", _I),
    ("quality_name", _S),
    ("unit", _S),
    ("acquisition_us", _L),
    ("tags", TAGS),
    ("error_message", _S),
)

# Input of the health fold; kind is one of start, add, update, remove, stop, read, probe.
HEALTH_EVENTS = _struct(
    ("device_id", _S, False),
    ("ts", _TS, False),
    ("seq", _L, False),
    ("kind", _S, False),
    ("success", _B),
    ("error", _S),
)

HEALTH = _struct(
    ("device_id", _S, False),
    ("ts", _TS),
    ("seq", _L),
    ("kind", _S),
    ("status", _I),
    ("status_name", _S),
    ("is_connected", _B),
    ("last_successful_read_us", _L),
    ("consecutive_failures", _L),
    ("communication_latency", _D),
    ("last_error", _S),
    ("total_reads", _L),
    ("successful_reads", _L),
    ("success_rate", _D),
)

# One finding of the configuration rules.
VIOLATION = _struct(
    ("level", _S),
    ("stage", _S),
    ("fleet_id", _S),
    ("device_id", _S),
    ("channel", _I),
    ("rule", _S),
    ("message", _S),
    ("members", T.ArrayType(_S)),
)

# The nested JSON document of device settings.
DEVICE_CONFIG_JSON = _struct(
    ("DeviceId", _S),
    ("IpAddress", _S),
    ("Port", _I),
    ("UnitId", _I),
    ("TimeoutMs", _I),
    ("MaxRetries", _I),
    ("RetryDelayMs", _I),
    ("ReceiveBufferSize", _I),
    ("SendBufferSize", _I),
    ("KeepAlive", _B),
    ("EnableNagle", _B),
    ("EnableRateCalculation", _B),
    ("RateWindowSeconds", _I),
    ("EnableDataValidation", _B),
    ("OverflowThreshold", _L),
    ("Tags", TAGS),
    (
        "Channels",
        T.ArrayType(
            _struct(
                ("ChannelNumber", _I),
                ("Name", _S),
                ("Description", _S),
                ("Enabled", _B),
                ("StartRegister", _I),
                ("RegisterCount", _I),
                ("ScaleFactor", _D),
                ("Offset", _D),
                ("Unit", _S),
                ("DecimalPlaces", _I),
                ("MinValue", _L),
                ("MaxValue", _L),
                ("MaxRateOfChange", _D),
                ("Tags", TAGS),
            )
        ),
    ),
)

FLEET_CONFIG_JSON = _struct(
    ("FleetId", _S),
    ("PollIntervalMs", _I),
    ("HealthCheckIntervalMs", _I),
    ("MaxConcurrentDevices", _I),
    ("DataBufferSize", _I),
    ("BatchSize", _I),
    ("BatchTimeoutMs", _I),
    ("MaxConsecutiveFailures", _I),
    ("DeviceTimeoutMinutes", _I),
    ("Devices", T.ArrayType(DEVICE_CONFIG_JSON)),
)
