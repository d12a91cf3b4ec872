"""Enum codes, limits and names that results must agree on."""

# Quality codes of a reading.
QUALITY = {
    "Good": 0,
    "Uncertain": 1,
    "Bad": 2,
    "Timeout": 3,
    "DeviceFailure": 4,
    "ConfigurationError": 5,
    "Overflow": 6,
}

# Status codes of a device.
STATUS = {
    "Online": 0,
    "Warning": 1,
    "Error": 2,
    "Offline": 3,
    "Unknown": 4,
}

# Counter arithmetic.
WORD_BITS = 16
UINT32_MAX = 4294967295
OVERFLOW_THRESHOLD = 4294000000
NEAR_OVERFLOW = 4294967000

# Rate windows of the two pipelines, in seconds.
RATE_WINDOW_SECONDS = 300
OPEN_RATE_WINDOW_SECONDS = 60

# Alert and planning limits.
CV_LIMIT = 0.3
HIGH_RATE = 500
MS_PER_CHANNEL = 50

# Tags that every reading carries.
DATA_SOURCE = "adam_logger"
DEVICE_TYPE = "adam_6051"
AUDIT_SOURCE = "ADAM_Logger"
TOPIC_PREFIX = "adam.data"
POINT_MEASUREMENT = "counter_data"

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US
