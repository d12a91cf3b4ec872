"""Counter telemetry on Spark: decode, rate, grade, tag and roll up stored register polls."""

__version__ = "0.1.0"
