"""Stored register polls as tables and streams.

A record that cannot be a poll is no row of NULLs: it is left out of the polls and kept, with the
reason, among the rejected records. Batch and stream judge alike, and every record is in exactly one
of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countermill.operators.readings import with_micros
from countermill.schemas import REGISTER_LOG
from countermill.session import require_utc

#: Holds the text of a record that a text format could not read; such a format is asked for it.
CORRUPT = "_corrupt_record"
TEXT_FORMATS = ("json", "csv")


def _reader_schema(schema: T.StructType, fmt: str) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]) if fmt in TEXT_FORMATS else schema


def judged(raw: DataFrame, mapping: dict[str, Column] | None = None) -> DataFrame:
    """Records in the shape of polls with `reason`: NULL for a poll, else why it is none.

    `corrupt_record`: its text could not be read. `no_device`, `no_channel`, `no_time`: a poll without
    them belongs to no series. Reasons are tried in this order. `record` is the text of a rejected one.
    """
    corrupt = F.col(CORRUPT) if CORRUPT in raw.columns else F.lit(None).cast("string")
    columns = {c: F.col(c) for c in raw.columns if c != CORRUPT} if mapping is None else mapping
    rows = raw.select(*[c.alias(n) for n, c in columns.items()], corrupt.alias(CORRUPT))
    rows = with_micros(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("corrupt_record"))
    for column, code in (("device_id", "no_device"), ("channel", "no_channel"), ("us", "no_time")):
        if column in rows.columns:
            reason = reason.when(F.col(column).isNull(), F.lit(code))
    own = F.to_json(F.struct(*[c for c in rows.columns if c not in (CORRUPT, "us")]))
    return rows.select(
        *[c for c in rows.columns if c != CORRUPT],
        reason.alias("reason"),
        F.when(reason.isNotNull(), F.coalesce(CORRUPT, own)).alias("record"),
    )


def accepted(judged_rows: DataFrame) -> DataFrame:
    return judged_rows.filter(F.col("reason").isNull()).drop("reason", "record")


def rejected(judged_rows: DataFrame) -> DataFrame:
    """The rejected records: reason, and the record as text."""
    return judged_rows.filter(F.col("reason").isNotNull()).select("reason", "record")


def judged_register_log(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    mapping: dict[str, Column] | None = None,
) -> DataFrame:
    """Records from files with the reason why one is no poll. `mapping` builds the poll columns from a
    table of another shape."""
    require_utc(spark)
    return judged(spark.read.schema(_reader_schema(schema or REGISTER_LOG, fmt)).format(fmt).load(path), mapping)


def judged_register_stream(
    spark: SparkSession,
    folder: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    mapping: dict[str, Column] | None = None,
    files_per_batch: int = 64,
) -> DataFrame:
    """The same as a stream; `files_per_batch` bounds the rows of a micro-batch."""
    require_utc(spark)
    reader = spark.readStream.schema(_reader_schema(schema or REGISTER_LOG, fmt)).option("maxFilesPerTrigger", files_per_batch)
    return judged(reader.format(fmt).load(folder), mapping)


def read_register_log(spark: SparkSession, path: str, *args, **options) -> DataFrame:
    """Polls from files; what is no poll is in `rejected(judged_register_log(...))` of the same arguments."""
    return accepted(judged_register_log(spark, path, *args, **options))


def stream_register_log(spark: SparkSession, folder: str, *args, **options) -> DataFrame:
    """Polls as a stream; what is no poll is in `rejected(judged_register_stream(...))` of the same arguments."""
    return accepted(judged_register_stream(spark, folder, *args, **options))
