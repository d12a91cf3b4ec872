"""Streaming forms of the reading pipeline, and ways to run and write streams.

A micro-batch that goes to several places is whole or absent for a reader: every writer puts it into a
folder of its own, and after the last writer one row in a commit table makes it count. A batch that
comes again after a failure replaces its own folders. Results that change are versions in such folders,
never overwritten in place; the reader takes the newest version of each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from countermill.operators.hooks import Rules
from countermill.operators.readings import decode_polls, grade_readings, tag_readings
from countermill.streaming.rates import stream_rate
from countermill.vocab import RATE_WINDOW_SECONDS, SECOND_US

Writer = Callable[[DataFrame, int], None]
#: Take what has arrived and end. {"processingTime": "5 seconds"} keeps a stream running.
ONCE = {"availableNow": True}
COMMIT = "batch long, base boolean, max_us long"


def stream_process(
    polls: DataFrame,
    channels: DataFrame,
    rules: Rules = Rules(),
    window_seconds: int = RATE_WINDOW_SECONDS,
    with_tags: bool = True,
    **rate_options,
) -> DataFrame:
    """Polls to readings on a stream: only the rate keeps state, the rest is row by row."""
    rated = stream_rate(decode_polls(polls, channels, rules), window_seconds, **rate_options)
    graded = grade_readings(rated, rules)
    return tag_readings(graded, channels, rules) if with_tags else graded


# ---------------------------------------------------------------- commits


def commit(spark: SparkSession, log: str, number: int, base: bool = False, max_us: int | None = None) -> None:
    """Make a batch count. The row replaces an earlier one of the same batch, so it can be written again."""
    row = spark.createDataFrame([(number, base, max_us)], COMMIT)
    row.coalesce(1).write.mode("overwrite").parquet(f"{log}/{'base' if base else 'batch'}-{number:012d}")


def commits(spark: SparkSession, log: str) -> DataFrame:
    """(batch, base, max_us) of the batches that count; empty before the first one."""
    try:
        return spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(log)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def newest_base(spark: SparkSession, log: str) -> int:
    """The batch up to which the newest compacted table reaches, -1 without one."""
    found = commits(spark, log).filter("base").agg(F.max("batch")).first()[0]
    return -1 if found is None else found


def committed(spark: SparkSession, path: str, log: str) -> DataFrame:
    """The rows that a writer has put under `path`, of whole batches only, with their number as `batch`."""
    base = newest_base(spark, log)
    counted = commits(spark, log).filter(~F.col("base") & (F.col("batch") > base)).select("batch")
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rows = rows.withColumn("batch", F.col("batch").cast("long"))
    whole = rows.filter(F.col("batch") > base).join(counted, "batch", "left_semi")
    if base < 0:
        return whole
    compacted = spark.read.parquet(f"{path}/base={base}").withColumn("batch", F.lit(base).cast("long"))
    return whole.unionByName(compacted)


# ---------------------------------------------------------------- writers


def batch_writer(path: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> Writer:
    """A writer that keeps each micro-batch in a folder of its own, so a repeat replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def fan_out(
    rows: DataFrame, writers: dict[str, Writer], checkpoint: str, mode: str = "append", trigger: dict = ONCE, log: str | None = None
) -> StreamingQuery:
    """Several subscribers on one stream: each micro-batch is computed once and given to all.

    A batch can come again after a failure, so writers get its number and must be repeatable;
    `batch_writer` is. With `log`, a batch counts once all writers have succeeded, and `committed`
    reads what each of them wrote of such batches only.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        shared = len(writers) > 1
        if shared:
            batch.persist()
        try:
            for write in writers.values():
                write(batch, number)
        finally:
            if shared:
                batch.unpersist()
        if log:
            commit(batch.sparkSession, log, number)

    return (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(deliver)
        .start()
    )


# ---------------------------------------------------------------- results that change


def write_versions(rows: DataFrame, path: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Changed rows of an aggregate, in update mode, as one version per micro-batch. State holds what the
    watermark of `rows` leaves open; nothing written before is touched."""
    return fan_out(rows, {"versions": batch_writer(path)}, checkpoint, "update", trigger, f"{path}/_commits")


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of each key, null keys included, from whole batches only."""
    versions = committed(spark, path, f"{path}/_commits")
    values = [c for c in versions.columns if c not in (*keys, "batch")]
    latest = versions.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_newest"))
    return latest.select(*keys, "_newest.*")


def compact(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Fold all versions so far into one table beside them, which the reader starts from afterwards.

    The new table counts when it is whole, so a reader or a crash at any time finds a complete result;
    the folders it replaces are no longer read and can be removed. Returns the last batch it holds.
    """
    log = f"{path}/_commits"
    upto = commits(spark, log).agg(F.max("batch")).first()[0]
    if upto is None or upto == newest_base(spark, log):
        return -1 if upto is None else upto
    newest(spark, path, keys).write.mode("overwrite").parquet(f"{path}/base={upto}")
    commit(spark, log, upto, base=True)
    return upto


# ---------------------------------------------------------------- late rows


def watermark_us(spark: SparkSession, log: str, delay_us: int, before: int | None = None) -> int | None:
    """The newest time of all committed batches (before one) less the delay; None before the first."""
    rows = commits(spark, log).filter(~F.col("base"))
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    newest_us = rows.agg(F.max("max_us")).first()[0]
    return None if newest_us is None else newest_us - delay_us


def write_windows(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    length_seconds: int,
    partials: dict[str, Column],
    delay_seconds: int,
    keys: list[str] = [],
    trigger: dict = ONCE,
) -> StreamingQuery:
    """Aggregates per tumbling window and key with a side output of late rows; input carries `us`.

    A row is late when its window ended at or before the watermark of the batches before its own. Rows in
    time go into the batch's partial results, late ones as they are into `late`, so that each row of the
    input is in exactly one of both. Rows without a time belong to no window and go to `late` too. No
    state is kept but one commit row per batch.
    """
    log, length = f"{path}/_commits", length_seconds * SECOND_US

    def deliver(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = watermark_us(spark, log, delay_seconds * SECOND_US, number)
        start = F.col("us") - F.pmod("us", F.lit(length))
        in_time = F.coalesce(start + F.lit(length) > F.lit(mark) if mark is not None else F.col("us").isNotNull(), F.lit(False))
        batch = batch.persist()
        try:
            batch_writer(f"{path}/late")(batch.filter(~in_time), number)
            counted = batch.filter(in_time).withColumn("window_us", start)
            totals = counted.groupBy("window_us", *keys).agg(*[c.alias(n) for n, c in partials.items()])
            batch_writer(f"{path}/parts")(totals, number)
            newest_us = batch.agg(F.max("us")).first()[0]
        finally:
            batch.unpersist()
        commit(spark, log, number, max_us=newest_us)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(deliver).start()


def windows(spark: SparkSession, path: str, merges: dict[str, Column], keys: list[str] = []) -> DataFrame:
    """The results of all windows so far, open ones included; `merges` puts partial results together."""
    parts = committed(spark, f"{path}/parts", f"{path}/_commits")
    return parts.groupBy("window_us", *keys).agg(*[c.alias(n) for n, c in merges.items()])


def closed_windows(
    spark: SparkSession, path: str, merges: dict[str, Column], length_seconds: int, delay_seconds: int, keys: list[str] = []
) -> DataFrame:
    """The results of windows that ended at or before the watermark: no row can change them any more."""
    mark = watermark_us(spark, f"{path}/_commits", delay_seconds * SECOND_US)
    ended = F.col("window_us") + F.lit(length_seconds * SECOND_US) <= F.lit(mark).cast("long")
    return windows(spark, path, merges, keys).filter(ended)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came after their window had ended, as they were read."""
    return committed(spark, f"{path}/late", f"{path}/_commits").drop("batch")


# ---------------------------------------------------------------- running


def write_stream(
    rows: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict = ONCE
) -> StreamingQuery:
    """A stream as files: by default everything that has arrived so far, and then the query ends.

    Append uses the file sink. In update mode each micro-batch is a version, see `newest`; in complete
    mode it is a whole result, see `whole_result`.
    """
    if mode == "append":
        return (
            rows.writeStream.outputMode("append")
            .format("parquet")
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start(path)
        )
    return fan_out(rows, {"files": batch_writer(path)}, checkpoint, mode, trigger, f"{path}/_commits")


def whole_result(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete result that is whole; a failed batch leaves the one before it."""
    number = commits(spark, f"{path}/_commits").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{path}/batch={number}")


def replay(rows: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what has arrived and read its output back as a table. With `keys`, the output in
    update mode is versions of an aggregate and the newest of each key is read."""
    spark, out = rows.sparkSession, f"{folder}/out"
    write_stream(rows, out, f"{folder}/checkpoint", mode).awaitTermination()
    if mode == "append":
        return spark.read.parquet(out)
    if mode == "complete":
        return whole_result(spark, out)
    return newest(spark, out, keys) if keys else committed(spark, out, f"{out}/_commits").drop("batch")
