from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from countermill.operators import rollups
from countermill.operators.rates import counter_rate
from countermill.operators.readings import process_readings
from countermill.schemas import REGISTER_LOG
from countermill.sources.polls import read_register_log, stream_register_log
from countermill.streaming.health import stream_health
from countermill.streaming.delivery import (
    batch_writer,
    closed_windows,
    commits,
    committed,
    compact,
    fan_out,
    late_rows,
    newest,
    replay,
    stream_process,
    windows,
    write_stream,
    write_versions,
    write_windows,
)
from countermill.streaming.rates import stream_rate
from test_config import channel_rows
from test_health import SCHEMA as EVENT_SCHEMA
from test_health import fold, random_events, rows_of
from test_rates import BASE, SECOND_US
from test_rates import SCHEMA as POINT_SCHEMA


def in_files(spark, rows, schema, folder, parts=4):
    """Rows in time order, split over files that a stream reads one after the other."""
    rows = sorted(rows, key=lambda r: (r[2], r[3]) if schema == POINT_SCHEMA else (r[1], r[2]))
    size = -(-len(rows) // parts)
    for n in range(parts):
        part = rows[n * size : (n + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


@pytest.mark.parametrize("wrap, slices", [("compat", None), (None, 7), ("compat", 30)])
def test_rate_over_batches_equals_batch(spark, tmp_path, wrap, slices):
    """Slices wider than, as wide as and narrower than the window."""
    rng = random.Random(7)
    rows, seq = [], 0
    for device, size in [("hot", 300), ("a", 40)]:
        us = BASE * SECOND_US
        for _ in range(size):
            us += rng.choice([0, 500_000, SECOND_US, 20 * SECOND_US])
            rows.append((device, rng.randrange(2), us, seq, rng.randrange(4294967296)))
            seq += 1
    stream = in_files(spark, rows, POINT_SCHEMA, str(tmp_path / "in"))
    got = replay(stream_rate(stream, 30, wrap=wrap, gate=None, slice_seconds=slices), str(tmp_path / "run"))
    want = counter_rate(spark.createDataFrame(rows, POINT_SCHEMA), 30, wrap=wrap)
    columns = ["device_id", "channel", "us", "seq", "raw_value", "rate"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


@pytest.mark.parametrize("present", [True, False])
def test_health_over_batches_equals_fold(spark, tmp_path, present):
    events = random_events(5, ["read"] * 6 + ["probe", "add", "remove", "update", "stop", "start"])
    stream = in_files(spark, events, EVENT_SCHEMA, str(tmp_path / "in"))
    start = 0 if present else None
    got = replay(stream_health(stream, present, start), str(tmp_path / "run"), "update")
    assert rows_of(got) == fold(events, start, present)


def test_process_equals_batch(spark, tmp_path):
    polls = spark.range(200).select(
        F.lit("D").alias("device_id"),
        (F.col("id") % 2).cast("int").alias("channel"),
        F.when(F.col("id") % 9 != 0, F.array((F.col("id") * 7).cast("int"), F.lit(1))).alias("registers"),
        F.timestamp_micros(F.lit(BASE * SECOND_US) + F.col("id") * SECOND_US).alias("ts"),
        (F.col("id") % 9 != 0).alias("success"),
        F.lit(1000).cast("bigint").alias("acquisition_us"),
        F.lit(None).cast("string").alias("error"),
        F.col("id").alias("seq"),
    )
    folder = str(tmp_path / "polls")
    polls.orderBy("seq").coalesce(1).write.option("maxRecordsPerFile", 60).parquet(folder)
    channels = channel_rows(spark, {}, {"max_value": 65600})
    stream = stream_register_log(spark, folder, files_per_batch=1)
    got = replay(stream_process(stream, channels, window_seconds=20), str(tmp_path / "run"))
    want = process_readings(read_register_log(spark, folder, schema=REGISTER_LOG), channels, window_seconds=20)
    columns = ["channel", "seq", "raw_value", "processed_value", "rate", "quality_name", "tags"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def ticks(spark, folder, n=100):
    rows = spark.range(n).select(
        F.timestamp_micros(F.lit(BASE * SECOND_US) + F.col("id") * 500_000).alias("ts"),
        (F.lit(BASE * SECOND_US) + F.col("id") * 500_000).alias("us"),
        F.col("id").alias("seq"),
        (F.col("id") % 3).alias("k"),
    )
    rows.coalesce(1).write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def test_windows_on_a_stream(spark, tmp_path):
    stream = ticks(spark, str(tmp_path / "in"))
    latest = replay(rollups.sample_latest(stream, "1 second"), str(tmp_path / "a"), "complete")
    assert sorted(r["seq"] for r in latest.collect()) == list(range(1, 100, 2))
    per_key = replay(rollups.sample_latest(stream, "10 seconds", ["k"]), str(tmp_path / "b"), "complete")
    assert per_key.count() == 15
    sizes = replay(rollups.non_empty_batches(stream, "10 seconds"), str(tmp_path / "c"), "complete")
    assert [r["readings"] for r in sizes.collect()] == [20] * 5
    buffers = replay(rollups.tumbling_buffer(stream, "5 seconds"), str(tmp_path / "d"))
    assert buffers.groupBy("window_start").count().select("count").distinct().collect()[0][0] == 10


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_rate_state_is_bounded(spark, tmp_path):
    """Twenty slices of a hot series come and go; one or two are in state at a time."""
    rows = [("hot", 0, (BASE + n) * SECOND_US, n, n * 5) for n in range(2000)]
    stream = in_files(spark, rows, POINT_SCHEMA, str(tmp_path / "in"), parts=10)
    rated = stream_rate(stream, 25, gate=None, lateness_seconds=0, slice_seconds=100)
    query = write_stream(rated, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2000
    assert max(state_rows(query)) <= 5


def test_many_quiet_series_share_state(spark, tmp_path):
    """State and calls go by bucket, not by series; results stay those of each series, also of null keys."""
    schema = "device_id string, channel int, us long, seq long, raw_value long"
    n = F.col("id")
    rows = spark.range(9000).select(
        F.when(n % 3000 != 5, F.concat(F.lit("d"), n % 3000)).alias("device_id"),
        F.when(n % 7 != 3, (n % 3000 % 2).cast("int")).alias("channel"),
        (F.lit(BASE * SECOND_US) + n * 10_000).alias("us"),
        n.alias("seq"),
        (n * n % 1_000_003).alias("raw_value"),
    )
    for at in range(3):
        rows.filter(F.floor(n / 3000) == at).coalesce(1).write.parquet(str(tmp_path / f"in/{at}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = write_stream(stream_rate(stream, 40, gate=None), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert max(state_rows(query)) <= 2 * 1024  # two slices; 3,000 series
    got, want = spark.read.parquet(str(tmp_path / "out")), counter_rate(rows, 40)
    columns = ["device_id", "channel", "us", "seq", "raw_value", "rate"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert got.filter("rate is not null").count() > 3000


def test_odd_rows_of_a_rate_stream(spark, tmp_path):
    """Rows without a time, value or key stay; late ones within the allowance are rated, older ones left out."""
    first = [("a", 0, 100 * SECOND_US, 1, 10), ("a", 0, None, 2, 5), (None, None, 100 * SECOND_US, 3, 7), ("a", 0, 130 * SECOND_US, 4, None)]
    second = [("a", 0, 110 * SECOND_US, 5, 60), (None, None, 105 * SECOND_US, 6, 17), ("b", 0, 20 * SECOND_US, 7, 1)]
    schema = "device_id string, channel int, us long, seq long, raw_value long"
    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got = replay(stream_rate(stream, 60, gate="raw_value", lateness_seconds=40), str(tmp_path / "run"))
    assert sorted((r.seq, r.rate) for r in got.collect()) == [(1, None), (2, None), (3, None), (4, None), (5, 5.0), (6, 2.0)]


def test_removed_devices_leave_no_state(spark, tmp_path):
    kinds = ["add", "read", "remove"]
    events = [(f"d{n}", 100 * n + k, 3 * n + k, kind, True, None) for n in range(50) for k, kind in enumerate(kinds)]
    events.append(("stays", 10_000, 200, "add", None, None))
    stream = in_files(spark, events, EVENT_SCHEMA, str(tmp_path / "in"), parts=5)
    query = write_stream(stream_health(stream, False), str(tmp_path / "out"), str(tmp_path / "checkpoint"), "update")
    query.awaitTermination()
    assert committed(spark, str(tmp_path / "out"), str(tmp_path / "out/_commits")).count() == 151
    assert max(state_rows(query)) <= 2


def test_health_events_without_device_or_time(spark, tmp_path):
    events = [("a", 10, 1, "read", True, None), (None, 20, 2, "read", False, "e"), ("a", None, 3, "read", True, None), (None, 30, 4, "read", None, None)]
    spark.createDataFrame(events, EVENT_SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT_SCHEMA).parquet(str(tmp_path / "in"))
    got = replay(stream_health(stream, start_us=0), str(tmp_path / "run"), "update")
    assert sorted((r.seq, r.device_id, r.consecutive_failures, r.total_reads) for r in got.collect()) == [(1, "a", 0, 1), (2, None, 1, 1), (4, None, 2, 2)]


def halves(spark, folder, n=90):
    rows = spark.range(n).select(
        F.timestamp_micros(F.lit(BASE * SECOND_US) + F.col("id") * 500_000).alias("ts"),
        (F.lit(BASE * SECOND_US) + F.col("id") * 500_000).alias("us"),
        F.when(F.col("id") % 4 != 0, F.col("id") % 4).alias("k"),
    )
    rows.orderBy("us").coalesce(1).write.option("maxRecordsPerFile", 30).parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_versions_over_batches(spark, tmp_path):
    """Three micro-batches: the newest version of each window and key, before and after compaction."""
    path = str(tmp_path / "out")
    keys = ["window_start", "window_end", "k"]
    counts = rollups.tumbling_window(
        rollups.late_data(halves(spark, str(tmp_path / "in")), "5 seconds"), [F.count(F.lit(1)).alias("n")], "10 seconds", ["k"]
    )
    write_versions(counts, path, str(tmp_path / "checkpoint")).awaitTermination()
    want = spark.read.parquet(str(tmp_path / "in")).groupBy(F.window("ts", "10 seconds").alias("w"), "k").count()
    expected = sorted(map(str, want.select("w.start", "k", "count").collect()))

    def rows():
        found = newest(spark, path, keys)
        return sorted(map(str, found.select(F.col("window_start").alias("start"), "k", F.col("n").alias("count")).collect()))

    assert rows() == expected
    versions = spark.read.parquet(f"{path}/batch=*").count()
    assert versions > len(expected)
    assert compact(spark, path, keys) >= 2
    assert rows() == expected
    assert committed(spark, path, f"{path}/_commits").count() == len(expected)
    assert compact(spark, path, keys) >= 2


def test_a_failed_batch_leaves_the_whole_result_before_it(spark, tmp_path):
    sizes = rollups.non_empty_batches(halves(spark, str(tmp_path / "in")), "10 seconds")
    got = replay(sizes, str(tmp_path / "run"), "complete")
    assert sorted(r["readings"] for r in got.collect()) == [10, 20, 20, 20, 20]
    # A later batch that was written and never committed does not count.
    spark.range(1).write.parquet(str(tmp_path / "run/out/batch=99"))
    again = replay(sizes, str(tmp_path / "run"), "complete")
    assert sorted(r["readings"] for r in again.collect()) == [10, 20, 20, 20, 20]


def test_a_writer_that_fails_once(spark, tmp_path):
    """Readers see no part of the failed batch, and after the restart every batch once."""
    log, failed = str(tmp_path / "log"), []
    first, second = batch_writer(str(tmp_path / "first")), batch_writer(str(tmp_path / "second"))

    def fails_once(batch, number):
        if number == 1 and not failed:
            failed.append(number)
            raise OSError("disk full")
        second(batch, number)

    stream = halves(spark, str(tmp_path / "in"))
    writers = {"first": first, "second": fails_once}
    with pytest.raises(Exception, match="disk full"):
        fan_out(stream, writers, str(tmp_path / "checkpoint"), log=log).awaitTermination()
    assert failed == [1]
    for name in writers:
        assert committed(spark, str(tmp_path / name), log).count() == 30
    assert spark.read.parquet(str(tmp_path / "first")).count() == 60
    fan_out(stream, writers, str(tmp_path / "checkpoint"), log=log).awaitTermination()
    for name in writers:
        rows = committed(spark, str(tmp_path / name), log)
        assert rows.count() == 90 and rows.select("us").distinct().count() == 90
    assert sorted(r.batch for r in commits(spark, log).collect()) == [0, 1, 2]


def test_late_rows_and_closed_windows_add_up(spark, tmp_path):
    """In four batches, each row is in a window result or in the late rows, never in both."""
    rng = random.Random(8)
    at = [[100 * n + rng.randrange(-120, 100) for _ in range(200)] for n in range(4)]
    for n, seconds in enumerate(at):
        rows = [(f"d{i % 3}", (BASE + s) * SECOND_US, i) for i, s in enumerate(seconds)] + [("d0", None, -1)]
        spark.createDataFrame(rows, "device_id string, us long, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("device_id string, us long, seq long").parquet(str(tmp_path / "in"))
        partials = {"n": F.count(F.lit(1)), "top": F.max("seq")}
        write_windows(stream, str(tmp_path / "out"), str(tmp_path / "run"), 30, partials, 20, ["device_id"]).awaitTermination()
    path, merges = str(tmp_path / "out"), {"n": F.sum("n"), "top": F.max("top")}
    closed = closed_windows(spark, path, merges, 30, 20, ["device_id"])
    late = late_rows(spark, path)

    mark, kept, left = None, {}, 0
    for seconds in at:
        for i, s in enumerate(seconds):
            start = (BASE + s) // 30 * 30
            if mark is not None and start + 30 <= mark:
                left += 1
            else:
                kept.setdefault((start, f"d{i % 3}"), []).append(i)
        mark = max([BASE + s for s in seconds] + [mark + 20 if mark else 0]) - 20
    assert late.filter("us is not null").count() == left > 0
    assert late.filter("us is null").count() == 4
    assert windows(spark, path, merges, ["device_id"]).agg(F.sum("n")).first()[0] + late.count() == 804
    want = {(w, d): (len(v), max(v)) for (w, d), v in kept.items() if w + 30 <= mark}
    assert {(r.window_us // SECOND_US, r.device_id): (r.n, r.top) for r in closed.collect()} == want


def test_watermark_closes_windows(spark, tmp_path):
    late = rollups.late_data(ticks(spark, str(tmp_path / "in")), "5 seconds")
    hours = rollups.tumbling_window(late, [F.count(F.lit(1)).alias("n")], "10 seconds")
    assert [r["n"] for r in replay(hours, str(tmp_path / "run")).collect()] == [20] * 4


def test_fan_out_is_repeatable(spark, tmp_path):
    stream = ticks(spark, str(tmp_path / "in"))
    writers = {"all": batch_writer(str(tmp_path / "all")), "odd": batch_writer(str(tmp_path / "odd"), lambda df: df.filter("seq % 2 = 1"))}
    for run in ("first", "again"):
        fan_out(stream, writers, str(tmp_path / run)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "all")).count() == 100
    assert spark.read.parquet(str(tmp_path / "odd")).count() == 50
