from __future__ import annotations

import datetime
import json
import random

import pandas as pd
from pyspark.sql import functions as F

from countermill.operators import filters, rollups
from countermill.operators.hooks import custom_transformer, custom_validator
from countermill.operators.readings import process_readings, read_and_log, read_and_log_fleet
from countermill.schemas import REGISTER_LOG
from countermill.sources import sinks
from countermill.sources.polls import (
    accepted,
    judged_register_log,
    judged_register_stream,
    read_register_log,
    rejected,
)
from countermill.streaming.delivery import replay
from test_config import channel_rows

T0 = datetime.datetime(2024, 5, 1, 12, tzinfo=datetime.UTC)


def poll_rows(spark, *polls):
    rows = []
    for n, (seconds, registers, *rest) in enumerate(polls):
        ok = registers is not None
        row = ("D", 0, registers, T0 + datetime.timedelta(seconds=seconds), ok, 5000, None if ok else "lost", n)
        rows.append(row if not rest else ("D", rest[0], *row[2:]))
    return spark.createDataFrame(rows, REGISTER_LOG)


def test_pipeline(spark):
    polls = poll_rows(spark, (0, [1000]), (10, [1100]), (20, None), (30, []), (40, [1400]), (41, [9], 7))
    rows = process_readings(polls, channel_rows(spark, {"tags": {"sensor_type": "counter"}})).orderBy("seq").collect()
    assert [(r["seq"], r["raw_value"], r["rate"], r["quality_name"]) for r in rows] == [
        (0, 1000, None, "Good"),
        (1, 1100, 10.0, "Good"),
        (3, 0, None, "ConfigurationError"),
        (4, 1400, 10.0, "Good"),
    ]
    good, bad = rows[1], rows[2]
    assert (good["processed_value"], good["unit"], good["acquisition_us"]) == (1100.0, "counts", 5000)
    assert good["tags"]["data_source"] == "adam_logger" and good["tags"]["sensor_type"] == "counter"
    assert not any(k.startswith("device_") and k != "device_type" for k in good["tags"])
    assert bad["error_message"] == "no register words" and bad["tags"] == {} and bad["processed_value"] is None


def test_disabled_channel_is_not_read(spark):
    assert process_readings(poll_rows(spark, (0, [1])), channel_rows(spark, {"enabled": False})).count() == 0


def test_null_transform_keeps_the_row_without_rate(spark):
    rules = custom_transformer(lambda c: F.lit(None).cast("double"))
    rows = process_readings(poll_rows(spark, (0, [1000]), (10, [1100])), channel_rows(spark, {}), rules).collect()
    assert [(r["processed_value"], r["rate"]) for r in rows] == [(None, None)] * 2


def test_vectorised_custom_rules(spark):
    @F.pandas_udf("double")
    def doubled(raw: pd.Series) -> pd.Series:
        return raw * 2.0

    @F.pandas_udf("int")
    def suspicious(raw: pd.Series) -> pd.Series:
        return (raw > 1050).astype("int32")

    rules = custom_validator(lambda c: suspicious(c("raw_value")))
    rules = custom_transformer(lambda c: doubled(c("raw_value")), base=rules)
    rows = process_readings(poll_rows(spark, (0, [1000]), (10, [1100])), channel_rows(spark, {}), rules).orderBy("seq").collect()
    assert [(r["processed_value"], r["quality"]) for r in rows] == [(2000.0, 0), (2200.0, 1)]


def test_register_log_files(spark, tmp_path):
    poll_rows(spark, (0, [1, 2]), (5, None)).write.json(str(tmp_path / "log"))
    got = read_register_log(spark, str(tmp_path / "log"), fmt="json").orderBy("seq").collect()
    assert [(r["registers"], r["success"]) for r in got] == [([1, 2], True), (None, False)]
    assert got[1]["us"] - got[0]["us"] == 5_000_000


def test_rejected_and_accepted_add_up(spark, tmp_path):
    """Corrupt JSON, wrong types, no device, no channel, no time: batch and stream alike."""
    good = {"device_id": "d", "channel": 1, "registers": [7], "ts": "2024-01-01T00:00:00Z", "success": True, "seq": 1}
    lines = [json.dumps(good | change) for change in ({}, {"seq": 2, "device_id": None}, {"channel": None}, {"ts": None}, {"channel": "x"})]
    lines += [json.dumps(good)[:-9], "", "no json at all"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/polls.json").write_text("\n".join(lines) + "\n")
    found = judged_register_log(spark, str(tmp_path / "in"), "json")
    assert accepted(found).count() == 1 and accepted(found).columns == read_register_log(spark, str(tmp_path / "in"), "json").columns
    reasons = sorted(r.reason for r in rejected(found).collect())
    assert reasons == ["corrupt_record"] * 3 + ["no_channel", "no_device", "no_time"]
    assert {json.loads(r.record).get("seq") for r in rejected(found).filter("reason = 'no_device'").collect()} == {2}
    stream = judged_register_stream(spark, str(tmp_path / "in"), "json")
    again = replay(rejected(stream), str(tmp_path / "run"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rejected(found).collect()))


def test_every_device_has_its_own_window(spark):
    """Three windows, a device without rates and one without settings, against each row's own scan."""
    rng = random.Random(3)
    settings = {"a": (30, 900, True), "b": (7200, 500, True), "c": (100_000, 700, True), "n": (60, 10, False), "z": (None, 10, True)}
    rows, seq = [], 0
    for device in (*settings, "other"):
        us = 0
        for _ in range(120):
            us += rng.choice([0, 1, 29, 30, 31, 5000]) * 1_000_000
            rows.append((device, us, [rng.randrange(1000), 0, rng.randrange(1000), 0][: rng.choice([4, 4, 2])], seq))
            seq += 1
    blocks = spark.createDataFrame(rows, "device_id string, us long, registers array<int>, seq long")
    table = spark.createDataFrame(
        [(d, [0, 1], *s) for d, s in settings.items()],
        "device_id string, channels array<int>, rate_window int, overflow_threshold long, calculate_rate boolean",
    )
    got = {(r.channel, r.seq): (r["count"], r.rate, r.near_overflow) for r in read_and_log_fleet(blocks, table).collect()}
    want = {}
    for channel in (0, 1):
        for device, (window, most, wanted) in settings.items():
            points = [(us, n, regs[2 * channel]) for d, us, regs, n in rows if d == device and len(regs) > 2 * channel]
            for us, n, count in points:
                rate = None
                if wanted and window:
                    old = min(p for p in points if us - window * 1_000_000 < p[0] <= us)
                    rate = (count - old[2]) / ((us - old[0]) / 1e6) if us > old[0] else None
                want[channel, n] = (count, rate, count > most)
    assert got == want


def test_script_pipeline_and_points(spark):
    blocks = spark.createDataFrame(
        [
            ("D", T0, 0, [10, 0, 1, 1, 5]),
            ("D", T0 + datetime.timedelta(seconds=10), 1, [40, 0, 65535, 65535]),
            ("D", T0 + datetime.timedelta(microseconds=20_500_000), 2, None),
        ],
        "device_id string, ts timestamp, seq bigint, registers array<int>",
    )
    rows = read_and_log(blocks, [0, 1, 2]).orderBy("seq", "channel")
    assert [(r["channel"], r["count"], r["rate"], r["near_overflow"]) for r in rows.collect()] == [
        (0, 10, None, False),
        (1, 65537, None, False),
        (0, 40, 3.0, False),
        (1, 4294967295, (4294967295 - 65537) / 10, True),
    ]
    assert {r["rate"] for r in read_and_log(blocks, calculate_rate=False).collect()} == {None}
    points = sinks.to_points(rows, F.lit("ADAM-6051"), F.lit("hall"))
    texts = [json.loads(r["value"]) for r in sinks.point_json(points).collect()]
    assert {"measurement": "counter_data", "tags": {"device": "ADAM-6051", "location": "hall", "channel": "0"},
            "time": "2024-05-01T12:00:00+00:00", "fields": {"count": 10}} in texts
    assert any(t["fields"] == {"count": 40, "rate": 3.0} for t in texts)


def test_point_files(spark, tmp_path):
    readings = spark.createDataFrame([("D", 1, 1700000000000000, 5, 1.5)], "device_id string, channel int, us bigint, count bigint, rate double")
    points = sinks.to_points(readings, F.col("device_id"), F.lit("hall"))
    for layout in [("date",), ("device", "date")]:
        path = str(tmp_path / "-".join(layout))
        sinks.write_points(points, path, partition_by=layout)
        sinks.write_points(points, path, partition_by=layout)
        back = spark.read.parquet(path).collect()
        assert len(back) == 2 and back[0]["fields"]["count"] == 5 and str(back[0]["date"]) == "2023-11-14"


def test_messages_and_audit(spark):
    rows = process_readings(poll_rows(spark, (0, [1000]), (0.5, [])), channel_rows(spark, {}), with_tags=False)
    got = {r["value"] for r in sinks.to_messages(rows).collect()}
    first = next(json.loads(v) for v in got if json.loads(v)["Quality"] == 0)
    assert first == {
        "DeviceId": "D",
        "Channel": 0,
        "RawValue": 1000,
        "ProcessedValue": 1000.0,
        "Timestamp": "2024-05-01T12:00:00+00:00",
        "Quality": 0,
        "Rate": None,
    }
    assert any(json.loads(v)["Timestamp"] == "2024-05-01T12:00:00.5+00:00" for v in got)
    assert {r["topic"] for r in sinks.to_messages(rows).collect()} == {"adam.data.D.0"}
    audit = sinks.audit_trail(rows, "me", None).collect()
    assert [(r["Value"], r["Source"], r["UserId"], r["BatchId"]) for r in audit] == [(1000.0, "ADAM_Logger", "me", None)]


def test_reading_filters(spark):
    rows = spark.createDataFrame(
        [("A", 501.0, 0, {"line": "x"}), ("A", 500.0, 1, {}), ("B", 900.0, 0, {}), ("B", None, 0, None)],
        "device_id string, rate double, quality int, tags map<string,string>",
    )
    assert [r["rate"] for r in filters.high_rate_alerts(rows, "A").collect()] == [501.0]
    assert filters.high_rate_alerts(rows).count() == 2
    assert (filters.good_readings(rows).count(), filters.has_tag(rows, "line").count()) == (3, 1)


def test_rollups(spark):
    rows = spark.createDataFrame(
        [("A", 0, T0, 1, 10.0, 4000), ("A", 0, T0 + datetime.timedelta(seconds=3), 2, 30.0, 6000), ("B", 0, T0 + datetime.timedelta(hours=1), 3, None, 8000)],
        "device_id string, channel int, ts timestamp, seq bigint, rate double, acquisition_us bigint",
    ).withColumn("us", F.unix_micros("ts"))
    cv = {r["device_id"]: r for r in rollups.rate_variability(rows).collect()}
    assert cv["A"]["cv"] == 0.5 and cv["A"]["needs_inspection"] is True
    assert cv["B"]["cv"] is None and cv["B"]["needs_inspection"] is False
    minutes = rollups.throughput_latency(rows).orderBy("window_start").collect()
    assert [(r["readings"], r["avg_latency_ms"]) for r in minutes] == [(2, 5.0), (1, 8.0)]
    gaps = rollups.poll_gaps(rows, 2000).collect()
    assert [(r["seq"], r["gap_us"]) for r in gaps] == [(2, 3_000_000)]
    cycles = rollups.cycle_overrun(rows.withColumn("us", F.lit(0)), 9).collect()
    assert [(r["cycle_us"], r["devices"]) for r in cycles] == [(10000, 2)]
    assert [r["seq"] for r in rollups.take_n(rows, 2).collect()] == [1, 2]
    assert [r["seq"] for r in rollups.sample_latest(rows, "10 seconds").orderBy("seq").collect()] == [2, 3]
