"""Rows without a time, fleets without a name, addresses, cycles and time zones."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from countermill.operators import config_rules, rollups
from countermill.operators.config_rules import IPV4, IPV6
from countermill.operators.rates import counter_rate
from countermill.operators.readings import tag_readings
from countermill.operators.slices import slice_start
from countermill.sources import device_config
from countermill.sources.sinks import iso_time


@pytest.mark.parametrize("window", [300, 86_400])
def test_rows_without_a_time_stay(spark, window):
    rows = [("a", 0, 0, 1, 100), ("a", 0, 10_000_000, 2, 200), ("a", 0, None, 3, 300), (None, 0, 5, 4, 400), (None, 0, None, 5, 1)]
    polls = spark.createDataFrame(rows, "device_id string, channel int, us long, seq long, raw_value long")
    got = {r.seq: r.rate for r in counter_rate(polls, window).collect()}
    assert got == {1: None, 2: 10.0, 3: None, 4: None, 5: None}


def test_one_reading_for_a_channel_with_a_disabled_twin(spark, monkeypatch):
    channels = spark.createDataFrame([("a", 0, True, "x"), ("a", 0, False, "y")], "device_id string, channel int, enabled boolean, name string")
    readings = spark.createDataFrame([("a", 0, None)], "device_id string, channel int, error_message string")

    class Tagger:
        @staticmethod
        def tagger(col):
            return F.create_map(F.lit("name"), col("name"))

    assert [r.tags for r in tag_readings(readings, channels, Tagger).collect()] == [{"name": "x"}]


@pytest.mark.parametrize(
    "text, valid",
    [
        ("1:2:3:4:5:6:7:8", True), ("::", True), ("::1", True), ("fe80::", True), ("1::8", True), ("::ffff:10.0.0.1", True),
        ("1:2:3:4:5:6:7::", True), ("64:ff9b::1.2.3.4", True), ("1:2:3:4:5:6:1.2.3.4", True), ("192.168.1.100", True),
        ("1:2:3:4:5:6:7:8:9::", False), (":::", False), ("12345::1", False), ("1::2::3", False), ("1:2:3:4:5:6:7", False),
        ("1:2:3:4:5:6:7:8:9", False), ("1:2:3:4:5:6::1.2.3.4", False), ("::ffff:10.0.0.256", False), ("1.2.3", False), ("", False), ("1:::2", False),
    ],
)
def test_addresses(one, text, valid):
    assert one(F.col("x").rlike(IPV4) | F.col("x").rlike(IPV6), x=(text, "string")) is valid


def test_devices_of_one_round_by_their_own_clocks(spark):
    rows = [("a", 10_000_003, 60_000), ("a", 10_000_003, 60_000), ("b", 10_000_000, 50_000), ("b", 10_000_000, 60_000)]
    polls = spark.createDataFrame(rows, "device_id string, us long, acquisition_us long")
    got = rollups.cycle_overrun(polls, 100, slice_start(F.col("us"), 100_000)).collect()
    assert [(r.us, r.cycle_us, r.devices) for r in got] == [(10_000_000, 120_000, 2)]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_times_are_utc_in_any_session_zone(spark, one, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # two in the morning of a day on which clocks skip that hour in New York
        assert one(iso_time(F.col("us")), us=(1_710_037_800_000_000, "long")) == "2024-03-10T02:30:00+00:00"
        assert one(iso_time(F.col("us")), us=(-1, "long")) == "1969-12-31T23:59:59.999999+00:00"
        assert one(iso_time(F.col("us"), trim=True), us=(1_500_000, "long")) == "1970-01-01T00:00:01.5+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def document(**settings) -> str:
    channel = {"ChannelNumber": 1, "Name": "c"}
    device = {"DeviceId": "d", "IpAddress": "10.0.0.1", "Channels": [channel]}
    return json.dumps({"AdamLogger": {"Devices": [device | settings.pop("device", {})], **settings}})


def test_one_finding_blocks_a_document_without_a_fleet_name(spark, tmp_path):
    (tmp_path / "good.json").write_text(document())
    (tmp_path / "bad.json").write_text(document(device={"IpAddress": "nowhere"}))
    (tmp_path / "fleet.json").write_text(document(MaxConcurrentDevices=0))
    (tmp_path / "broken.json").write_text('{"AdamLogger": {"Devices": [')
    docs = device_config.read_config_documents(spark, str(tmp_path))
    devices, channels = device_config.devices_of(docs), device_config.channels_of(docs)
    found = config_rules.validate_fleet(device_config.fleets_of(docs), devices, channels)
    found = found.unionByName(device_config.malformed_documents(spark, str(tmp_path)))
    assert {r.fleet_id.rsplit("/", 1)[1] for r in found.collect() if r.fleet_id} >= {"fleet.json", "broken.json"}
    assert [r.fleet_id.rsplit("/", 1)[1] for r in config_rules.config_gate(devices, found).collect()] == ["good.json"]


def test_a_missing_fleet_is_a_fleet(spark):
    fleets = spark.createDataFrame([(None, 5000, 1)], "fleet_id string, poll_interval_ms int, max_concurrent_devices int")
    devices = spark.createDataFrame([(None, "a"), (None, "b"), ("f", "a")], "fleet_id string, device_id string")
    channels = spark.createDataFrame([(None, "a", True), (None, "b", True), ("f", "a", True), ("f", "a", True)], "fleet_id string, device_id string, enabled boolean")
    load = config_rules.poll_load(fleets, devices, channels).first()
    assert (load.devices, load.enabled_channels) == (2, 2)
    blocked = spark.createDataFrame([(None, None)], "fleet_id string, device_id string")
    assert [r.fleet_id for r in config_rules.config_gate(devices, blocked).collect()] == ["f"]
