from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from countermill.operators import config_rules as CR
from countermill.operators.joins import config_as_of, join_line, known_devices, unread_channels
from countermill.schemas import CHANNELS, DEVICES, FLEETS
from countermill.sources.device_config import (
    CHANNEL_DEFAULTS,
    DEVICE_DEFAULTS,
    FLEET_DEFAULTS,
    SCRIPT_DEFAULTS,
    apply_config_defaults,
    channels_of,
    devices_of,
    fleets_of,
    load_device_config,
    document_findings,
    gated_config,
    parse_config_documents,
    read_config_documents,
)


def channel_rows(spark, *changes, fleet=None):
    rows = []
    for n, change in enumerate(changes):
        row = {
            **CHANNEL_DEFAULTS,
            "device_id": "D",
            "channel": n,
            "name": f"Channel_{n:02d}",
            "start_register": n * 10,
            "min_value": 0,
            "max_value": 1000000,
            "max_rate_of_change": 1000.0,
            "overflow_threshold": 4294000000,
            "overflow_check": True,
            "tags": {},
            "description": None,
        }
        rows.append({**row, **change})
    df = spark.createDataFrame([[r[f] for f in CHANNELS.names] for r in rows], CHANNELS)
    return df if fleet is None else df.withColumn("fleet_id", F.lit(fleet))


def device_rows(spark, *changes):
    schema = DEVICES
    rows = []
    for n, change in enumerate(changes):
        row = {**DEVICE_DEFAULTS, "device_id": "D", "ip_address": f"192.168.1.{n + 1}", "tags": {}, "fleet_id": "F"}
        rows.append({**row, **change})
    base = spark.createDataFrame([[r[f] for f in schema.names] for r in rows], schema)
    fleets = spark.createDataFrame([(r["device_id"], r["ip_address"], r["fleet_id"]) for r in rows], "device_id string, ip_address string, fleet_id string")
    return base.join(fleets, ["device_id", "ip_address"])


def fleet_rows(spark, **change):
    row = {"fleet_id": "F", **FLEET_DEFAULTS, **change}
    return spark.createDataFrame([[row[f] for f in FLEETS.names]], FLEETS)


def rules_of(found):
    return sorted(r["rule"] for r in found.select("rule").collect())


def test_valid_channel_has_no_finding(spark):
    assert rules_of(CR.validate_channels(channel_rows(spark, {}, {"start_register": 65530}))) == []


CHANNEL_CASES = [
    ({"name": ""}, ["name_blank", "name_required"]),
    ({"name": "x" * 101}, ["name_length"]),
    ({"channel": -1}, ["channel_number_range"]),
    ({"channel": 300}, ["channel_number_range"]),
    ({"register_count": 0}, ["register_count_not_positive", "register_count_range"]),
    ({"scale_factor": 0.0}, ["scale_zero"]),
    ({"decimal_places": -1}, ["decimal_places_range"]),
    ({"decimal_places": 11}, ["decimal_places_range"]),
    ({"min_value": 1000, "max_value": 100}, ["min_above_max"]),
    ({"max_rate_of_change": -1.0}, ["rate_limit_not_positive"]),
    ({"start_register": 65530, "register_count": 10}, ["register_count_range", "register_end"]),
    ({"min_value": None, "max_value": None, "max_rate_of_change": None}, []),
]


def test_channel_rules(spark):
    """All cases in one table, a device per case."""
    rows = channel_rows(spark, *[{"channel": 0, **c, "device_id": f"D{n}"} for n, (c, _) in enumerate(CHANNEL_CASES)])
    found = {}
    for r in CR.validate_channels(rows).collect():
        found.setdefault(r["device_id"], []).append(r["rule"])
    assert [sorted(found.get(f"D{n}", [])) for n in range(len(CHANNEL_CASES))] == [rules for _, rules in CHANNEL_CASES]


DEVICE_CASES = [
    ({}, []),
    ({"device_id": "x" * 51}, ["device_id_length", "no_channels"]),
    ({"device_id": ""}, ["device_id_blank", "device_id_required", "no_channels"]),
    ({"ip_address": "not-an-ip"}, ["ip_invalid"]),
    ({"ip_address": ""}, ["ip_invalid", "ip_required"]),
    ({"ip_address": "256.1.1.1"}, ["ip_invalid"]),
    ({"ip_address": "::1"}, []),
    ({"port": 0}, ["port_range"]),
    ({"unit_id": 0}, ["unit_id_range"]),
    ({"timeout_ms": 0}, ["timeout_range"]),
    ({"max_retries": -1}, ["max_retries_range"]),
    ({"receive_buffer_size": 500}, ["receive_buffer_range"]),
    ({"send_buffer_size": 100000}, ["send_buffer_range"]),
    ({"rate_window_seconds": 5}, ["rate_window_range"]),
    ({"overflow_threshold": 500}, ["overflow_threshold_range"]),
]


def test_device_rules(spark):
    """All cases in one table, a fleet per case."""
    changes = [{"device_id": f"D{n}", **c, "fleet_id": f"F{n}"} for n, (c, _) in enumerate(DEVICE_CASES)]
    channels = channel_rows(spark, *[{"device_id": f"D{n}", "channel": 0} for n in range(len(changes))])
    found = {}
    for r in CR.validate_devices(device_rows(spark, *changes), channels).collect():
        found.setdefault(r["fleet_id"], []).append(r["rule"])
    assert [sorted(found.get(f"F{n}", [])) for n in range(len(changes))] == [rules for _, rules in DEVICE_CASES]


def test_duplicate_channels_and_cascade(spark):
    channels = channel_rows(spark, {"channel": 1}, {"channel": 1}, {"channel": 2, "scale_factor": 0.0})
    found = {r["rule"]: r for r in CR.validate_devices(device_rows(spark, {}), channels).collect()}
    assert found["duplicate_channel"]["message"] == "Duplicate channel numbers are not allowed: 1"
    assert found["scale_zero"]["message"] == "Channel 2: ScaleFactor cannot be zero"
    assert found["scale_zero"]["members"] == ["ScaleFactor"]


FLEET_CASES = [
    ({}, []),
    ({"poll_interval_ms": 50}, ["poll_interval_range"]),
    ({"health_check_interval_ms": 1000}, ["health_check_range"]),
    ({"max_concurrent_devices": 0}, ["concurrency_range", "too_many_devices"]),
    ({"data_buffer_size": 50}, ["data_buffer_range"]),
    ({"batch_size": 0}, ["batch_size_range"]),
    ({"batch_timeout_ms": 50}, ["batch_timeout_range"]),
    ({"max_consecutive_failures": 0}, ["consecutive_failures_range"]),
    ({"device_timeout_minutes": 0}, ["device_timeout_range"]),
]


def test_fleet_rules(spark):
    """All cases in one table, with one device each."""
    rows = [{"fleet_id": f"F{n}", **FLEET_DEFAULTS, **c} for n, (c, _) in enumerate(FLEET_CASES)]
    fleets = spark.createDataFrame([[r[f] for f in FLEETS.names] for r in rows], FLEETS)
    devices = device_rows(spark, *[{"device_id": f"D{n}", "fleet_id": f"F{n}"} for n in range(len(rows))])
    channels = channel_rows(spark, *[{"device_id": f"D{n}", "channel": 0} for n in range(len(rows))])
    found = {}
    for r in CR.validate_fleet(fleets, devices, channels).collect():
        found.setdefault(r["fleet_id"], []).append(r["rule"])
    assert [sorted(found.get(f"F{n}", [])) for n in range(len(rows))] == [rules for _, rules in FLEET_CASES]


def test_fleet_of_no_devices_passes(spark):
    none = device_rows(spark, {}).filter("false")
    assert rules_of(CR.validate_fleet(fleet_rows(spark), none, channel_rows(spark, {}).filter("false"))) == []


def test_poll_load_and_duplicate_devices(spark):
    devices = device_rows(spark, {"device_id": "A"}, {"device_id": "B"}, {"device_id": "B"})
    channels = channel_rows(spark, *[{"device_id": "A", "channel": n} for n in range(10)]).union(
        channel_rows(spark, *[{"device_id": "B", "channel": n, "enabled": n < 5} for n in range(10)])
    )
    load = CR.poll_load(fleet_rows(spark, poll_interval_ms=999), devices.dropDuplicates(["device_id"]), channels).first()
    assert (load["devices"], load["enabled_channels"], load["estimated_cycle_ms"], load["too_short"]) == (2, 15, 750, False)
    fleet = fleet_rows(spark, poll_interval_ms=100, max_concurrent_devices=2)
    found = {r["rule"]: r["message"] for r in CR.validate_fleet(fleet, devices, channels).collect()}
    assert found["duplicate_device"] == "Duplicate device IDs found: B"
    assert found["too_many_devices"] == "Number of devices (3) exceeds MaxConcurrentDevices (2). This may impact performance."
    assert found["poll_too_short"] == (
        "Polling interval (100ms) may be too short for 20 channels. Consider increasing to at least 1000ms."
    )


def test_service_view_and_gate(spark):
    channels = channel_rows(spark, {"name": "", "scale_factor": 0.0}, {"channel": 1, "scale_factor": 0.0})
    shown = CR.service_view(CR.validate_channels(channels))
    assert rules_of(shown) == ["name_required", "scale_zero"]
    devices = device_rows(spark, {"device_id": "D"}, {"device_id": "E"}, {"device_id": "G", "fleet_id": "H"})
    found = CR.validate_channels(channels)
    assert [r["device_id"] for r in CR.config_gate(devices, found).collect()] == ["G"]
    alone = CR.config_gate(devices.drop("fleet_id"), found).collect()
    assert sorted(r["device_id"] for r in alone) == ["E", "G"]
    with pytest.raises(ValueError, match="Invalid logger configuration"):
        CR.require_valid(found)
    CR.require_valid(found.filter("false"))


DOCUMENT = {
    "AdamLogger": {
        "PollIntervalMs": 1000,
        "Devices": [
            {
                "DeviceId": "PROD_LINE_A_001",
                "IpAddress": "192.168.100.10",
                "TimeoutMs": 5000,
                "Tags": {"location": "Production Line A"},
                "Channels": [
                    {"ChannelNumber": 0, "Name": "PartCounter", "MaxValue": 4294967295, "Tags": {"unit": "parts"}},
                    {"ChannelNumber": 1, "Name": "B", "Enabled": False, "Tags": {"overflow_threshold": 5000}},
                    {"ChannelNumber": 2, "Name": "C", "Tags": {"overflow_threshold": "high"}},
                ],
            }
        ],
    }
}


def test_load_device_config(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOCUMENT, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"Devices": [{"DeviceId": "X", "Channels": []}]}))
    devices, channels = load_device_config(spark, str(tmp_path))
    got = {r["device_id"]: r for r in devices.collect()}
    assert (got["PROD_LINE_A_001"]["timeout_ms"], got["PROD_LINE_A_001"]["port"]) == (5000, 502)
    assert got["PROD_LINE_A_001"]["tags"] == {"location": "Production Line A"}
    assert got["X"]["ip_address"] == ""
    rows = channels.orderBy("channel").collect()
    assert [(r["name"], r["enabled"], r["overflow_threshold"], r["overflow_check"]) for r in rows] == [
        ("PartCounter", True, 4294000000, True),
        ("B", False, 5000, True),
        ("C", True, 4294000000, False),
    ]
    assert rows[0]["max_value"] == 4294967295 and rows[0]["min_value"] is None
    fleets = fleets_of(read_config_documents(spark, str(tmp_path))).orderBy("poll_interval_ms").collect()
    assert [(r["poll_interval_ms"], r["batch_size"]) for r in fleets] == [(1000, 100), (5000, 100)]


def test_documents_as_lines(spark, tmp_path):
    one = {"Devices": [{"DeviceId": "A", "Channels": [{"ChannelNumber": 1, "Name": "a"}]}]}
    (tmp_path / "fleet.jsonl").write_text(json.dumps(one) + "\n" + json.dumps(DOCUMENT) + "\n")
    devices, channels = load_device_config(spark, str(tmp_path), lines=True)
    assert (devices.count(), channels.count()) == (2, 4)


def test_parse_documents_in_a_column(spark):
    docs = spark.createDataFrame([(json.dumps(DOCUMENT),)], "doc string")
    parsed = parse_config_documents(docs, "doc")
    assert (devices_of(parsed).count(), channels_of(parsed).count()) == (1, 3)


def test_defaults_merge(spark):
    mine = spark.createDataFrame(
        [({"host": "h", "retries": None}, {"channels": [3]})],
        "modbus struct<host string, retries int>, counters struct<channels array<int>>",
    )
    row = apply_config_defaults(mine, SCRIPT_DEFAULTS).first()
    assert (row["modbus"]["host"], row["modbus"]["retries"], row["modbus"]["port"]) == ("h", 3, 502)
    assert (row["counters"]["channels"], row["counters"]["rate_window"]) == ([3], 60)
    assert row["device"]["name"] == "ADAM-6051"


def test_defaults_of_every_section(spark):
    """The database and logging sections of the original are filled too."""
    mine = spark.createDataFrame(
        [("d", {"database": "own", "port": None}), ("e", None)], "device_id string, influxdb struct<database string, port int>"
    )
    own, bare = apply_config_defaults(mine, SCRIPT_DEFAULTS).orderBy("device_id").collect()
    assert (own["influxdb"]["database"], own["influxdb"]["port"], own["influxdb"]["ssl"]) == ("own", 8086, False)
    assert (bare["influxdb"]["database"], bare["influxdb"]["retries"]) == ("adam_counters", 3)
    assert (own["logging"]["poll_interval"], own["logging"]["backup_count"]) == (5.0, 5)


def test_config_as_of(spark):
    versions = spark.createDataFrame([("d", 100, "v1"), ("d", 200, "v2"), ("e", 0, "w")], "device_id string, valid_from_us bigint, v string")
    readings = spark.createDataFrame(
        [("d", 99, 1), ("d", 100, 2), ("d", 199, 3), ("d", 200, 4), ("d", 10**9, 5), ("f", 5, 6)],
        "device_id string, us bigint, seq bigint",
    )
    got = config_as_of(readings, versions).orderBy("seq").collect()
    assert [r["config"]["v"] if r["config"] else None for r in got] == [None, "v1", "v1", "v2", "v2", None]


@pytest.mark.parametrize("run", [1, 3, 16])
def test_config_as_of_many_versions(spark, run):
    """Runs of versions, versions that start at one time, null keys and readings without a time."""
    rng = random.Random(run)
    versions = [(d, rng.randrange(0, 300), n) for d in ("d", "e", None) for n in range(40)] + [("late", None, 1)]
    readings = [(d, None if n == 7 else rng.randrange(-20, 320), n) for d in ("d", "e", "f", "late", None) for n in range(60)]
    got = config_as_of(
        spark.createDataFrame(readings, "device_id string, us long, seq long"),
        spark.createDataFrame(versions, "device_id string, valid_from_us long, v long"),
        run=run,
    ).collect()

    def in_force(device, us):
        known = [(at, v) for d, at, v in versions if d == device and at is not None and us is not None and at <= us]
        return max(known, default=None)

    assert len(got) == len(readings)
    for r in got:
        assert (tuple(r.config) if r.config else None) == in_force(r.device_id, r.us)


def test_mistyped_settings_are_findings(spark, tmp_path):
    """Three bad documents give three findings and block; a quoted number is a number but no long."""
    channel = {"ChannelNumber": 1, "Name": "c", "Tags": {"overflow_threshold": 5000}}

    def write(name, device=None, settings=None, own=None):
        one = {"DeviceId": name, "IpAddress": "10.0.0.1", "Channels": [channel | (own or {})]}
        (tmp_path / f"{name}.json").write_text(json.dumps({"FleetId": name, "Devices": [one | (device or {})], **(settings or {})}))

    write("good", {"Port": "5020"}, own={"Tags": {"overflow_threshold": "5000"}})
    write("also", own={"Enabled": "False", "ScaleFactor": "0.5", "DecimalPlaces": None})
    write("port", {"Port": "abc"})
    write("enabled", own={"Enabled": "no"})
    write("batch", settings={"BatchSize": 2.5})
    (tmp_path / "broken.json").write_text('{"FleetId": ')
    devices, channels = load_device_config(spark, str(tmp_path))
    assert {r.device_id: r.port for r in devices.collect()} == {"good": 5020, "also": 502, "port": 502, "enabled": 502, "batch": 502}
    rows = {r.device_id: r for r in channels.collect()}
    assert (rows["good"].overflow_check, rows["port"].overflow_check, rows["port"].overflow_threshold) == (False, True, 5000)
    assert (rows["also"].enabled, rows["also"].scale_factor, rows["also"].decimal_places) == (False, 0.5, 0)
    found = {(r.fleet_id.rsplit("/", 1)[-1], r.level, r.rule, *r.members) for r in document_findings(spark, str(tmp_path)).collect()}
    assert found == {
        ("port", "device", "mistyped_setting", "Port"),
        ("enabled", "channel", "mistyped_setting", "Enabled"),
        ("batch", "fleet", "mistyped_setting", "BatchSize"),
        ("broken.json", "fleet", "malformed_document"),
    }
    allowed, their_channels, violations = gated_config(spark, str(tmp_path))
    assert {r.device_id for r in allowed.collect()} == {r.device_id for r in their_channels.collect()} == {"good", "also"}
    assert violations.count() == 4


def test_join_line_prefers_the_tag(spark):
    rows = spark.createDataFrame([("d", {"line": "tag"}), ("d", {}), ("e", {})], "device_id string, tags map<string,string>")
    lines = spark.createDataFrame([("d", "map")], "device_id string, line string")
    assert sorted(str(r["line"]) for r in join_line(rows, lines).collect()) == ["None", "map", "tag"]


def test_unread_and_known(spark):
    polls = spark.createDataFrame(
        [("d", 0, 1, True, [1]), ("d", 1, 1, False, None), ("d", 0, 2, True, [1]), ("d", 1, 2, True, [2]), ("x", 0, 1, True, [1])],
        "device_id string, channel int, us bigint, success boolean, registers array<int>",
    )
    channels = channel_rows(spark, {"device_id": "d", "channel": 0}, {"device_id": "d", "channel": 1}, {"device_id": "d", "channel": 2, "enabled": False})
    got = unread_channels(polls, channels).collect()
    assert [(r["device_id"], r["us"], r["channel"]) for r in got] == [("d", 1, 1)]
    assert known_devices(polls, spark.createDataFrame([("x",)], "device_id string")).count() == 1
