from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from countermill.functions.health import health_score, success_rate
from countermill.functions.quality import (
    grade_quality,
    grade_quality_custom,
    is_valid_range,
    is_valid_range_strict,
    is_valid_rate,
    overflow_limit,
    quality_name,
    status_name,
)
from countermill.functions.registers import decode_failure, decode_registers
from countermill.functions.scaling import transform_temperature, transform_value
from countermill.functions.tags import enrich_tags, shift_tag

C = F.col


@pytest.mark.parametrize(
    ("registers", "want"),
    [
        ([1234], 1234),
        ([0x1234, 0x5678], 1450709556),
        ([65535, 65535], 4294967295),
        ([1, 2, 3, 4], 131073),
        ([], None),
        (None, None),
    ],
)
def test_decode(one, registers, want):
    assert one(decode_registers(C("r")), r=(registers, "array<int>")) == want


@pytest.mark.parametrize(
    ("registers", "fails"), [([1, 2], False), ([], True), ([70000, 1], True), ([-1], True), (None, False)]
)
def test_decode_failure(one, registers, fails):
    assert (one(decode_failure(C("r")), r=(registers, "array<int>")) is not None) == fails


@pytest.mark.parametrize(
    ("raw", "scale", "offset", "decimals", "want"),
    [
        (1000, 1.0, 0.0, 0, 1000.0),
        (1000, 0.1, 0.0, 1, 100.0),
        (0, 1.0, 273.15, 2, 273.15),
        (30000, 0.01, -273.15, 2, 26.85),
        (1, 1.0 / 3.0, 0.0, 3, 0.333),
        (200, -0.5, 100.0, 1, 0.0),
        (5, 0.5, 0.0, 0, 2.0),
        (7, 0.5, 0.0, 0, 4.0),
        (-1, 0.5, 0.0, 0, 0.0),
    ],
)
def test_transform(one, raw, scale, offset, decimals, want):
    value = one(
        transform_value(C("raw"), C("s"), C("o"), C("d")),
        raw=(raw, "bigint"),
        s=(scale, "double"),
        o=(offset, "double"),
        d=(decimals, "int"),
    )
    assert value == want
    assert str(value) != "-0.0"


@pytest.mark.parametrize(
    ("name", "tags", "want"),
    [
        ("Temperature 1", {"unit": "fahrenheit"}, 212.0),
        ("Temperature 1", {"unit": "celsius"}, 100.0),
        ("Temperature 1", None, 100.0),
        ("Parts", {"unit": "fahrenheit"}, 100.0),
    ],
)
def test_temperature(one, name, tags, want):
    value = one(
        transform_temperature(C("raw"), F.lit(1.0), F.lit(0.0), F.lit(None).cast("int"), C("n"), C("t")),
        raw=(100, "bigint"),
        n=(name, "string"),
        t=(tags, "map<string,string>"),
    )
    assert value == want


def _grade(one, raw, rate=None, low=0, high=1000000, limit=1000.0, threshold=None, check=True):
    return one(
        grade_quality(C("raw"), C("rate"), C("lo"), C("hi"), C("lim"), C("thr"), C("chk")),
        raw=(raw, "bigint"),
        rate=(rate, "double"),
        lo=(low, "bigint"),
        hi=(high, "bigint"),
        lim=(limit, "double"),
        thr=(threshold, "bigint"),
        chk=(check, "boolean"),
    )


def test_grades(one):
    assert _grade(one, 500) == 0
    assert _grade(one, 2000000) == 2
    assert _grade(one, 500, rate=2000.0) == 1
    assert _grade(one, 500, rate=-2000.0) == 1
    assert _grade(one, 2000000000, high=3000000000, threshold=1000000000) == 6
    assert _grade(one, 4294001000, high=4294010000) == 6
    assert _grade(one, 4294001000, high=4294010000, check=False) == 0
    assert _grade(one, 2000000, rate=2000.0) == 2
    assert _grade(one, 500, rate=2000.0, limit=None) == 0


def test_boundaries(one):
    codes = [_grade(one, v, low=10, high=20) for v in (9, 10, 11, 15, 19, 20, 21)]
    assert codes == [2, 0, 0, 0, 0, 0, 2]


def test_open_and_strict_ranges(one):
    bounds = {"lo": (None, "bigint"), "hi": (None, "bigint"), "raw": (2**63 - 1, "bigint")}
    assert one(is_valid_range(C("raw"), C("lo"), C("hi")), **bounds) is True
    assert one(is_valid_range_strict(C("raw"), C("lo"), C("hi")), **bounds) is False
    assert one(is_valid_rate(C("r"), C("l")), r=(None, "double"), l=(1.0, "double")) is True
    assert one(is_valid_rate(C("r"), C("l")), r=(1000.0, "double"), l=(None, "double")) is True


def test_custom_grade(one):
    def grade(raw, rate, name):
        return one(
            grade_quality_custom(C("raw"), C("rate"), C("n")),
            raw=(raw, "bigint"),
            rate=(rate, "double"),
            n=(name, "string"),
        )

    assert grade(-1, None, "x") == 2
    assert grade(1000001, None, "Production A") == 1
    assert grade(1000001, None, "x") == 0
    assert grade(1, -1001.0, "x") == 1


@pytest.mark.parametrize(
    ("value", "kind", "want"), [(None, None, 4294000000), ("5", "long", 5), ("5", "int", None), ("x", "string", None)]
)
def test_overflow_limit(one, value, kind, want):
    assert one(overflow_limit(C("v"), C("k")), v=(value, "string"), k=(kind, "string")) == want


def test_names(one):
    assert [one(quality_name(C("q")), q=(q, "int")) for q in range(8)] == [
        "Good",
        "Uncertain",
        "Bad",
        "Timeout",
        "DeviceFailure",
        "ConfigurationError",
        "Overflow",
        None,
    ]
    assert [one(status_name(C("q")), q=(q, "int")) for q in range(5)] == [
        "Online",
        "Warning",
        "Error",
        "Offline",
        "Unknown",
    ]


def _tags(one, base=None, description=None, offset=0.0, device=None, stamp=None):
    return one(
        enrich_tags(
            C("b"),
            F.lit("Ch"),
            C("d"),
            F.lit(100),
            F.lit(2),
            F.lit(0.01),
            C("o"),
            None if device is None else C("dev"),
            None if stamp is None else F.lit(stamp),
        ),
        b=(base, "map<string,string>"),
        d=(description, "string"),
        o=(offset, "double"),
        dev=(device, "map<string,string>"),
    )


def test_tags(one):
    tags = _tags(one, {"original_tag": "v"}, stamp="now")
    assert tags == {
        "original_tag": "v",
        "data_source": "adam_logger",
        "channel_name": "Ch",
        "register_start": "100",
        "register_count": "2",
        "scale_factor": "0.01",
        "device_type": "adam_6051",
        "timestamp_utc": "now",
    }
    full = _tags(one, description="text", offset=-10.0)
    assert (full["channel_description"], full["offset"]) == ("text", "-10.0")
    assert "channel_description" not in _tags(one, description=" \t")
    assert _tags(one, {"device_type": "custom_device"})["device_type"] == "custom_device"
    assert _tags(one, {"data_source": "mine"})["data_source"] == "adam_logger"
    with_device = _tags(one, {"device_line": "kept"}, device={"location": "hall", "line": "A"})
    assert (with_device["device_location"], with_device["device_line"]) == ("hall", "kept")


@pytest.mark.parametrize(
    ("hour", "want"), [(5, "night"), (6, "day"), (13, "day"), (14, "evening"), (21, "evening"), (22, "night")]
)
def test_shift(one, hour, want):
    at = datetime.datetime(2024, 1, 1, hour, tzinfo=datetime.UTC)
    tags = one(shift_tag(C("b"), C("d"), C("t")), b=(None, "map<string,string>"), d=({}, "map<string,string>"), t=(at, "timestamp"))
    assert tags == {"location": "unknown", "shift": want}


@pytest.mark.parametrize(
    ("total", "ok", "failures", "rate", "score"),
    [(0, 0, 0, 0.0, 0.0), (10, 10, 0, 100.0, 100.0), (10, 5, 2, 50.0, 30.0), (10, 2, 8, 20.0, 0.0), (100, 90, 20, 90.0, 40.0)],
)
def test_scores(one, total, ok, failures, rate, score):
    values = {"t": (total, "bigint"), "k": (ok, "bigint"), "f": (failures, "bigint")}
    assert one(success_rate(C("t"), C("k")), **values) == pytest.approx(rate)
    assert one(health_score(C("t"), C("k"), C("f")), **values) == pytest.approx(score)
