from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from countermill.operators.rates import counter_rate, counter_rate_open, counter_rate_plain, rate_gate
from countermill.vocab import SECOND_US

BASE = 1_700_000_000
SCHEMA = "device_id string, channel int, us bigint, seq bigint, raw_value bigint"


def series(spark, points, device="d", channel=0):
    rows = [(device, channel, int((BASE + t) * SECOND_US), n, v) for n, (t, v) in enumerate(points)]
    return spark.createDataFrame(rows, SCHEMA)


def rates_of(df):
    return [r["rate"] for r in df.orderBy("device_id", "channel", "seq").collect()]


@pytest.mark.parametrize(
    ("points", "last"),
    [
        ([(0, 1000)], None),
        ([(0, 1000), (10, 1100)], 10.0),
        ([(0, 1000), (5, 1050), (10, 1100), (20, 1200)], 10.0),
        ([(0, 4294967195), (10, 100)], 20.0),
        ([(0, 1000), (0, 1100)], None),
        ([(-600, 1000), (-60, 1050), (0, 1100)], 50 / 60),
        ([(0, 0), (300, 600)], 2.0),
        ([(0, 0), (300.000001, 600)], None),
    ],
)
def test_fixed_cases(spark, points, last):
    assert rates_of(counter_rate(series(spark, points)))[-1] == last


def test_wrap_modes(spark):
    points = series(spark, [(0, 4294967195), (10, 100)])
    assert rates_of(counter_rate(points, wrap="exact"))[-1] == pytest.approx(20.1)
    assert rates_of(counter_rate_plain(points))[-1] == pytest.approx(-429496709.5)


def test_overflow_series(spark):
    points = series(spark, [(0, 65435), (60, 65485), (120, 65535), (180, 50), (240, 100)])
    assert rates_of(counter_rate(points))[-1] == pytest.approx((4294967295 - 65435 + 100) / 240)


@pytest.mark.parametrize(
    ("points", "last"),
    [([(0, 1000), (60, 1100)], None), ([(0, 1000), (59, 1059)], 1.0), ([(0, 100), (10, 40)], -6.0)],
)
def test_open_window(spark, points, last):
    assert rates_of(counter_rate_open(series(spark, points)))[-1] == last


def test_series_do_not_mix(spark):
    both = series(spark, [(0, 1000), (10, 1100)], "a").union(series(spark, [(0, 2000), (10, 2200)], "b"))
    both = both.union(series(spark, [(0, 2000), (10, 2200)], "a", 1))
    assert rates_of(counter_rate(both)) == [None, 10.0, None, 20.0, None, 20.0]


def test_gate(spark):
    points = series(spark, [(0, 1000), (10, 5), (20, 1200)]).withColumn(
        "processed_value", F.when(F.col("raw_value") > 100, F.col("raw_value") * 1.0)
    )
    assert rates_of(rate_gate(points)) == [None, None, 10.0]


def replay(rows, window_us, inclusive, wrap):
    """The list algorithm: append, drop what is too old, compare first and last."""
    history, out = {}, {}
    for device, channel, us, seq, raw in sorted(rows, key=lambda r: (r[2], r[3])):
        points = history.setdefault((device, channel), [])
        points.append((us, raw))
        cut = us - window_us
        points[:] = [p for p in points if (p[0] >= cut if inclusive else p[0] > cut)]
        elapsed, change = us - points[0][0], raw - points[0][1]
        if wrap and change < 0:
            change += 4294967295
        out[device, channel, seq] = change / (elapsed / 1e6) if elapsed > 0 else None
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), window=st.sampled_from([1, 7, 60]), inclusive=st.booleans(), width=st.sampled_from([1, 5, 60, 200]))
def test_equals_replay(spark, seed, window, inclusive, width):
    """Slices below and above the window, ties, drops and a hot series against the sequential algorithm."""
    rng = random.Random(seed)
    rows, seq = [], 0
    for device, size in [("hot", 600), ("a", 60), ("b", 60), ("c", 1)]:
        us = BASE * SECOND_US
        for _ in range(size):
            us += rng.choice([0, 1, 500_000, SECOND_US, window * SECOND_US, 3 * window * SECOND_US])
            rows.append((device, rng.randrange(2), us, seq, rng.randrange(4294967296)))
            seq += 1
    want = replay(rows, window * SECOND_US, inclusive, True)
    rng.shuffle(rows)
    got = counter_rate(
        spark.createDataFrame(rows, SCHEMA), window, inclusive=inclusive, slice_seconds=width
    ).collect()
    assert {(r["device_id"], r["channel"], r["seq"]): r["rate"] for r in got} == want


@pytest.mark.parametrize("window", [300, 7200])
def test_hot_series_spreads(spark, window):
    """One series is cut into many (key, slice) groups, not handled by one task."""
    n = 50_000
    hot = spark.range(n).select(
        F.lit("hot").alias("device_id"),
        F.lit(0).alias("channel"),
        (F.lit(BASE * SECOND_US) + F.col("id") * SECOND_US).alias("us"),
        F.col("id").alias("seq"),
        F.col("id").alias("raw_value"),
    )
    rated = counter_rate(hot, window)
    assert rated.agg(F.count("rate"), F.min("rate"), F.max("rate")).first() == (n - 1, 1.0, 1.0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per_task = rated.groupBy(F.spark_partition_id().alias("p")).agg(F.count("rate").alias("n"))
        sizes = [r["n"] for r in per_task.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 0.6 * n
