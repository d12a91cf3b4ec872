from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from countermill.operators import health as H
from countermill.operators.slices import fill_forward

SCHEMA = "device_id string, us bigint, seq bigint, kind string, success boolean, error string"
STATUS = {"Online": 0, "Error": 2, "Offline": 3, "Unknown": 4}


def fold(events, start_us, present=True):
    """The service's bookkeeping, one event after the other."""
    out, devices = [], {}
    for device, us, seq, kind, success, error in sorted(events, key=lambda e: (e[1], e[2])):
        state = devices.setdefault(
            device, {"at": start_us, "total": 0, "ok": 0, "bad": 0, "gap": None, "err": None} if present else None
        )
        if kind in ("start", "add"):
            if state is not None:
                continue
            state = devices[device] = {"at": us, "total": 0, "ok": 0, "bad": 0, "gap": None, "err": None}
            status = "Unknown"
        elif state is None:
            continue
        elif kind in ("remove", "stop"):
            status = "Offline"
            devices[device] = None
        elif kind == "update":
            state.update(at=us, bad=0, err=None)
            status = "Unknown"
        else:
            state["total"] += 1
            if success:
                state.update(ok=state["ok"] + 1, bad=0, gap=None if state["at"] is None else us - state["at"], err=None)
            else:
                state.update(bad=state["bad"] + 1, err=error)
            state["at"] = us
            status = "Online" if success else "Error"
        if kind not in ("start", "stop"):
            out.append((device, us, seq, STATUS[status], state["gap"], state["bad"], state["err"], state["total"], state["ok"]))
    return sorted(out)


def rows_of(df):
    return sorted(
        tuple(r)
        for r in df.select(
            "device_id",
            "us",
            "seq",
            "status",
            "last_successful_read_us",
            "consecutive_failures",
            "last_error",
            "total_reads",
            "successful_reads",
        ).collect()
    )


def random_events(seed, kinds, sizes=(("hot", 500), ("a", 40), ("b", 3))):
    rng = random.Random(seed)
    events, seq = [], 0
    for device, size in sizes:
        us = 1000
        for _ in range(size):
            us += rng.choice([0, 1, 40, 400])
            kind = rng.choice(kinds)
            ok = rng.random() < 0.5
            read = kind in ("read", "probe")
            events.append((device, us, seq, kind, ok if read else None, f"e{seq}" if read and not ok else None))
            seq += 1
    rng.shuffle(events)
    return events


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), width=st.sampled_from([50, 1000]), start=st.sampled_from([None, 0]))
def test_history_equals_fold(spark, seed, width, start):
    events = random_events(seed, ["read", "read", "read", "probe"])
    got = H.health_history(spark.createDataFrame(events, SCHEMA), start_us=start, slice_us=width)
    assert rows_of(got) == fold(events, start)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), width=st.sampled_from([50, 1000]), present=st.booleans())
def test_epochs_equal_fold(spark, seed, width, present):
    events = random_events(seed, ["read"] * 6 + ["probe", "add", "remove", "update", "stop", "start"])
    got = H.health_epochs(
        spark.createDataFrame(events, SCHEMA), present_at_start=present, start_us=0 if present else None, slice_us=width
    )
    assert rows_of(got) == fold(events, 0 if present else None, present)


def test_last_error_is_null_after_success(spark):
    events = [("d", 1, 1, "read", False, "x"), ("d", 2, 2, "read", True, None), ("d", 3, 3, "update", None, None)]
    got = H.health_fold(spark.createDataFrame(events, SCHEMA)).orderBy("seq").collect()
    assert [(r["last_error"], r["status_name"], r["is_connected"]) for r in got] == [
        ("x", "Error", False),
        (None, "Online", True),
        (None, "Unknown", False),
    ]
    assert [r["success_rate"] for r in got] == [0.0, 50.0, 50.0]


@pytest.mark.parametrize(
    ("statuses", "running", "want"),
    [
        ([0, 0], True, ("Healthy", "All devices are online (2/2)")),
        ([0, 2], True, ("Degraded", "Some devices are offline (1/2)")),
        ([2, 4], True, ("Unhealthy", "No devices are online (0/2)")),
        ([], True, ("Unhealthy", "No devices are online (0/0)")),
        ([0], False, ("Unhealthy", "Service is not running")),
    ],
)
def test_service_health(spark, statuses, running, want):
    latest = spark.createDataFrame([(s,) for s in statuses], "status int")
    row = H.service_health(latest, running).first()
    assert (row["state"], row["description"]) == want


def test_cycle_clock(spark):
    polls = spark.createDataFrame(
        [("d", 100, 1, True, [1], 5, None), ("d", 100, 2, False, None, 7, "no"), ("d", 200, 3, True, [1], None, None)],
        "device_id string, us bigint, seq bigint, success boolean, registers array<int>, acquisition_us bigint, error string",
    )
    assert [r["us"] for r in H.health_events(polls).orderBy("seq").collect()] == [105, 112, 200]


@pytest.mark.parametrize("inclusive", [True, False])
def test_fill_forward(spark, inclusive):
    rng = random.Random(3)
    rows = [(k, rng.randrange(2000), n, rng.choice([None, None, None, n])) for n, k in enumerate(["h"] * 400 + ["x"] * 20)]
    df = spark.createDataFrame(rows, "k string, us bigint, seq bigint, v int")
    got = fill_forward(df, ["k"], {"last": F.col("v")}, inclusive=inclusive, slice_us=37)
    want, last = {}, {}
    for k, _, n, v in sorted(rows, key=lambda r: (r[1], r[2])):
        before = last.get(k)
        if v is not None:
            last[k] = v
        want[n] = last.get(k) if inclusive else before
    assert {r["seq"]: r["last"] for r in got.collect()} == want
