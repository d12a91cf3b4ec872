"""What the plans of the main queries must look like."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from countermill.operators.readings import process_readings
from countermill.plans import bindings

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plan(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")

    def text(name):
        return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    yield text
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffles(text):
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange hashpartitioning", re.sub(r"ReusedExchange.*", "", text)))


def test_one_shuffle_for_the_readings(plan, spark):
    df = process_readings(bindings.event_polls(spark, SF), bindings.fleet_channels(spark, SF))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert shuffles(text) == 1
    assert "hashpartitioning(device_id" in text and "_slice" in text
    assert "Python" not in text and "Arrow" not in text
    names = next(line for line in text.splitlines() if "Exchange hashpartitioning" in line)
    assert "_slice" in names


def scans(text):
    return len(re.findall(r"FileScan", text))


def row_shuffles(text):
    """Shuffles of rows by key and time slice; summaries are shuffled by key, or by key and slice to join."""
    made = re.sub(r"ReusedExchange.*", "", text)
    return len(re.findall(r"Exchange hashpartitioning\([^)]*_slice#\d+L[^)]*\), REPARTITION", made))


@pytest.mark.parametrize("name, sources", [("counter_rate", 1), ("poll_gaps", 1), ("process_readings", 3), ("read_and_log", 1), ("health_epochs", 1)])
def test_carried_values_read_and_shuffle_rows_once(plan, spark, name, sources):
    """One scan per table, one shuffle of the rows, its other uses reuse it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan(name)
    assert scans(text) == sources, text
    assert row_shuffles(text) == 1, text
    assert "ReusedExchange" in text


def test_epochs_need_five_shuffles_at_most(plan, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert shuffles(plan("health_epochs")) <= 5


def test_readings_meet_versions_without_a_sort_of_their_own(plan):
    """Versions are a small side; readings are scanned once and neither shuffled nor sorted."""
    text = plan("config_as_of")
    assert scans(text) == 2
    probe = text[: text.index("BroadcastExchange")]
    assert "Sort" not in probe and "Exchange hashpartitioning" not in probe


def test_filter_and_columns_reach_the_scan(plan):
    text = plan("successful_polls")
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "Not(EqualTo(event_type,error))" in scan and "props" not in scan


def test_health_shuffles_its_events_once(plan, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan("health_history")
    assert "ReusedExchange" in text
    assert row_shuffles(text) == 1


@pytest.mark.parametrize("name", ["counter_rate", "health_history", "health_epochs", "config_as_of", "poll_gaps", "unread_channels"])
def test_no_cross_join(plan, name):
    text = plan(name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_windows_of_rows_are_cut_into_slices(plan):
    """No window over raw rows is partitioned by device alone."""
    for name in ("process_readings", "counter_rate"):
        for spec in re.findall(r"windowspecdefinition\(([^)]*)\)", plan(name)):
            assert "_slice" in spec
