from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from countermill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, "countermill-tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column over a single row given as name=(value, type)."""

    def run(column, **values):
        schema = ", ".join(f"`{n}` {t}" for n, (_, t) in values.items()) or "x int"
        row = tuple(v for v, _ in values.values()) or (0,)
        return spark.createDataFrame([row], schema).select(column.alias("out")).first()["out"]

    return run
