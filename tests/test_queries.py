"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from countermill.plans import catalog
from compare import connect, differences

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.QUERIES)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_same_names():
    assert set(NAMES) <= set(entry.queries())
    assert set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert differences(entry.queries()[name](spark, SF), entry.oracle_sql()[name], duck) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
