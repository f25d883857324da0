"""The registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, oracle

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return oracle(TABLES)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


def test_entry(spark):
    assert entry.entry(spark).count() == 140


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    outcome = compare(spark, con, TABLES, name)
    assert outcome.startswith(("ok", "rows-only")), outcome
