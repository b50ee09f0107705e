"""Every registered query against its SQL, on the smallest test tables."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import connect, difference
from conftest import TABLES

import __spark_entry__ as entry_module


@pytest.fixture(scope="module")
def con():
    return connect(TABLES)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


# Plan nodes that no query may need: all-pairs joins and row-at-a-time Python.
BANNED = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, TABLES)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in BANNED if node in plan]
    assert difference(df, con, ORACLES[name]) is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["bucket", "value"] and df.count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
