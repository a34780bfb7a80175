"""Every query against its SQL on the smallest tables, and rules its plan must keep."""

from __future__ import annotations

import functools
import os

import pytest

import __spark_entry__ as entry
from roadpulse.plans import oracle, queries
from tests.parity import database, difference

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are absent")


@pytest.fixture(scope="module", autouse=True)
def shared_tables():
    """Stored tables are shared between queries, since only results are looked at."""
    own = queries.Tables
    queries.Tables = functools.lru_cache(own)
    yield
    queries.Tables = own


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_sql_belongs_to_queries():
    assert set(oracle.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, sql) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
    assert "PythonUDF" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 369
