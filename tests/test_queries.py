"""Every registered panel query that has SQL equals it."""

import pytest

import __spark_entry__ as entry
from daygrid.plans import demand, demand_more  # noqa: F401

from helpers import DATA, connection, same


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(demand.SQL))
def test_query_equals_sql(spark, con, name):
    same(demand.QUERIES[name](spark, str(DATA)), con, demand.SQL[name])
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
