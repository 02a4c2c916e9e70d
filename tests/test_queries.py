"""Every query that has SQL gives what DuckDB gives; the others run and have rows."""

import pytest

import __spark_entry__ as entry
from .compare import connect, same
from pairloom.plans import relational, research

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = research.QUERIES | relational.QUERIES, research.ORACLE_SQL | relational.ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    same(QUERIES[name](spark, FOLDER), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 300
    assert set(entry.oracle_sql()) <= set(entry.queries())
