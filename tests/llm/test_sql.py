"""Queries whose SQL DuckDB can run give the same rows."""

import pytest

from pairloom.llm import queries

from ..compare import connect, same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    same(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_one_row_per_document(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER)
    table = "pages" if name == "op9_html_text" else "documents"
    ids = spark.read.parquet(f"{FOLDER}/{table}.parquet").select(table[:-1].replace("ument", "") + "_id")
    assert rows.select(ids.columns[0]).distinct().count() == ids.count()
    assert name == "op6_packing" or rows.count() == ids.count()
