"""Relational queries beyond what small tables show by chance: sorts that spill, long recursions, exact counts beside sketches."""

import pytest

from .compare import connect, same
from pairloom.plans import relational

FOLDER = "/root/testdata/sf0.001"
SPILL = "spark.shuffle.spill.numElementsForceSpillThreshold"


@pytest.fixture
def spilling(spark):
    """Sorts of more than 50 rows spill, so that rows of equal sort keys come back in any order, as on a cluster."""
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set(SPILL, "50")
    yield
    conf.remove(SPILL)


def test_lateral_top1_does_not_rest_on_the_order_of_arrival(spark, spilling):
    same(relational.QUERIES["b07_lateral_top1"](spark, FOLDER), connect(FOLDER), relational.ORACLE_SQL["b07_lateral_top1"])


def test_sketches_are_kept_by_group_not_by_value(spark):
    plan = relational.QUERIES["b10_approx_distinct"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("keys=[")[1].split("]")[0] for line in plan.splitlines() if "approx_count_distinct" in line and "keys=[" in line]
    assert keys and all("l_partkey" not in k for k in keys)


def test_sketch_and_count_pass_over_nulls(spark, tmp_path):
    rows = [("A", k % 40) for k in range(400)] + [("A", None), (None, 1), (None, None), ("B", None)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey bigint").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = relational.QUERIES["b10_approx_distinct"](spark, str(tmp_path)).collect()
    assert {(r.l_returnflag, r.parts, r.near) for r in found} == {("A", 40, True), (None, 1, True), ("B", 0, True)}


def test_recursion_over_more_than_a_million_rows_broadcasts_nothing(spark, tmp_path):
    n = 1_050_000
    spark.range(n).selectExpr("id AS c_custkey", "CAST(1 AS DOUBLE) AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100MB")
    try:
        rows = relational.QUERIES["b34_recursive"](spark, str(tmp_path))
        assert "strategy=merge" in rows._jdf.queryExecution().analyzed().toString()
        found = rows.selectExpr("count(*) AS n", "count(DISTINCT k) AS keys", "max(depth) AS deepest", "sum(CAST(balance = depth + 1 AS INT)) AS right").first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tuple(found) == (n - 1, n - 1, 20, n - 1)
