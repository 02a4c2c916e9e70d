"""Tables of a database: Derby, whose driver comes with Spark."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from pairloom.sources import tables
from .compare import rows_of

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture
def url(tmp_path):
    return f"jdbc:derby:{tmp_path}/db;create=true"


@pytest.fixture
def events(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(None if i % 97 == 0 else i, start + datetime.timedelta(minutes=i), f"s{i % 5}", i / 7, i % 2 == 0) for i in range(1000)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, symbol string, price double, buy boolean")


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("split_by", ["event_id", "ts"])
def test_written_rows_are_read_back_in_parts(spark, url, events, split_by):
    tables.write_jdbc(events, url, "events", connections=3, **DRIVER)
    got = tables.read_jdbc(spark, url, "events", split_by, rows_per_part=150, **DRIVER)
    assert got.rdd.getNumPartitions() == 7
    assert rows_of(got.collect(), got.columns) == rows_of(events.collect(), events.columns)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 7 and max(sizes) < 200


def test_filters_and_columns_reach_the_database(spark, url, events):
    tables.write_jdbc(events, url, "events", createTableColumnTypes="symbol VARCHAR(16)", **DRIVER)  # a large object, which Derby takes strings for, has no comparison
    got = tables.read_jdbc(spark, url, "events", "event_id", rows_per_part=400, **DRIVER).where("price > 100 and symbol = 's1'").select("event_id")
    text = plan(got)
    assert re.search(r"PushedFilters: \[.*GreaterThan\(price,100.0\).*EqualTo\(symbol,s1\)", text, re.I) and re.search(r"ReadSchema: struct<event_id:bigint>", text, re.I)
    assert got.count() == events.where("price > 100 and symbol = 's1'").count()


def test_small_and_empty_tables_are_one_part(spark, url, events):
    tables.write_jdbc(events.limit(5), url, "few", **DRIVER)
    tables.write_jdbc(events.limit(0), url, "nothing", **DRIVER)
    for name, rows in (("few", 5), ("nothing", 0)):
        for split_by in ("ts", None):
            got = tables.read_jdbc(spark, url, name, split_by, **DRIVER)
            assert got.count() == rows and got.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="already exists"):
        tables.write_jdbc(events, url, "few", **DRIVER)
    tables.write_jdbc(events, url, "few", mode="append", **DRIVER)
    assert tables.read_jdbc(spark, url, "few", **DRIVER).count() == 1005
