"""Shared helpers: stable tables, scratch space, column names, bounded batches."""

import os
import types

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.llm import common


def test_tables_that_could_come_in_another_order_are_stored(spark, tmp_path):
    spark.range(100).withColumn("a.b", F.lit(1)).write.parquet(f"{tmp_path}/t")
    files = spark.read.parquet(f"{tmp_path}/t")
    assert common.stable(files) is files
    some = files.where("id % 2 = 0").select("id")
    assert common.stable(some) is some
    for df in (files.repartition(3), files.limit(7), files.distinct(), files.where(F.rand() < 0.5), files.join(files.select("id"), "id")):
        kept = common.stable(df)
        assert kept is not df and kept.columns == df.columns
        once = [tuple(r) for r in common.row_keyed(kept, "k").collect()]
        assert once == [tuple(r) for r in common.row_keyed(kept, "k").collect()]


def test_scratch_is_deleted_when_asked(spark):
    common.clean_scratch(spark)
    kept = common.stored(spark.range(10), "x")
    path = common.scratch(spark, "y").removeprefix("file://")
    os.makedirs(path)
    assert kept.count() == 10 and common.clean_scratch(spark) == 2 and not os.path.exists(path) and common.clean_scratch(spark) == 0


@pytest.mark.parametrize(("master", "ok"), [("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_only_local_sessions_get_a_folder_of_their_own(master, ok):
    conf = types.SimpleNamespace(get=lambda *a: None)
    context = types.SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: "x")
    session = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda *a: None))
    if ok:
        assert common.shared_dir(session) == common.shared_dir(session)
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session)


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a.b", "ROW", "k`s"])
    assert df.select(*map(common.named, df.columns)).first() == (1, 2, 3)
    assert common.fresh(df, "row") == "row_" and common.fresh(df, "x") == "x"


def test_batches_to_python_are_bounded_in_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    df = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    got = common.map_arrow(df, sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 3000 and max(r.bytes for r in got) < 2 * common.BATCH_BYTES


def test_small_tables_take_few_tasks(spark):
    assert common.fitted(spark.range(10).repartition(4), 10).rdd.getNumPartitions() == 1
    assert common.fitted(spark.range(10).repartition(4), 10**9).rdd.getNumPartitions() == 4
