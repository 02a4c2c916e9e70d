"""Readers and writers: tables of a folder, price panels, streams of files, and sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, format: str = "parquet", schema=None, **options) -> DataFrame:  # noqa: A002
    """Any batch source of Spark; give text formats a schema, so that nothing is read twice to infer one."""
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:  # noqa: A002
    df.write.format(format).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def write_bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> None:
    """A table whose later joins and aggregations on keys need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def read_jdbc(spark: SparkSession, url: str, name: str, split_by: str | None = None, rows_per_part: int = 1_000_000, **options) -> DataFrame:
    """A table of a database, read in parts of split_by (a number, date or time column), each a query of its own with the
    filters and columns that Spark pushes down. One query asks the database for the column's ends and the number of rows,
    so parts follow the data. Rows of null split_by are in the first part; without split_by, or in an empty table, there is
    one part. Values far from evenly spread make uneven parts: split by a key then."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    whole = reader.option("dbtable", name)
    if split_by is None:
        return whole.load()
    quoted = '"' + split_by.replace('"', '""') + '"'
    if url.startswith(("jdbc:mysql", "jdbc:mariadb")):
        quoted = "`" + split_by.replace("`", "``") + "`"
    low, high, rows = spark.read.format("jdbc").options(url=url, **options).option("query", f"SELECT min({quoted}) AS lo, max({quoted}) AS hi, count(*) AS n FROM {name}").load().first()
    if low is None or rows <= rows_per_part:
        return whole.load()
    return whole.options(partitionColumn=split_by, lowerBound=str(low), upperBound=str(high), numPartitions=-(-rows // rows_per_part)).load()


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "errorifexists", connections: int = 8, **options) -> None:
    """A table of a database, written over at most so many connections, a batch of rows a statement. A task that fails rolls
    its rows back; one that is lost after its commit and runs again writes them twice, so load into a fresh table."""
    df.coalesce(connections).write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()


def price_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks: symbol, ts, seq, price, qty."""
    return table(spark, folder, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("qty"))


def file_stream(spark: SparkSession, folder: str, name: str, max_files: int = 1) -> DataFrame:
    """A table of a folder as a stream of its files."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", max_files).parquet(folder)


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names. Only a local session without one (as in tests) gets a
    folder of its own; elsewhere executors would not see it, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_pairloom_sink", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.sparkContext._pairloom_sink = "file://" + tempfile.mkdtemp(prefix="shared")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
