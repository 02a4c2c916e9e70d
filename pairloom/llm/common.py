"""What the operators of this subpackage share: shared scratch space, row keys and text basics."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8 with A-Z lower-cased; bytes of other characters are never in A-Z.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: A word: anything between the white space characters of ASCII.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch that goes to a Python worker, in sessions that set no bound of their own; one row at least.
BATCH_BYTES = 4 << 20
#: Narrow rows that are worth a task.
TASK_ROWS = 100_000
#: The share of all rows above which a key's facts are broadcast.
HOT_SHARE = 0.001


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    A local session that names none (as in tests) gets a folder of its own; elsewhere that is an error, as executors
    would not see it."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or getattr(context, "_pairloom_shared", None)
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = context._pairloom_shared = "file://" + tempfile.mkdtemp(prefix="shared")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; `clean_scratch` deletes it."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context._pairloom_scratch = [*getattr(context, "_pairloom_scratch", []), path]
    return path


def clean_scratch(spark: SparkSession) -> int:
    """Delete what the operators of this session stored in the shared folder, once their results are read; the number of
    paths. Checkpoints go with their DataFrames if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    context = spark.sparkContext
    paths, context._pairloom_scratch = getattr(context, "_pairloom_scratch", []), []
    for p in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows go to replicated files of the shared folder, never to an executor's disk."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many narrow rows in no more partitions than those need; large tables keep the session's."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS))) if rows < TASK_ROWS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back; for tables too wide for `materialize`."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(column: str) -> Column:
    """The column of just that name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have; names differ by more than case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone take the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stable(df: DataFrame, what: str = "stable") -> DataFrame:
    """The table itself if it is only read from files (or a checkpoint), whose rows come in the same order and splits each
    time; else a stored copy, as a shuffle may deal rows otherwise when it runs again."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:  # else splits follow the executors alive
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {re.sub(r"^[\s:+|-]*", "", line).split(" ")[0].split("[")[0] for line in plan.splitlines() if line.strip()}
    return df if nodes <= {"Project", "Filter", "Relation", "LogicalRDD"} and not re.search(r"\b(rand|randn|uuid|shuffle)\(", plan) else stored(df, what)


def row_keyed(df: DataFrame, key: str) -> DataFrame:
    """Number the rows of a `stable` table: keys agree between branches of a plan, and between attempts of a task."""
    return df.withColumn(key, F.monotonically_increasing_id())


def join_spread(rows: DataFrame, facts: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """Rows with the facts of their key; facts has one row a key, with n rows of that key among the total.

    Keys above HOT_SHARE of all rows are fewer than its inverse: that many facts at most are broadcast, and their rows are
    not dealt by key. The others meet in a shuffle."""
    is_hot = F.col("n") > total * HOT_SHARE
    hot, rest = F.broadcast(facts.where(is_hot).drop("n")), facts.where(~is_hot).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(rest, key))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that workers import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_pairloom_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="ship")) / "pairloom_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(target))
    context._pairloom_shipped = True


def handed_back() -> None:
    """Give freed memory back to the system; a worker stays alive between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(function: Callable) -> Callable:
    """The function of batches, with memory handed back as its task ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            handed_back()

    return run


def prepared(spark: SparkSession) -> None:
    ship(spark)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(setting).rstrip("b") or 0) > BATCH_BYTES and not spark.sparkContext.getConf().contains(setting):
        spark.conf.set(setting, str(BATCH_BYTES))


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    prepared(df.sparkSession)
    return df.mapInArrow(frugal(function), schema)


def map_pandas(df: DataFrame, function, schema) -> DataFrame:
    prepared(df.sparkSession)
    return df.mapInPandas(frugal(function), schema)
