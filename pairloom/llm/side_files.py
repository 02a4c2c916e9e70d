"""Tables that tasks read beside their rows, a bounded part each, so that wide rows need not be shuffled to meet them.

A table is written to the shared folder, partitioned by a key; a task opens the part of the key that its rows carry."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame

from .common import scratch
from .token_files import opened


def written_by(df: DataFrame, key: str, what: str) -> str:
    """Write a table of narrow rows, a file for each value of an integer key; the folder."""
    folder = scratch(df.sparkSession, what)
    df.repartition(key).write.partitionBy(key).parquet(folder)
    return folder


def part_of(folder: str, key: str, value: int) -> pa.Table | None:
    """The rows of one value; None if it has none."""
    store, path = opened(folder)
    found = store.get_file_info(fs.FileSelector(f"{path}/{key}={value}", allow_not_found=True))
    files = sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet"))
    return pa.concat_tables([pq.read_table(f, filesystem=store, partitioning=None) for f in files]) if files else None
