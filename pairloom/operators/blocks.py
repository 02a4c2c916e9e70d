"""Long series in pieces that run at once: blocks of rows for windows over a fixed number of rows, parts of time for values
of all rows so far.

Rows get their number in the series from counts of its parts of time, so no task reads a whole series. A block is `size`
rows in a row; those of its end that a window of the next blocks reaches back to are copied there. So a window partitioned
by block sees what one partitioned by series would, and the largest task is a block, however long or uneven a series is.

Defined results: rows of null time come first; the order of rows of equal time is arbitrary, but the same for all columns of
one call; null keys are a series of their own; empty tables give empty results. The rows are read twice, once for times
alone: store them first if they are costly to make.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .sequential import PART_SECONDS, time_part

#: Rows of a block, and its least multiple of the rows that a window reaches back, so that copies are a quarter at most.
BLOCK_ROWS, REACHES = 131_072, 4
NO_TIME = -(1 << 62)


def numbered(df: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "bar_ts", seconds: int = PART_SECONDS) -> DataFrame:
    """The rows with `_row`, their number from 0 in the order of ts within each key."""
    rows = df.withColumn("_part", F.coalesce(time_part(ts, seconds), F.lit(NO_TIME)))
    counted = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    so_far = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    fine = (*keys, "_part")
    before = counted.select(*(F.col(k).alias(f"_of_{k}") for k in fine), F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    inside = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*fine).orderBy(ts)) - 1)
    on = F.col("_part") == F.col("_of__part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return inside.join(before, on).select(*df.columns, (F.col("_row") + F.col("_before")).alias("_row"))


def blocked(df: DataFrame, back: int, keys: tuple[str, ...] = ("symbol",), ts: str = "bar_ts", size: int | None = None, seconds: int = PART_SECONDS) -> DataFrame:
    """The rows with `_row`, `_block` and `_own`: each in its own block, and those that a later row of another block reaches
    back to, `back` rows at most, there as well with _own false."""
    size = max(size or BLOCK_ROWS, REACHES * back, 1)
    own, reach = F.floor(F.col("_row") / size), F.floor((F.col("_row") + back) / size)
    placed = numbered(df, keys, ts, seconds).withColumn("_block", F.explode(F.sequence(own, reach)))
    return placed.withColumn("_own", F.col("_block") == own)


def in_blocks(keys: tuple[str, ...] = ("symbol",)) -> WindowSpec:
    return Window.partitionBy(*keys, "_block").orderBy("_row")


def with_windows(df: DataFrame, back: int, made: Callable[[WindowSpec], dict[str, Column]], keys: tuple[str, ...] = ("symbol",), ts: str = "bar_ts", size: int | None = None) -> DataFrame:
    """The rows with columns of windows that reach back so many rows; made gets the window of a block in order of time."""
    return blocked(df, back, keys, ts, size).withColumns(made(in_blocks(keys))).where("_own").drop("_row", "_block", "_own")


def carried(df: DataFrame, name: str, end: Column, over_parts: Callable[[WindowSpec], Column], over_rows: Callable[[WindowSpec], Column], keys: tuple[str, ...], ts: str, seconds: int) -> DataFrame:
    """The rows with column `name` of all rows so far, in parts of time that run at once: over_rows over the rows of the
    part so far, which may use `_before`, what over_parts makes of `_end`, the aggregate `end` of each part before."""
    fine = (*keys, "_part")
    rows = df.withColumn("_part", F.coalesce(time_part(ts, seconds), F.lit(NO_TIME)))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*fine).agg(end.alias("_end")).select(*(F.col(k).alias(f"_of_{k}") for k in fine), over_parts(earlier).alias("_before"))
    on = F.col("_part") == F.col("_of__part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    so_far = Window.partitionBy(*fine).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(ends, on).withColumn(name, over_rows(so_far)).drop("_part", "_before", *(f"_of_{k}" for k in fine))


def running_last(df: DataFrame, value: Column, name: str, keys: tuple[str, ...] = ("symbol",), ts: str = "bar_ts", seconds: int = PART_SECONDS) -> DataFrame:
    """The rows with the last value so far that is not null."""
    end = F.max_by(value, F.when(value.isNotNull(), F.struct(ts)))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    return carried(df, name, end, lambda w: last("_end", w), lambda w: F.coalesce(last(value, w), F.col("_before")), keys, ts, seconds)


def running_sum(df: DataFrame, value: Column, name: str, keys: tuple[str, ...] = ("symbol",), ts: str = "bar_ts", seconds: int = PART_SECONDS) -> DataFrame:
    """The rows with the sum so far of the values that are not null; null before the first."""
    total = lambda w: F.sum(value).over(w)
    return carried(df, name, F.sum(value), lambda w: F.sum("_end").over(w), lambda w: F.coalesce(total(w) + F.coalesce("_before", F.lit(0)), "_before"), keys, ts, seconds)
