"""Panels: bars, calendars, filling, as-of and range joins, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.quantiles import quantile_columns


def time_bars(ticks: DataFrame, every: str) -> DataFrame:
    """OHLC, mean and count per symbol and bucket; partial aggregation leaves one row per key and task to shuffle."""
    w = F.window("ts", every)
    return ticks.groupBy("symbol", w.alias("w")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.avg("price").alias("avg_price"), F.count("*").alias("n"),
    ).select("symbol", F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "avg_price", "n")


def calendar_spine(bars: DataFrame, every: str) -> DataFrame:
    """Every bucket start between the first and the last, for every symbol."""
    ends = bars.agg(F.min("bar_ts").alias("lo"), F.max("bar_ts").alias("hi"))  # one row
    return bars.select("symbol").distinct().crossJoin(F.broadcast(ends)).select("symbol", F.explode(F.sequence("lo", "hi", F.expr(f"interval {every}"))).alias("bar_ts"))


def carried_forward(bars: DataFrame, spine: DataFrame, column: str = "close") -> DataFrame:
    """symbol, bar_ts, column, filled: the last value known at each place of the spine."""
    w = Window.partitionBy("symbol").orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(bars.select("symbol", "bar_ts", column), ["symbol", "bar_ts"], "left").withColumn("filled", F.last(column, ignorenulls=True).over(w))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, tie: str, within: str | None = None, bucket_seconds: int = 86_400) -> DataFrame:
    """Left rows with as_of_ts and as_of_value of the last right row of the key at or before ts.

    Right rows stand before left rows of equal ts; of right rows of equal ts the one with the largest `tie` counts (null is
    the smallest). A null key or time matches nothing: such right rows are left out, such left rows have nulls. A key
    is cut into time buckets, so a busy key spreads over tasks: within a bucket one sorted union finds the row, and the
    last right row of earlier buckets is handed on over a table of one row a key and bucket."""
    names = left.columns
    known = F.col(key).isNotNull() & F.col(ts).isNotNull()
    unknown, left, right = left.where(~known), left.where(known), right.where(known)
    bucket = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / bucket_seconds).alias("_b")
    found = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(value).alias("value"))
    kind = right.select(found.alias("f")).schema["f"].dataType
    l = left.select(*names, bucket, F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_found"), F.col(tie).alias("_tie"))  # noqa: E741
    r = right.select(*(F.col(c) if c in (key, ts) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names), bucket, F.lit(0).alias("_side"), found.alias("_found"), F.col(tie).alias("_tie"))
    w = Window.partitionBy(key, "_b").orderBy(ts, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("_last", F.last("_found", ignorenulls=True).over(w)).where("_side = 1")
    # One row a key and bucket: the last right row in it (none if only left rows are there), then of all buckets before.
    marks = right.select(F.col(key), bucket, found.alias("f")).unionByName(left.select(F.col(key), bucket, F.lit(None).cast(kind).alias("f"))).groupBy(key, "_b").agg(F.max("f").alias("f"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.last("f", ignorenulls=True).over(earlier).alias("_before")).where("_before is not null")
    out = out.join(carried, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")), "left").withColumn("_last", F.coalesce("_last", "_before"))
    near = F.lit(True) if within is None else F.col("_last.ts") >= F.col(ts) - F.expr(f"interval {within}")
    found = out.select(*names, F.when(near, F.col("_last.ts")).alias("as_of_ts"), F.when(near, F.col("_last.value")).alias("as_of_value"))
    return found.unionByName(unknown.select(*names, *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("as_of_ts", "as_of_value"))))


def range_join(left: DataFrame, right: DataFrame, key: str, seconds: int) -> DataFrame:
    """Pairs of equal key with right.ts in [left.ts - seconds, left.ts].

    Right rows go to their time bucket and left rows to the two they can reach, so the join is on key and bucket and a
    busy key is split over its buckets."""
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    l = left.withColumn("_b", F.explode(F.array(bucket("l_ts"), bucket("l_ts") - 1)))  # noqa: E741
    r = right.withColumn("_b", bucket("r_ts"))
    inside = (r.r_ts <= l.l_ts) & (r.r_ts >= l.l_ts - F.make_interval(secs=F.lit(seconds)))
    return l.join(r.withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & (l["_b"] == r["_b"]) & inside).drop("_b", "_k")


def aligned(bars: DataFrame) -> DataFrame:
    """Bars at times where every symbol has one."""
    symbols = bars.agg(F.count_distinct("symbol").alias("symbols"))
    times = bars.groupBy("bar_ts").agg(F.count_distinct("symbol").alias("has")).crossJoin(F.broadcast(symbols)).where("has = symbols")
    return bars.join(times.select("bar_ts"), "bar_ts", "left_semi")


def wide(bars: DataFrame, column: str = "close") -> DataFrame:
    """bar_ts and a column for each symbol there is (Spark looks for them first, and refuses more than its
    spark.sql.pivotMaxValues)."""
    return bars.groupBy("bar_ts").pivot("symbol").agg(F.first(column))


def winsorized(ticks: DataFrame, lo: float, hi: float) -> DataFrame:
    """All ticks, with the price held between two exact quantiles of the symbol. Ticks without symbol are a group like any
    other; a null price stays null, and a symbol without prices has no quantiles."""
    bounds = quantile_columns(ticks, ("symbol",), "price", {"lo": lo, "hi": hi}).withColumnRenamed("symbol", "_symbol")
    met = ticks.join(bounds, F.col("symbol").eqNullSafe(F.col("_symbol")), "left").drop("_symbol")
    return met.withColumn("winsorized", F.when(F.col("price").isNotNull(), F.greatest(F.least("price", "hi"), F.col("lo"))))


def gaps(bars: DataFrame, every_seconds: int) -> DataFrame:
    """Places where a symbol's next bar is further away than one bucket: symbol, after, until, missing."""
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    away = F.unix_seconds(F.col("bar_ts").cast("timestamp")) - F.unix_seconds(F.lag("bar_ts").over(w).cast("timestamp"))
    return bars.select("symbol", F.lag("bar_ts").over(w).alias("after"), F.col("bar_ts").alias("until"), (F.floor(away / every_seconds) - 1).cast("long").alias("missing")).where("missing > 0")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
