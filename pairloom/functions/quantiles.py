"""Exact quantiles of groups of any size, without a group's values in one buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Groups up to SMALL rows are ranked whole; of larger ones only values whose rank is within NEAR of the quantile's.
SMALL, NEAR, ACCURACY = 20_000, 0.001, 10_000


def exact_quantiles(df: DataFrame, keys: tuple[str, ...], column: str, levels: tuple[float, ...]) -> DataFrame:
    """keys, level and value: quantiles with linear interpolation between the neighbouring ranks; nulls do not count.

    A sketch brackets each quantile between two values; rows below the bracket are counted, values inside it are counted
    one by one and ranked by running sums. The sketch only narrows the search: results are exact. What is ranked is about
    twice NEAR of a group, or fewer where values repeat."""
    x = F.col(column)
    rows = df.select(*keys, x.cast("double").alias("_x")).where("_x is not null")
    ends = [min(1.0, max(0.0, q + d)) for q in levels for d in (-NEAR, NEAR)]
    bounds = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_x", ends, ACCURACY).alias("_b"))
    whole = F.col("_n") <= SMALL
    each = F.explode(F.array(*(F.struct(F.lit(q).alias("level"), F.when(~whole & F.lit(q > NEAR), F.col("_b")[2 * i]).alias("lo"), F.when(~whole & F.lit(q < 1 - NEAR), F.col("_b")[2 * i + 1]).alias("hi")) for i, q in enumerate(levels))))
    bounds = bounds.select(*(F.col(k).alias(f"_{k}") for k in keys), "_n", each.alias("_q"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = same[0] if same else F.lit(True)
    for s in same[1:]:
        on = on & s
    met = rows.join(F.broadcast(bounds) if not keys else bounds, on).select(*keys, "_x", "_n", "_q.level", "_q.lo", "_q.hi")
    below = F.col("lo").isNotNull() & (F.col("_x") < F.col("lo"))
    inside = ~below & (F.col("hi").isNull() | (F.col("_x") <= F.col("hi")))
    # Values below the bracket count as one value before all others.
    counted = met.where(below | inside).groupBy(*keys, "level", "_n", F.when(inside, F.col("_x")).alias("_v")).agg(F.count("*").alias("_k"))
    order = Window.partitionBy(*keys, "level").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_upto", F.sum("_k").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.col("level") * (F.col("_n") - 1)
    low = F.min(F.when(F.col("_v").isNotNull() & (F.col("_upto") > F.floor(at)), F.col("_v")))
    high = F.min(F.when(F.col("_v").isNotNull() & (F.col("_upto") > F.ceil(at)), F.col("_v")))
    part = F.first(at - F.floor(at))
    return ranked.groupBy(*keys, "level").agg((low + (high - low) * part).alias("value"))


def quantile_columns(df: DataFrame, keys: tuple[str, ...], column: str, levels: dict[str, float]) -> DataFrame:
    """keys and one column a level."""
    found = exact_quantiles(df, keys, column, tuple(levels.values()))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("level") == q, F.col("value"))).alias(name) for name, q in levels.items()))
