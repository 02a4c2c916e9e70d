"""The k closest pairs of series without all pairs.

A series is a vector of as many values as there are bars. Means over a few stretches of time, scaled, are coordinates of an
orthogonal projection, so their distance, with the difference of what the projection leaves of each, is at most that of the
series. Neighbours along one coordinate give k exact distances, of which the largest bounds the search; series go to grid
cells of that size, only those of touching cells meet, those whose bound is too large are left out, and the rest are verified
on the whole vectors. The result is exact whatever the data; only the number of verified pairs depends on them.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ("sym_y", "sym_x")
#: Coordinates of a series, those that make the grid, and neighbours along one that give the first bound.
WAVES, GRID, RUN = 16, 3, 32


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def whole_series(bars: DataFrame, x: str = "close") -> DataFrame:
    """symbol and v, the values in order of time, of symbols that have a value at each time there is (once)."""
    times = bars.select("bar_ts").distinct().agg(F.count("*").alias("times"))  # one row
    rows = bars.where(F.col("symbol").isNotNull() & F.col("bar_ts").isNotNull() & F.col(x).isNotNull())
    listed = rows.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("bar_ts", F.col(x).cast("double").alias("x")))).alias("s"), F.count_distinct("bar_ts").alias("n"))
    return listed.crossJoin(F.broadcast(times)).where((F.col("n") == F.col("times")) & (F.size("s") == F.col("n"))).select("symbol", F.col("s.x").alias("v"))


def unit(series: DataFrame) -> DataFrame:
    """Vectors less their mean and of length 1, whose squared distance is 2 (1 - correlation); constant ones are left out."""
    centred = series.withColumn("v", F.transform("v", lambda a: a - total(F.col("v")) / F.size("v")))
    length = centred.withColumn("l", F.sqrt(total(F.transform("v", lambda a: a * a)))).where("l > 1e-9")
    return length.select("symbol", F.transform("v", lambda a: a / F.col("l")).alias("v"))


def sketched(vectors: DataFrame, size: int) -> DataFrame:
    """symbol and c: coordinates, and last the length of what they leave."""
    waves = min(WAVES, size)
    cuts = [j * size // waves for j in range(waves + 1)]
    means = [total(F.slice("v", a + 1, b - a)) / math.sqrt(b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    held = vectors.select("symbol", F.array(*means).alias("c"), total(F.transform("v", lambda a: a * a)).alias("l"))
    left = F.sqrt(F.greatest(F.col("l") - total(F.transform("c", lambda a: a * a)), F.lit(0.0)))
    return held.select("symbol", F.concat("c", F.array(left)).alias("c"))


def measured(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """sym_y, sym_x and the exact squared distance d2."""
    y, x = (vectors.select(F.col("symbol").alias(s), F.col("v").alias(f"v_{s}")) for s in PAIR)
    return pairs.select(*PAIR).join(y, "sym_y").join(x, "sym_x").select(*PAIR, squared(F.col("v_sym_y"), F.col("v_sym_x")).alias("d2"))


def candidates(vectors: DataFrame, k: int) -> DataFrame:
    """sym_y < sym_x: all pairs that can be among the k closest, ties with the last included."""
    vectors = vectors.persist()
    size = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    sketch = sketched(vectors, size).persist()
    spread = sketch.agg(*(F.var_pop(F.col("c")[j]).alias(str(j)) for j in range(min(WAVES, size)))).first()
    axes = sorted(range(len(spread)), key=lambda j: -(spread[j] or 0.0))[:GRID]
    ordered = sketch.repartitionByRange(F.col("c")[axes[0]]).sortWithinPartitions(F.col("c")[axes[0]])
    runs = ordered.select("symbol", F.floor(F.monotonically_increasing_id() / RUN).alias("run")).persist()
    first = runs.select("run", F.col("symbol").alias("sym_y")).join(runs.select("run", F.col("symbol").alias("sym_x")), "run").where("sym_y < sym_x")
    bound = measured(first, vectors).orderBy("d2").limit(k).agg(F.count("*").alias("n"), F.max("d2").alias("d2")).first()
    y = sketch.select(F.col("symbol").alias("sym_y"), F.col("c").alias("a"))
    x = sketch.select(F.col("symbol").alias("sym_x"), F.col("c").alias("b"))
    if bound.n < k:  # fewer pairs than asked for, or hardly more
        return y.join(x, F.col("sym_y") < F.col("sym_x")).select(*PAIR)
    reach = math.sqrt(bound.d2) * (1 + 1e-9) + 2e-3 * (bound.d2 == 0) + 1e-6
    cell = lambda c, off: F.array(*(F.floor(c[j] / reach) + o for j, o in zip(axes, off, strict=True)))
    around = F.explode(F.array(*(cell(F.col("a"), off) for off in itertools.product((-1, 0, 1), repeat=len(axes)))))
    met = y.withColumn("cell", around).join(x.withColumn("cell", cell(F.col("b"), [0] * len(axes))), "cell").where("sym_y < sym_x")
    return met.where(squared(F.col("a"), F.col("b")) <= reach * reach).select(*PAIR)


def top_correlated(bars: DataFrame, k: int, x: str = "close") -> DataFrame:
    """The k pairs of the highest correlation (rounded to 6 digits, ties by name), of symbols with a value at each bar:
    sym_y, sym_x, corr, n, and verified, the number of pairs whose correlation was computed."""
    vectors = unit(whole_series(bars, x)).persist()
    found = measured(candidates(vectors, k), vectors).persist()
    n = bars.select("bar_ts").distinct().count()
    top = found.select(*PAIR, (1 - F.col("d2") / 2).alias("corr")).orderBy(F.round("corr", 6).desc(), *PAIR).limit(k)
    return top.select(*PAIR, "corr", F.lit(n).cast("long").alias("n"), F.lit(found.count()).cast("long").alias("verified"))


def closest_prices(bars: DataFrame, k: int, x: str = "close") -> DataFrame:
    """The k pairs of the least sum of squared differences of prices divided by their first: sym_y, sym_x, ssd, verified."""
    vectors = whole_series(bars, x).where("v[0] <> 0").select("symbol", F.transform("v", lambda a: a / F.col("v")[0]).alias("v")).persist()
    found = measured(candidates(vectors, k), vectors).persist()
    top = found.orderBy(F.round("d2", 6), *PAIR).limit(k)
    return top.select(*PAIR, F.col("d2").alias("ssd"), F.lit(found.count()).cast("long").alias("verified"))
