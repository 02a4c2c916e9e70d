"""Factors of a panel of many symbols, by block power iteration over its long table.

The loadings are a table of one row a symbol with k numbers, and a few more (SPARE), which make the rounds few where the next
factors are nearly as strong. A round multiplies the panel by them (sums by time), and the
transposed panel by the result (sums by symbol), both with partial sums before they are shuffled; then the k columns are made
orthonormal, for which only the sums of their products come to the driver. So neither symbols nor times are columns, and nothing of
their number is in one place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.sources.tables import shared_path

from .panel import aligned


#: Columns beyond those asked for.
SPARE = 8


def stored(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read again: a round's plan ends there."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def products(table: DataFrame, names: list[str]) -> np.ndarray:
    """The sums of products of all pairs of columns."""
    k = len(names)
    row = table.agg(*(F.sum(F.col(names[i]) * F.col(names[j])) for i in range(k) for j in range(k))).first()
    return np.array([v or 0.0 for v in row], float).reshape(k, k)


def turned(table: DataFrame, key: str, names: list[str], by: np.ndarray) -> DataFrame:
    """The columns as a matrix times a small one, which may have fewer columns."""
    return table.select(key, *(sum((F.col(n) * F.lit(float(by[i, j])) for i, n in enumerate(names)), F.lit(0.0)).alias(names[j]) for j in range(by.shape[1])))


def factor_residuals(bars: DataFrame, k: int, x: str = "close", rounds: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """symbol, bar_ts and residual: what the first k principal factors leave of each symbol's value less its mean.

    Times at which a symbol has no value are left out, as are rows without symbol, time or value. Rounds go on until the
    factors' share of the variance changes by less than the tolerance; a panel of fewer than k independent symbols or times
    leaves nothing. An empty panel gives an empty table."""
    rows = bars.select("symbol", "bar_ts", F.col(x).cast("double").alias("x")).dropna()
    rows = stored(aligned(rows), "panel")
    means = rows.groupBy("symbol").agg(F.avg("x").alias("m"))
    centred = stored(rows.join(means, "symbol").select("symbol", "bar_ts", (F.col("x") - F.col("m")).alias("x")), "centred")
    names = [f"w{i}" for i in range(k + SPARE)]
    total = centred.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0
    by_symbol = centred.select("symbol").distinct().select("symbol", *((F.xxhash64("symbol", F.lit(i)) / float(1 << 63)).alias(n) for i, n in enumerate(names)))
    vectors = np.eye(len(names))
    along = lambda table, key, over: centred.join(table, over).groupBy(key).agg(*(F.sum(F.col("x") * F.col(n)).alias(n) for n in names))
    share = 0.0
    for _ in range(rounds if total else 0):
        by_symbol = stored(along(along(by_symbol, "bar_ts", "symbol"), "symbol", "bar_ts"), "loadings")
        for _ in range(2):  # twice, as once leaves rounding of nearly dependent columns
            values, vectors = np.linalg.eigh(products(by_symbol, names))
            kept = values > 1e-14 * max(values.max(), 0.0)
            by_symbol = turned(by_symbol, "symbol", names, vectors * np.where(kept, 1 / np.sqrt(np.where(kept, values, 1.0)), 0.0))
        by_symbol = stored(by_symbol, "loadings")
        values, vectors = np.linalg.eigh(products(along(by_symbol, "bar_ts", "symbol"), names))
        before, share = share, float(values[-k:].sum()) / total
        if abs(share - before) <= tolerance * share:
            break
    by_symbol = stored(turned(by_symbol, "symbol", names, vectors[:, -k:]), "loadings")  # the strongest k of what the columns span
    names = names[:k]
    by_time = along(by_symbol, "bar_ts", "symbol").withColumnsRenamed({n: f"f{n}" for n in names})
    fitted = sum((F.col(n) * F.col(f"f{n}") for n in names), F.lit(0.0))
    return centred.join(by_symbol, "symbol").join(by_time, "bar_ts").select("symbol", "bar_ts", (F.col("x") - fitted).alias("residual"))
