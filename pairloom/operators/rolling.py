"""Returns and rolling statistics. Bars carry symbol, bar_ts and x; frames are the last n rows and give null until full.

Windows over a fixed number of rows run in blocks of a series (`blocks`), so a long series is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from pairloom.functions.stats import full, safe_beta, safe_corr, zscore

from .blocks import blocked, running_sum, with_windows
from .sequential import PART_SECONDS, Recursion, scanned_in_parts

#: Rolling quantiles of up to so many rows sort each row's window in the JVM; longer ones slide an ordered set.
SORTED_ROWS = 64


def rolled(rows: DataFrame, n: int, made: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """symbol, bar_ts and columns made of the last n rows."""
    out = with_windows(rows, n - 1, lambda w: made(w.rowsBetween(-(n - 1), 0)))
    return out.drop(*(c for c in rows.columns if c not in ("symbol", "bar_ts")))


def with_returns(bars: DataFrame, x: str = "close") -> DataFrame:
    """ret (simple) and log_ret; null at the start and where a price is not positive."""
    log = lambda c: F.when(c > 0, F.ln(c))
    before = lambda w: F.lag(x).over(w)
    return with_windows(bars, 1, lambda w: {"ret": F.try_divide(F.col(x), before(w)) - 1, "log_ret": log(F.col(x)) - log(before(w))})


def with_cumulative(returns: DataFrame) -> DataFrame:
    """cum_ret of all log returns so far; parts of a series run at once."""
    return running_sum(returns, F.col("log_ret"), "_sum").withColumn("cum_ret", F.exp("_sum") - 1).drop("_sum")


def rolling_stats(bars: DataFrame, n: int, x: str = "x") -> DataFrame:
    c = F.col("_x")
    parts = {"mean": F.avg, "total": F.sum, "sd": F.stddev_samp, "low": F.min, "high": F.max}
    return rolled(bars.select("symbol", "bar_ts", F.col(x).alias("_x")), n, lambda w: {name: full(f(c).over(w), c, w, n) for name, f in parts.items()})


def rolling_zscore(bars: DataFrame, n: int, x: str = "x") -> DataFrame:
    return rolled(bars.select("symbol", "bar_ts", F.col(x).alias("_x")), n, lambda w: {"z": zscore(F.col("_x"), w, n)})


def rolling_volatility(returns: DataFrame, n: int, per_year: int) -> DataFrame:
    c = F.col("log_ret")
    return rolled(returns.select("symbol", "bar_ts", c), n, lambda w: {"vol": full(F.stddev_samp(c).over(w), c, w, n) * math.sqrt(per_year)})


def rolling_relation(panel: DataFrame, n: int) -> DataFrame:
    """Covariance, correlation and beta of y on x over the last n rows."""
    y, x = F.col("y"), F.col("x")
    return rolled(panel.select("symbol", "bar_ts", "y", "x"), n, lambda w: {"cov": full(F.covar_samp(y, x).over(w), x, w, n), "corr": full(safe_corr(y, x, w), x, w, n), "beta": full(safe_beta(y, x, w), x, w, n)})


def sliding_quantile(x: np.ndarray, known: np.ndarray, n: int, q: float) -> np.ndarray:
    """Interpolated quantile of the last n values at each place, NaN where one of them is not known or there are fewer.

    The values in the window are marks in a string of all ranks of x; a step moves the place of the wanted rank by at most
    two marks, which are found by a byte search."""
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x))
    value, ranks, counts = x[order].tolist(), rank.tolist(), known.tolist()
    lo, part = math.floor(q * (n - 1)), q * (n - 1) - math.floor(q * (n - 1))
    marks, size, at, below = bytearray(len(x)), 0, -1, 0  # below: marks before the one at `at`; -1: nowhere
    out = np.full(len(x), np.nan)
    for i, r in enumerate(ranks):
        if i >= n and counts[i - n]:
            gone = ranks[i - n]
            marks[gone] = 0
            size -= 1
            below -= gone < at
            if gone == at:  # the next mark has as many before it; without one, the mark before has one less
                at = marks.find(1, gone)
                if at < 0:
                    at, below = marks.rfind(1, 0, gone), below - 1
        if counts[i]:
            marks[r] = 1
            size += 1
            if at < 0:
                at, below = r, 0
            else:
                below += r < at
        if size == n:
            while below > lo:
                at, below = marks.rfind(1, 0, at), below - 1
            while below < lo:
                at, below = marks.find(1, at + 1), below + 1
            low = value[at]
            high = value[marks.find(1, at + 1)] if lo + 1 < n else low
            out[i] = low + (high - low) * part
    return out


def rolling_quantile(bars: DataFrame, n: int, q: float, x: str = "x") -> DataFrame:
    """Interpolated quantile of the last n values. Short windows are sorted arrays; for long ones a block of the series
    slides an ordered set, so time hardly grows with n."""
    rows = bars.select("symbol", "bar_ts", F.col(x).cast("double").alias("_x"))
    if n <= SORTED_ROWS:
        at = q * (n - 1)
        lo, part = math.floor(at), at - math.floor(at)
        listed = rolled(rows, n, lambda w: {"s": F.sort_array(F.collect_list("_x").over(w))})
        low, high = F.get("s", F.lit(lo)), F.get("s", F.lit(min(lo + 1, n - 1)))
        return listed.select("symbol", "bar_ts", F.when(F.size("s") == n, low + (high - low) * part).alias("q"))

    def slide(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_row", kind="stable")
        known = block["_known"].to_numpy(bool)
        run = np.cumsum(known)
        run[n:] = run[n:] - run[:-n]
        found = sliding_quantile(block["_x"].to_numpy(float), known, n, q)
        made = block[["symbol", "bar_ts"]].assign(q=found, _full=run == n)
        return made[block["_own"].to_numpy(bool)]

    cut = blocked(rows, n - 1).withColumn("_known", F.col("_x").isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = cut.groupBy("symbol", "_block").applyInPandas(slide, f"symbol {kinds['symbol']}, bar_ts {kinds['bar_ts']}, q double, _full boolean")
    return found.select("symbol", "bar_ts", F.when(F.col("_full"), F.coalesce("q", F.lit(math.nan))).alias("q"))


def exponential_rule(alpha: float) -> Recursion:
    """The mean as an affine map of the mean before: factor, addend, and what comes of no mean before (NaN: none)."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (mean,), (value,) = state, row
        mean = mean if value is None else value if mean is None else alpha * value + (1 - alpha) * mean
        return (mean,), (mean,)

    def of_rows(columns: list[np.ndarray]) -> list[float]:
        x = np.array([v for v in columns[0] if v is not None], float)
        if not len(x):
            return [1.0, 0.0, math.nan]
        weights = (1 - alpha) ** np.arange(len(x) - 1, -1, -1.0)
        added = float(alpha * (weights @ x))
        return [float((1 - alpha) ** len(x)), added, added + float((1 - alpha) * weights[0] * x[0])]

    def composed(first: list[float], then: list[float]) -> list[float]:
        alone = then[2] if math.isnan(first[2]) else then[0] * first[2] + then[1]
        return [first[0] * then[0], then[0] * first[1] + then[1], alone]

    def passed(map_: list[float], state: tuple) -> tuple:
        if state[0] is None:
            return (None if math.isnan(map_[2]) else map_[2],)
        return (map_[0] * state[0] + map_[1],)

    return Recursion((None,), step, "ewm double", "_mean double", of_rows, composed, passed)


def exponential_mean(bars: DataFrame, alpha: float, x: str = "x", part_seconds: int = PART_SECONDS) -> DataFrame:
    """s = alpha x + (1 - alpha) s[-1], from the first value on; a null leaves s as it is. Parts of a series run at once."""
    rows = bars.select("symbol", "bar_ts", F.col(x).cast("double").alias("x"))
    return scanned_in_parts(rows, ("symbol",), ("bar_ts",), ("x",), exponential_rule(alpha), part_seconds).select("symbol", "bar_ts", "ewm")


def lagged(bars: DataFrame, x: str, lags: dict[str, int]) -> DataFrame:
    """symbol, _x, and x so many rows before under each name."""
    rows = bars.select("symbol", "bar_ts", F.col(x).alias("_x"))
    return with_windows(rows, max(lags.values()), lambda w: {name: F.lag("_x", k).over(w) for name, k in lags.items()})


def autocorrelation(bars: DataFrame, k: int, x: str = "x") -> DataFrame:
    both = lagged(bars, x, {"_before": k}).where("_x is not null and _before is not null")
    return both.groupBy("symbol").agg(safe_corr(F.col("_x"), F.col("_before")).alias("autocorr"))


def variance_ratio(returns: DataFrame, q: int, x: str = "x") -> DataFrame:
    """Variance of q-period changes over q times the variance of one-period changes."""
    d = lagged(returns, x, {"_one": 1, "_q": q}).select("symbol", (F.col("_x") - F.col("_one")).alias("d1"), (F.col("_x") - F.col("_q")).alias("dq"))
    return d.groupBy("symbol").agg((F.var_samp("dq") / F.nullif(q * F.var_samp("d1"), F.lit(0.0))).alias("vr"))


def hurst(bars: DataFrame, lags: tuple[int, ...], x: str = "x") -> DataFrame:
    """Slope of the log spread of k-lag differences on log k."""
    before = lagged(bars, x, {f"_lag{k}": k for k in lags})
    apart = before.select("symbol", F.array(*(F.struct(F.lit(k).alias("k"), (F.col("_x") - F.col(f"_lag{k}")).alias("d")) for k in lags)).alias("e"))
    each = apart.select("symbol", F.explode("e").alias("e"))
    sds = each.groupBy("symbol", F.col("e.k").alias("k")).agg(F.stddev_samp("e.d").alias("sd")).where("sd > 0")
    return sds.groupBy("symbol").agg(safe_beta(F.ln("sd"), F.ln("k")).alias("hurst"))
