"""Rolling windows in blocks against pandas over whole series."""

import datetime
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.operators import blocks, rolling, trading


@pytest.fixture(scope="module")
def series():
    """A long, an uneven, a short and a keyless series, with nulls, ties of value and a gap of years."""
    rng, start, rows = np.random.default_rng(5), datetime.datetime(2024, 1, 1), []
    for symbol, n in (("hot", 900), ("gap", 300), ("one", 1), (None, 200)):
        for i in range(n):
            at = start + datetime.timedelta(hours=i * (1 if symbol == "hot" else 7), days=4000 * (symbol == "gap" and i > 150))
            rows.append((symbol, at, None if rng.random() < 0.02 else float(rng.integers(1, 30))))
    return rows


@pytest.fixture(scope="module")
def bars(spark, series):
    return spark.createDataFrame(series, "symbol string, bar_ts timestamp_ntz, x double").repartition(5).cache()


@pytest.fixture(params=[10**6, 50], ids=["one block", "many blocks"])
def size(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", request.param)


def by_series(rows):
    frame = pd.DataFrame(rows, columns=["symbol", "bar_ts", "x"]).sort_values("bar_ts", kind="stable")
    return frame.groupby("symbol", dropna=False)


def found(df, *columns):
    return {(r.symbol, r.bar_ts): tuple(r[c] for c in columns) for r in df.collect()}


def close(a, b):
    return (a is None and (b is None or math.isnan(b))) or (a is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_statistics_are_pandas(spark, bars, series, size):
    got = found(rolling.rolling_stats(bars, 12), "mean", "total", "sd", "low", "high")
    assert len(got) == len(series)
    for symbol, g in by_series(series):
        w = g.x.rolling(12)
        want = zip(w.mean(), w.sum(), w.std(), w.min(), w.max(), strict=True)
        for at, row in zip(g.bar_ts, want, strict=True):
            assert all(map(close, got[(None if pd.isna(symbol) else symbol, at.to_pydatetime())], row))


@pytest.mark.parametrize("n, q", [(12, 0.5), (12, 0.9), (65, 0.5), (100, 0.33), (70, 0.0), (70, 1.0)])
def test_quantiles_are_pandas(spark, bars, series, size, n, q):
    got = found(rolling.rolling_quantile(bars, n, q), "q")
    assert len(got) == len(series)
    for symbol, g in by_series(series):
        for at, want in zip(g.bar_ts, g.x.rolling(n).quantile(q), strict=True):
            assert close(got[(None if pd.isna(symbol) else symbol, at.to_pydatetime())][0], want)


def test_returns_and_lags_are_pandas(spark, bars, series, size):
    got = found(rolling.with_returns(bars, "x"), "ret", "log_ret", "x")
    corr = {r.symbol: r.autocorr for r in rolling.autocorrelation(bars, 3).collect()}
    ratio = {r.symbol: r.vr for r in rolling.variance_ratio(bars, 4).collect()}
    for symbol, g in by_series(series):
        symbol = None if pd.isna(symbol) else symbol
        before = g.x.shift(1)
        for at, ret, log in zip(g.bar_ts, g.x / before - 1, np.log(g.x) - np.log(before), strict=True):
            row = got[(symbol, at.to_pydatetime())]
            assert close(row[0], ret) and close(row[1], log)
        both = pd.DataFrame({"y": g.x, "x": g.x.shift(3)}).dropna()
        assert symbol not in corr or close(corr[symbol], both.y.corr(both.x))
        assert close(ratio[symbol], (g.x - g.x.shift(4)).var() / (4 * (g.x - before).var()))


def test_no_block_holds_more_than_its_rows_and_its_reach(spark, bars, series, monkeypatch):
    """A hot series is many blocks, whose own rows are each row once, in the order of time."""
    cut = blocks.blocked(bars, 10, size=60, seconds=86_400)
    sizes = cut.groupBy("symbol", "_block").agg(F.count("*").alias("n"), F.count_if("_own").alias("own")).collect()
    assert max(r.n for r in sizes) <= 70 and max(r.own for r in sizes) == 60 and sum(r.own for r in sizes) == len(series)
    rows = cut.where("_own and symbol = 'gap'").orderBy("bar_ts").select("_row").collect()
    assert [r[0] for r in rows] == list(range(300))


def test_a_window_over_many_sparse_parts(spark, bars, series):
    """Parts of time with a row each: a window reaches over many of them."""
    cut = blocks.blocked(bars.where("symbol = 'gap'"), 40, size=160, seconds=3600)
    assert cut.where("_block = 1").agg(F.min("_row")).first()[0] == 120


def test_long_windows_take_time_in_proportion(spark):
    rng = np.random.default_rng(3)
    x, known = rng.normal(size=400_000), np.ones(400_000, bool)
    began = time.perf_counter()
    got = rolling.sliding_quantile(x, known, 5000, 0.5)
    assert time.perf_counter() - began < 20
    for i in rng.integers(5000, 400_000, 50):
        assert math.isclose(got[i], np.median(x[i - 4999 : i + 1]), rel_tol=1e-12)


@pytest.mark.parametrize("shape", ["rising", "falling", "equal", "saw"])
def test_hard_orders_of_values(shape):
    i = np.arange(3000.0)
    x = {"rising": i, "falling": -i, "equal": 0 * i, "saw": i % 7}[shape]
    known = np.arange(3000) % 501 != 0
    got = rolling.sliding_quantile(x, known, 100, 0.25)
    want = pd.Series(np.where(known, x, np.nan)).rolling(100).quantile(0.25).to_numpy()
    assert np.allclose(got, want, equal_nan=True)


def test_empty_series(spark):
    empty = spark.createDataFrame([], "symbol string, bar_ts timestamp_ntz, x double")
    for n in (3, 100):
        assert rolling.rolling_quantile(empty, n, 0.5).count() == rolling.rolling_stats(empty, n).count() == 0


@pytest.mark.parametrize("seconds", [3600, 86_400, 10**9])
def test_values_so_far_are_pandas(spark, bars, series, seconds):
    said = F.when(F.col("x") > 25, F.col("x"))
    last = found(blocks.running_last(bars, said, "v", seconds=seconds), "v")
    total = found(blocks.running_sum(bars, F.col("x"), "v", seconds=seconds), "v")
    assert len(last) == len(total) == len(series)
    for symbol, g in by_series(series):
        symbol = None if pd.isna(symbol) else symbol
        for at, a, b in zip(g.bar_ts, g.x.where(g.x > 25).ffill(), g.x.cumsum().ffill(), strict=True):
            assert close(last[(symbol, at.to_pydatetime())][0], a) and close(total[(symbol, at.to_pydatetime())][0], b)


def test_positions_in_parts_are_those_of_one_window(spark, bars):
    scored = bars.select(F.col("symbol").alias("sym_y"), F.lit("b").alias("sym_x"), "bar_ts", ((F.col("x") - 15) / 8).alias("z"))
    whole, parts = trading.positions(scored), trading.positions(scored, part_seconds=7200)
    assert whole.columns == parts.columns and whole.exceptAll(parts).count() == parts.exceptAll(whole).count() == 0
    assert {r.pos for r in parts.select("pos").distinct().collect()} == {-1, 0, 1}
