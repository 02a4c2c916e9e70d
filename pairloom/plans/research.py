"""Queries of the research operators, with the SQL that defines the same results.

Floating results are rounded to six places at the end, on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.stats import round6, sample_kurtosis, sample_skewness
from pairloom.operators import pairs as P
from pairloom.operators import factors, panel, rolling, screens, trading
from pairloom.operators.sequential import PART_SECONDS
from pairloom.sources.tables import price_panel, table
from pairloom.streaming import jobs

N, ENTRY, LEAVE, COST, YEAR, SPLIT = 10, 1.0, 0.5, 0.01, 252, "2024-01-16"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_W = "PARTITION BY symbol ORDER BY bar_ts"
_LAST = f"({_W} ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW)"
_PW = "(PARTITION BY sym_y, sym_x ORDER BY bar_ts)"
_BARS = """bars AS (SELECT event_type AS symbol, time_bucket(INTERVAL '{every}', ts) AS bar_ts, arg_min(value, event_id) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, event_id) AS close, avg(value) AS avg_price, count(*) AS n FROM events GROUP BY ALL)"""
_DAILY, _HOURLY = _BARS.format(every="1 day"), _BARS.format(every="1 hour")
_RETURNS = f"rets AS (SELECT *, close / nullif(lag(close) OVER ({_W}), 0) - 1 AS ret, CASE WHEN close > 0 THEN ln(close) END - CASE WHEN lag(close) OVER ({_W}) > 0 THEN ln(lag(close) OVER ({_W})) END AS log_ret FROM bars)"
_PAIRS = "pairs AS (SELECT a.symbol AS sym_y, b.symbol AS sym_x, a.bar_ts AS bar_ts, a.avg_price AS y, b.avg_price AS x FROM bars a JOIN bars b ON a.bar_ts = b.bar_ts WHERE a.symbol < b.symbol)"
_BETA = "covar_pop(y, x) / nullif(var_pop(x), 0)"
_RATIOS = f"ratios AS (SELECT sym_y, sym_x, {_BETA} AS beta, avg(y) - {_BETA} * avg(x) AS alpha FROM pairs GROUP BY ALL)"
_SPREADS = "spreads AS (SELECT p.sym_y, p.sym_x, bar_ts, y, x, alpha, beta, y - alpha - beta * x AS spread FROM pairs p JOIN ratios r ON p.sym_y = r.sym_y AND p.sym_x = r.sym_x)"
_SCORED = f"scored AS (SELECT *, CASE WHEN count(spread) OVER w = {N} THEN (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0) END AS z FROM spreads WINDOW w AS (PARTITION BY sym_y, sym_x ORDER BY bar_ts ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW))"
_DECIDE = "CASE WHEN z < -{e} THEN 1 WHEN z > {e} THEN -1 WHEN abs(z) < {l} THEN 0 END"
_POS = f"posd AS (SELECT *, CAST(coalesce(last_value({_DECIDE.format(e=ENTRY, l=LEAVE)} IGNORE NULLS) OVER (PARTITION BY sym_y, sym_x ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS pos FROM scored)"
_MADE = "coalesce(lag(pos) OVER w, 0) * coalesce((y - lag(y) OVER w) - beta * (x - lag(x) OVER w), 0) - {c} * abs(pos - coalesce(lag(pos) OVER w, 0)) AS pnl"
_EARNED = f"earned AS (SELECT *, {_MADE.format(c=COST)} FROM posd WINDOW w AS {_PW})"
_TO_SPREADS = f"{_DAILY}, {_PAIRS}, {_RATIOS}, {_SPREADS}"
_TO_EARNED = f"{_TO_SPREADS}, {_SCORED}, {_POS}, {_EARNED}"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def daily(spark: SparkSession, d: str) -> DataFrame:
    return panel.time_bars(price_panel(spark, d), "1 day")


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return panel.time_bars(price_panel(spark, d), "1 hour")


def series(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).select("symbol", "bar_ts", F.col("avg_price").alias("x"))


def pairs_of(spark: SparkSession, d: str) -> DataFrame:
    return P.candidate_pairs(daily(spark, d), "avg_price")


def spread_of(spark: SparkSession, d: str) -> DataFrame:
    pairs = pairs_of(spark, d)
    return P.spreads(pairs, P.hedge_ratios(pairs))


def scored_of(spark: SparkSession, d: str) -> DataFrame:
    return P.spread_zscores(spread_of(spark, d), N)


def earned_of(spark: SparkSession, d: str) -> DataFrame:
    return trading.pnl(trading.positions(scored_of(spark, d), ENTRY, LEAVE), COST)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: round6(F.col(c)) for c in columns})


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@query("flagship_pair_spread", f"WITH {_TO_SPREADS}, {_SCORED} SELECT sym_y, sym_x, bar_ts, {_r('spread', 'z')} FROM scored")
def flagship(spark, d):
    return rounded(scored_of(spark, d).select("sym_y", "sym_x", "bar_ts", "spread", "z"), "spread", "z")


@query("a01_price_panel", "SELECT event_type AS symbol, ts, event_id AS seq, value AS price, CAST(1 AS DOUBLE) AS qty FROM events")
def a01(spark, d):
    return price_panel(spark, d)


@query("a02_time_bars", f"WITH {_DAILY} SELECT symbol, bar_ts, open, high, low, close, round(avg_price, 6) AS avg_price, n FROM bars")
def a02(spark, d):
    return rounded(daily(spark, d), "avg_price")


_SPINE = "spine AS (SELECT symbol, unnest(generate_series((SELECT min(bar_ts) FROM bars), (SELECT max(bar_ts) FROM bars), INTERVAL '1 hour')) AS bar_ts FROM (SELECT DISTINCT symbol FROM bars))"


@query("a03_calendar_spine", f"WITH {_HOURLY}, {_SPINE} SELECT symbol, bar_ts FROM spine")
def a03(spark, d):
    return panel.calendar_spine(hourly(spark, d), "1 hour")


@query("a04_carried_forward", f"WITH {_HOURLY}, {_SPINE} SELECT symbol, bar_ts, close, last_value(close IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM spine LEFT JOIN bars USING (symbol, bar_ts)")
def a04(spark, d):
    bars = hourly(spark, d)
    return panel.carried_forward(bars, panel.calendar_spine(bars, "1 hour"))


def _sides(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value", "event_type")
    return e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'view'").drop("event_type")


_ASOF = "SELECT l.user_id, l.ts, l.event_id, l.value, {t} AS as_of_ts, {v} AS as_of_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts"


@query("a05_as_of_join", _ASOF.format(t="r.ts", v="r.value"))
def a05(spark, d):
    return panel.as_of(*_sides(spark, d), "user_id", "ts", "value", "event_id")


_NEAR = "CASE WHEN r.ts >= l.ts - INTERVAL '1 day' THEN {} END"


@query("a06_as_of_tolerance", _ASOF.format(t=_NEAR.format("r.ts"), v=_NEAR.format("r.value")))
def a06(spark, d):
    return panel.as_of(*_sides(spark, d), "user_id", "ts", "value", "event_id", within="1 day")


@query("a07_range_join", "SELECT l.user_id, l.event_id AS l_id, r.event_id AS r_id, l.ts AS l_ts, r.ts AS r_ts FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts <= l.ts AND r.ts >= l.ts - INTERVAL '3 hours' WHERE l.event_type = 'purchase' AND r.event_type = 'view'")
def a07(spark, d):
    left, right = _sides(spark, d)
    return panel.range_join(left.select("user_id", F.col("event_id").alias("l_id"), F.col("ts").alias("l_ts")), right.select("user_id", F.col("event_id").alias("r_id"), F.col("ts").alias("r_ts")), "user_id", 3 * 3600)


@query("a08_aligned_panel", f"WITH {_HOURLY} SELECT symbol, bar_ts, close FROM bars WHERE bar_ts IN (SELECT bar_ts FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars))")
def a08(spark, d):
    return panel.aligned(hourly(spark, d)).select("symbol", "bar_ts", "close")


#: The columns that the SQL below writes out; the operators find the symbols themselves.
SYMBOLS = ["click", "error", "purchase", "signup", "view"]


@query("a09_wide_panel", f"WITH {_DAILY} SELECT bar_ts, " + ", ".join(f"max(close) FILTER (symbol = '{s}') AS {s}" for s in SYMBOLS) + " FROM bars GROUP BY 1")
def a09(spark, d):
    return panel.wide(daily(spark, d))


@query("a10_winsorized", "WITH b AS (SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events GROUP BY 1) SELECT event_id AS seq, event_type AS symbol, value AS price, round(greatest(least(value, hi), lo), 6) AS winsorized FROM events JOIN b USING (event_type)")
def a10(spark, d):
    return rounded(panel.winsorized(price_panel(spark, d), 0.05, 0.95).select("seq", "symbol", "price", "winsorized"), "winsorized")


@query("a11_gaps", f"WITH {_HOURLY}, g AS (SELECT symbol, lag(bar_ts) OVER ({_W}) AS after, bar_ts AS until FROM bars) SELECT *, CAST(epoch(until - after) / 3600 AS BIGINT) - 1 AS missing FROM g WHERE until - after > INTERVAL '1 hour'")
def a11(spark, d):
    return panel.gaps(hourly(spark, d), 3600)


@query("a11_duplicates", "SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a11b(spark, d):
    return panel.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("a12_simple_return", f"WITH {_HOURLY}, {_RETURNS} SELECT symbol, bar_ts, {_r('ret')} FROM rets")
def a12(spark, d):
    return rounded(rolling.with_returns(hourly(spark, d)).select("symbol", "bar_ts", "ret"), "ret")


@query("a13_log_return", f"WITH {_HOURLY}, {_RETURNS} SELECT symbol, bar_ts, {_r('log_ret')} FROM rets")
def a13(spark, d):
    return rounded(rolling.with_returns(hourly(spark, d)).select("symbol", "bar_ts", "log_ret"), "log_ret")


@query("a14_cumulative_return", f"WITH {_HOURLY}, {_RETURNS} SELECT symbol, bar_ts, round(exp(sum(log_ret) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1, 6) AS cum_ret FROM rets")
def a14(spark, d):
    return rounded(rolling.with_cumulative(rolling.with_returns(hourly(spark, d))).select("symbol", "bar_ts", "cum_ret"), "cum_ret")


def _full(what: str, c: str = "avg_price") -> str:
    return f"CASE WHEN count({c}) OVER w = {N} THEN {what} END"


@query("a15_rolling_stats", f"WITH {_HOURLY} SELECT symbol, bar_ts, " + ", ".join(f"round({_full(f'{f}(avg_price) OVER w')}, 6) AS {n}" for f, n in (("avg", "mean"), ("sum", "total"), ("stddev_samp", "sd"), ("min", "low"), ("max", "high"))) + f" FROM bars WINDOW w AS {_LAST}")
def a15(spark, d):
    return rounded(rolling.rolling_stats(series(spark, d), N), "mean", "total", "sd", "low", "high")


@query("a16_rolling_zscore", f"WITH {_HOURLY} SELECT symbol, bar_ts, round({_full('(avg_price - avg(avg_price) OVER w) / nullif(stddev_samp(avg_price) OVER w, 0)')}, 6) AS z FROM bars WINDOW w AS {_LAST}")
def a16(spark, d):
    return rounded(rolling.rolling_zscore(series(spark, d), N), "z")


@query("a17_rolling_volatility", f"WITH {_HOURLY}, {_RETURNS} SELECT symbol, bar_ts, round({_full('stddev_samp(log_ret) OVER w', 'log_ret')} * sqrt({YEAR}), 6) AS vol FROM rets WINDOW w AS {_LAST}")
def a17(spark, d):
    return rounded(rolling.rolling_volatility(rolling.with_returns(hourly(spark, d)), N, YEAR), "vol")


@query("a18_a19_rolling_relation", f"WITH {_HOURLY} SELECT symbol, bar_ts, round({_full('covar_samp(close, open) OVER w')}, 6) AS cov, round({_full('covar_pop(close, open) OVER w / nullif(stddev_pop(close) OVER w * stddev_pop(open) OVER w, 0)')}, 6) AS corr, round({_full('covar_pop(close, open) OVER w / nullif(var_pop(open) OVER w, 0)')}, 6) AS beta FROM bars WINDOW w AS {_LAST}")
def a18(spark, d):
    xy = hourly(spark, d).select("symbol", "bar_ts", F.col("close").alias("y"), F.col("open").alias("x"))
    return rounded(rolling.rolling_relation(xy, N), "cov", "corr", "beta")


@query("a20_rolling_quantile", f"WITH {_HOURLY} SELECT symbol, bar_ts, round({_full('quantile_cont(avg_price, 0.5) OVER w')}, 6) AS q FROM bars WINDOW w AS {_LAST}")
def a20(spark, d):
    return rounded(rolling.rolling_quantile(series(spark, d), N, 0.5), "q")


@query("a21_exponential_mean", f"""WITH RECURSIVE {_DAILY}, o AS (SELECT symbol, bar_ts, avg_price AS x, row_number() OVER ({_W}) AS i FROM bars),
    e AS (SELECT symbol, bar_ts, i, x AS ewm FROM o WHERE i = 1 UNION ALL SELECT o.symbol, o.bar_ts, o.i, 0.1 * o.x + 0.9 * e.ewm FROM o JOIN e ON o.symbol = e.symbol AND o.i = e.i + 1)
    SELECT symbol, bar_ts, {_r('ewm')} FROM e""")
def a21(spark, d):
    x = daily(spark, d).select("symbol", "bar_ts", F.col("avg_price").alias("x"))
    return rounded(rolling.exponential_mean(x, 0.1), "ewm")


@query("a22_skew_kurtosis", "SELECT event_type AS symbol, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurt FROM events GROUP BY 1")
def a22(spark, d):
    p = F.col("price")
    return rounded(price_panel(spark, d).groupBy("symbol").agg(sample_skewness(p).alias("skew"), sample_kurtosis(p).alias("kurt")), "skew", "kurt")


@query("a23_autocorrelation", f"WITH {_HOURLY}, l AS (SELECT symbol, avg_price AS y, lag(avg_price) OVER ({_W}) AS x FROM bars) SELECT symbol, round(covar_pop(y, x) / nullif(stddev_pop(y) * stddev_pop(x), 0), 6) AS autocorr FROM l WHERE x IS NOT NULL GROUP BY 1")
def a23(spark, d):
    return rounded(rolling.autocorrelation(series(spark, d), 1), "autocorr")


@query("a24_variance_ratio", f"WITH {_HOURLY}, l AS (SELECT symbol, avg_price - lag(avg_price, 1) OVER ({_W}) AS d1, avg_price - lag(avg_price, 4) OVER ({_W}) AS dq FROM bars) SELECT symbol, round(var_samp(dq) / nullif(4 * var_samp(d1), 0), 6) AS vr FROM l GROUP BY 1")
def a24(spark, d):
    return rounded(rolling.variance_ratio(series(spark, d), 4), "vr")


@query("a25_hurst", f"WITH {_HOURLY}, l AS (" + " UNION ALL ".join(f"SELECT symbol, {k} AS k, avg_price - lag(avg_price, {k}) OVER ({_W}) AS d FROM bars" for k in (1, 2, 4, 8, 16)) + "), s AS (SELECT symbol, k, stddev_samp(d) AS sd FROM l GROUP BY ALL HAVING stddev_samp(d) > 0) SELECT symbol, round(covar_pop(ln(sd), ln(k)) / nullif(var_pop(ln(k)), 0), 6) AS hurst FROM s GROUP BY 1")
def a25(spark, d):
    return rounded(rolling.hurst(series(spark, d), (1, 2, 4, 8, 16)), "hurst")


@query("a26_candidate_pairs", f"WITH {_DAILY}, {_PAIRS} SELECT sym_y, sym_x, bar_ts, {_r('y', 'x')} FROM pairs")
def a26(spark, d):
    return rounded(pairs_of(spark, d), "y", "x")


_CORR = "corrs AS (SELECT sym_y, sym_x, round(covar_pop(y, x) / nullif(stddev_pop(y) * stddev_pop(x), 0), 6) AS corr, count(*) AS n FROM pairs GROUP BY ALL)"


@query("a27_top_pairs", f"WITH {_DAILY}, {_PAIRS}, {_CORR} SELECT * FROM corrs ORDER BY corr DESC NULLS LAST, sym_y, sym_x LIMIT 5")
def a27(spark, d):
    return rounded(P.top_pairs(pairs_of(spark, d), 5), "corr")


@query("a27_top_pairs_screened", f"WITH {_DAILY}, {_PAIRS}, {_CORR} SELECT * FROM corrs ORDER BY corr DESC NULLS LAST, sym_y, sym_x LIMIT 5")
def a27b(spark, d):
    """The same pairs without all pairs: bounds from a few coordinates, then exact correlations of what they leave."""
    return rounded(screens.top_correlated(daily(spark, d), 5, "avg_price").drop("verified"), "corr")


@query("a28_distance", f"WITH {_DAILY}, {_PAIRS}, n AS (SELECT sym_y, sym_x, y / nullif(first_value(y) OVER w, 0) AS ny, x / nullif(first_value(x) OVER w, 0) AS nx FROM pairs WINDOW w AS {_PW}) SELECT sym_y, sym_x, round(sum(pow(ny - nx, 2)), 6) AS ssd FROM n GROUP BY ALL")
def a28(spark, d):
    return rounded(P.distances(pairs_of(spark, d)), "ssd")


@query("a28_closest_pairs", f"WITH {_DAILY}, {_PAIRS}, n AS (SELECT sym_y, sym_x, y / nullif(first_value(y) OVER w, 0) AS ny, x / nullif(first_value(x) OVER w, 0) AS nx FROM pairs WINDOW w AS {_PW}) SELECT sym_y, sym_x, round(sum(pow(ny - nx, 2)), 6) AS ssd FROM n GROUP BY ALL ORDER BY ssd, sym_y, sym_x LIMIT 5")
def a28b(spark, d):
    return rounded(screens.closest_prices(daily(spark, d), 5, "avg_price").drop("verified"), "ssd")


@query("a29_hedge_ratio", f"WITH {_DAILY}, {_PAIRS}, {_RATIOS} SELECT sym_y, sym_x, {_r('beta', 'alpha')} FROM ratios")
def a29(spark, d):
    return rounded(P.hedge_ratios(pairs_of(spark, d)), "beta", "alpha")


@query("a30_spread", f"WITH {_TO_SPREADS} SELECT sym_y, sym_x, bar_ts, {_r('spread')} FROM spreads")
def a30(spark, d):
    return rounded(spread_of(spark, d).select("sym_y", "sym_x", "bar_ts", "spread"), "spread")


_FIT = f"""l AS (SELECT sym_y, sym_x, lag(spread) OVER {_PW} AS x, spread - lag(spread) OVER {_PW} AS y FROM spreads),
    f AS (SELECT sym_y, sym_x, count(*) AS n, regr_slope(y, x) AS lam, sum(x * x) - sum(x) * sum(x) / count(*) AS sxx, sum(y * y) - sum(y) * sum(y) / count(*) AS syy FROM l WHERE x IS NOT NULL GROUP BY ALL)"""


@query("a31_a33_dickey_fuller", f"WITH {_TO_SPREADS}, {_FIT} SELECT sym_y, sym_x, round(lam, 6) AS lam, round(lam / sqrt((syy - lam * lam * sxx) / (n - 2) / sxx), 6) AS t_stat, round(CASE WHEN lam > -1 AND lam < 0 THEN -ln(2) / ln(1 + lam) END, 6) AS half_life FROM f")
def a31(spark, d):
    return rounded(P.dickey_fuller(spread_of(spark, d)), "lam", "t_stat", "half_life")


def _residual(out: str, source: str, names: list[str], by: str) -> str:
    """A step of partial regressions, on the rows themselves: what `by` explains is taken out of each name."""
    left = ", ".join(f"{c} - {by} * sum({c} * {by}) OVER p / sum({by} * {by}) OVER p AS {c}" for c in names)
    return f"{out} AS (SELECT sym_y, sym_x, {left} FROM {source} WINDOW p AS (PARTITION BY sym_y, sym_x))"


def _statistic(source: str, lags: int) -> str:
    return f"""SELECT sym_y, sym_x, count(*) AS n, {lags} AS lags, sum(l * y) / sum(l * l) AS slope, sum(l * l) AS ll, sum(y * y) - sum(l * y) * sum(l * y) / sum(l * l) AS rss,
        count(*) * ln(rss / count(*)) + {lags + 2} * ln(count(*)) AS schwarz, slope / sqrt(rss / (count(*) - {lags + 2}) / ll) AS t FROM {source} GROUP BY sym_y, sym_x"""


_PHI = "CASE WHEN x >= 0 THEN 1 - q ELSE q END"
_AUGMENTED = f"""v0 AS (SELECT sym_y, sym_x, bar_ts, lag(spread) OVER {_PW} AS l, spread - lag(spread) OVER {_PW} AS y FROM spreads),
    v1 AS (SELECT *, lag(y) OVER {_PW} AS d1, lag(y, 2) OVER {_PW} AS d2 FROM v0),
    m0 AS (SELECT sym_y, sym_x, l - avg(l) OVER p AS l, y - avg(y) OVER p AS y, d1 - avg(d1) OVER p AS d1, d2 - avg(d2) OVER p AS d2 FROM v1 WHERE d2 IS NOT NULL WINDOW p AS (PARTITION BY sym_y, sym_x)),
    {_residual("m1", "m0", ["l", "y", "d2"], "d1")}, {_residual("m2", "m1", ["l", "y"], "d2")},
    f AS ({_statistic("m0", 0)} UNION ALL {_statistic("m1", 1)} UNION ALL {_statistic("m2", 2)}),
    b AS (SELECT sym_y, sym_x, any_value(n) AS n, arg_min(lags, (schwarz, lags)) AS lags, arg_min(t, (schwarz, lags)) AS t FROM f GROUP BY ALL),
    x AS (SELECT *, CASE WHEN t <= -2.62 THEN 2.92 + 1.5012 * t + 0.039796 * t * t ELSE 2.1945 + 0.64695 * t - 0.29198 * t * t - 0.042377 * t * t * t END AS x FROM b),
    k AS (SELECT *, 1 / (1 + 0.2316419 * abs(x)) AS k FROM x),
    q AS (SELECT *, exp(-x * x / 2) / sqrt(2 * pi()) * (0.319381530 * k - 0.356563782 * k ** 2 + 1.781477937 * k ** 3 - 1.821255978 * k ** 4 + 1.330274429 * k ** 5) AS q FROM k),
    r AS (SELECT *, CASE WHEN t > 0.92 THEN 1.0 WHEN t < -18.86 THEN 0.0 ELSE {_PHI} END AS p FROM q)"""


@query("a32_engle_granger", f"WITH {_TO_SPREADS}, {_AUGMENTED} SELECT sym_y, sym_x, n, CAST(lags AS INTEGER) AS lags, round(t, 6) AS t_stat, CAST(round(p, 6) AS DOUBLE) AS p_value, p < 0.05 AS cointegrated FROM r")
def a32(spark, d):
    return rounded(P.engle_granger(pairs_of(spark, d)), "t_stat", "p_value")


_JOHANSEN = f"""v0 AS (SELECT sym_y, sym_x, bar_ts, y - lag(y) OVER {_PW} AS e1, x - lag(x) OVER {_PW} AS e2, lag(y) OVER {_PW} AS l1, lag(x) OVER {_PW} AS l2 FROM pairs),
    v1 AS (SELECT *, lag(e1) OVER {_PW} AS z1, lag(e2) OVER {_PW} AS z2 FROM v0),
    m0 AS (SELECT sym_y, sym_x, {", ".join(f"{c} - avg({c}) OVER p AS {c}" for c in ("e1", "e2", "l1", "l2", "z1", "z2"))} FROM v1 WHERE z1 IS NOT NULL WINDOW p AS (PARTITION BY sym_y, sym_x)),
    {_residual("m1", "m0", ["e1", "e2", "l1", "l2", "z2"], "z1")}, {_residual("m2", "m1", ["e1", "e2", "l1", "l2"], "z2")},
    s AS (SELECT sym_y, sym_x, count(*) AS n, sum(e1 * e1) AS a, sum(e1 * e2) AS b, sum(e2 * e2) AS c, sum(l1 * l1) AS p, sum(l1 * l2) AS q, sum(l2 * l2) AS r,
          sum(e1 * l1) AS g, sum(e1 * l2) AS h, sum(e2 * l1) AS i, sum(e2 * l2) AS j FROM m2 GROUP BY ALL),
    t AS (SELECT *, a * c - b * b AS d0, p * r - q * q AS d1, c * g * g - 2 * b * g * i + a * i * i AS w11, c * g * h - b * (g * j + h * i) + a * i * j AS w12, c * h * h - 2 * b * h * j + a * j * j AS w22 FROM s),
    u AS (SELECT *, (r * w11 - 2 * q * w12 + p * w22) / (d0 * d1) AS tr, (g * j - h * i) * (g * j - h * i) / (d0 * d1) AS det FROM t),
    z AS (SELECT *, tr / 2 + sqrt(greatest(tr * tr / 4 - det, 0)) AS high, tr / 2 - sqrt(greatest(tr * tr / 4 - det, 0)) AS low FROM u),
    j AS (SELECT *, -n * (ln(1 - high) + ln(1 - low)) AS trace_0, -n * ln(1 - low) AS trace_1 FROM z)"""


@query("a34_johansen", f"WITH {_DAILY}, {_PAIRS}, {_JOHANSEN} SELECT sym_y, sym_x, n, round(trace_0, 6) AS trace_0, round(trace_1, 6) AS trace_1, CAST(CASE WHEN trace_0 < 15.41 THEN 0 WHEN trace_1 < 3.76 THEN 1 ELSE 2 END AS INTEGER) AS rank FROM j")
def a34(spark, d):
    return rounded(P.johansen(pairs_of(spark, d)), "trace_0", "trace_1")


@query("a35_correlation_matrix", f"WITH {_DAILY}, c AS (SELECT a.symbol, b.symbol AS other, CASE WHEN any_value(a.symbol) = any_value(b.symbol) THEN 1.0 ELSE covar_pop(a.avg_price, b.avg_price) / nullif(stddev_pop(a.avg_price) * stddev_pop(b.avg_price), 0) END AS corr FROM bars a JOIN bars b USING (bar_ts) GROUP BY ALL) SELECT symbol, other, CAST(round(corr, 6) AS DOUBLE) AS corr FROM c")
def a35(spark, d):
    return rounded(P.correlation_matrix(daily(spark, d), "avg_price"), "corr")


@query("a36_pca_residuals")
def a36(spark, d):
    found = P.pca_residuals(panel.wide(daily(spark, d), "avg_price"), 2).drop("factors")
    return rounded(found, *(c for c in found.columns if c != "bar_ts"))


@query("a36_factor_residuals")
def a36b(spark, d):
    """The same by power iteration over the long table, a row a symbol and time."""
    return rounded(factors.factor_residuals(daily(spark, d), 2, "avg_price"), "residual")


@query("a37_clusters")
def a37(spark, d):
    stats = price_panel(spark, d).groupBy("symbol").agg(F.avg("price").alias("mean"), F.stddev_samp("price").alias("sd"))
    return P.clusters(stats, ["mean", "sd"], 2)


@query("a37_cluster_pairs")
def a37b(spark, d):
    stats = price_panel(spark, d).groupBy("symbol").agg(F.avg("price").alias("mean"), F.stddev_samp("price").alias("sd"))
    return P.cluster_pairs(stats, ["mean", "sd"], (2, 3, 4))


_OOS = f"""{_DAILY}, allp AS (SELECT a.symbol AS sym_y, b.symbol AS sym_x, a.bar_ts AS bar_ts, a.avg_price AS y, b.avg_price AS x FROM bars a JOIN bars b ON a.bar_ts = b.bar_ts WHERE a.symbol < b.symbol),
    pairs AS (SELECT * FROM allp WHERE bar_ts < TIMESTAMP '{SPLIT}'), {_RATIOS}"""


@query("a38_out_of_sample_spread", f"WITH {_OOS} SELECT p.sym_y, p.sym_x, bar_ts, round(y - alpha - beta * x, 6) AS spread FROM allp p JOIN ratios r ON p.sym_y = r.sym_y AND p.sym_x = r.sym_x WHERE bar_ts >= TIMESTAMP '{SPLIT}'")
def a38(spark, d):
    return rounded(trading.out_of_sample_spreads(pairs_of(spark, d), SPLIT).select("sym_y", "sym_x", "bar_ts", "spread"), "spread")


@query("a39_walk_forward", f"""WITH {_DAILY}, {_PAIRS}, e AS (SELECT date_trunc('day', min(bar_ts)) AS first, max(bar_ts) AS last FROM pairs),
    f AS (SELECT CAST(i AS INTEGER) AS fold, first + to_days(CAST(i * 5 AS INTEGER)) AS f0 FROM e, range(1000) t(i) WHERE first + to_days(CAST(i * 5 + 10 AS INTEGER)) <= last),
    r AS (SELECT fold, sym_y, sym_x, {_BETA} AS beta, avg(y) - {_BETA} * avg(x) AS alpha FROM pairs JOIN f ON bar_ts >= f0 AND bar_ts < f0 + INTERVAL '10 days' GROUP BY ALL)
    SELECT f.fold, p.sym_y, p.sym_x, bar_ts, round(y - alpha - beta * x, 6) AS spread FROM pairs p JOIN f ON bar_ts >= f0 + INTERVAL '10 days' AND bar_ts < f0 + INTERVAL '15 days' JOIN r ON r.fold = f.fold AND r.sym_y = p.sym_y AND r.sym_x = p.sym_x""")
def a39(spark, d):
    return rounded(trading.walk_forward(pairs_of(spark, d), 10, 5), "spread")


@query("a40_positions", f"WITH {_TO_SPREADS}, {_SCORED}, {_POS} SELECT sym_y, sym_x, bar_ts, round(z, 6) AS z, pos FROM posd")
def a40(spark, d):
    return rounded(trading.positions(scored_of(spark, d), ENTRY, LEAVE, PART_SECONDS).select("sym_y", "sym_x", "bar_ts", "z", "pos"), "z")


STOP, MOST = 2.0, 5


@query("a41_guarded_positions", f"""WITH RECURSIVE {_TO_SPREADS}, {_SCORED}, o AS (SELECT *, row_number() OVER {_PW} AS i FROM scored),
    g AS (SELECT DISTINCT sym_y, sym_x, CAST(0 AS BIGINT) AS i, 0 AS pos, 0 AS held, false AS locked FROM scored
          UNION ALL SELECT sym_y, sym_x, i, wish, CASE WHEN wish <> 0 AND wish = pos THEN held + 1 WHEN wish <> 0 THEN 1 ELSE 0 END, lk FROM (
              SELECT *, CASE WHEN z IS NULL THEN pos WHEN abs(z) < {LEAVE} OR lk THEN 0 WHEN pos <> 0 THEN pos WHEN z < -{ENTRY} THEN 1 WHEN z > {ENTRY} THEN -1 ELSE 0 END AS wish FROM (
                  SELECT o.sym_y, o.sym_x, o.i, o.z, g.pos, g.held, CASE WHEN o.z IS NULL THEN g.locked ELSE (g.locked OR g.pos <> 0 AND (abs(o.z) > {STOP} OR g.held >= {MOST})) AND NOT abs(o.z) < {LEAVE} END AS lk
                  FROM o JOIN g ON o.sym_y = g.sym_y AND o.sym_x = g.sym_x AND o.i = g.i + 1)))
    SELECT o.sym_y, o.sym_x, o.bar_ts, round(o.z, 6) AS z, CAST(g.pos AS INTEGER) AS pos FROM o JOIN g ON o.sym_y = g.sym_y AND o.sym_x = g.sym_x AND o.i = g.i""")
def a41(spark, d):
    return rounded(trading.guarded_positions(scored_of(spark, d), ENTRY, LEAVE, STOP, MOST), "z")


_DRIFT = "(1e-4 / (1 - 1e-4))"


@query("a42_kalman", f"""WITH RECURSIVE {_DAILY}, {_PAIRS}, o AS (SELECT *, row_number() OVER {_PW} AS i FROM pairs),
    k AS (SELECT DISTINCT sym_y, sym_x, CAST(0 AS BIGINT) AS i, 0e0 AS beta, 0e0 AS alpha, 1e0 AS bb, 0e0 AS ba, 1e0 AS aa, 0e0 AS innovation FROM pairs
          UNION ALL SELECT sym_y, sym_x, i, beta + gb / size * error, alpha + ga / size * error, bb - gb * gb / size, ba - gb * ga / size, aa - ga * ga / size, error / sqrt(size) FROM (
              SELECT *, x * gb + ga + 1 AS size, y - beta * x - alpha AS error FROM (
                  SELECT o.sym_y, o.sym_x, o.i, o.y, o.x, k.beta, k.alpha, k.ba, k.bb + {_DRIFT} AS bb, k.aa + {_DRIFT} AS aa, (k.bb + {_DRIFT}) * o.x + k.ba AS gb, k.ba * o.x + k.aa + {_DRIFT} AS ga
                  FROM o JOIN k ON o.sym_y = k.sym_y AND o.sym_x = k.sym_x AND o.i = k.i + 1)))
    SELECT o.sym_y, o.sym_x, o.bar_ts, round(beta, 6) AS beta, round(alpha, 6) AS alpha, round(innovation, 6) AS innovation FROM o JOIN k ON o.sym_y = k.sym_y AND o.sym_x = k.sym_x AND o.i = k.i""")
def a42(spark, d):
    return rounded(P.kalman(pairs_of(spark, d)), "beta", "alpha", "innovation")


@query("a43_pair_pnl", f"WITH {_TO_EARNED} SELECT sym_y, sym_x, bar_ts, pos, round(pnl, 6) AS pnl FROM earned")
def a43(spark, d):
    return rounded(earned_of(spark, d).select("sym_y", "sym_x", "bar_ts", "pos", "pnl"), "pnl")


@query("a44_trades", f"""WITH {_TO_EARNED}, c AS (SELECT *, CASE WHEN pos <> coalesce(lag(pos) OVER {_PW}, 0) THEN 1 ELSE 0 END AS ch, coalesce(lead(pnl) OVER {_PW}, 0) AS nx FROM earned),
    s AS (SELECT *, sum(ch) OVER {_PW} AS spell FROM c)
    SELECT sym_y, sym_x, CAST(spell AS BIGINT) AS spell, min(bar_ts) AS entry_ts, max(bar_ts) AS exit_ts, max(pos) AS side, count(*) AS bars, round(sum(nx), 6) AS pnl FROM s WHERE pos <> 0 GROUP BY sym_y, sym_x, spell""")
def a44(spark, d):
    return rounded(trading.trades(earned_of(spark, d)), "pnl")


@query("a45_equity", f"""WITH {_TO_EARNED}, c AS (SELECT *, sum(pnl) OVER {_PW} AS cum_pnl FROM earned)
    SELECT sym_y, sym_x, bar_ts, round(cum_pnl, 6) AS cum_pnl, round(drawdown, 6) AS drawdown, round(min(drawdown) OVER {_PW}, 6) AS max_drawdown FROM (SELECT *, cum_pnl - greatest(max(cum_pnl) OVER {_PW}, 0) AS drawdown FROM c)""")
def a45(spark, d):
    return rounded(trading.equity(earned_of(spark, d)).select("sym_y", "sym_x", "bar_ts", "cum_pnl", "drawdown", "max_drawdown"), "cum_pnl", "drawdown", "max_drawdown")


@query("a46_performance", f"""WITH {_TO_EARNED}, t AS (SELECT *, abs(pos - coalesce(lag(pos) OVER {_PW}, 0)) AS turn FROM earned)
    SELECT sym_y, sym_x, round(sqrt({YEAR}) * avg(pnl) / nullif(stddev_samp(pnl), 0), 6) AS sharpe, round(sqrt({YEAR}) * avg(pnl) / nullif(sqrt(avg(pow(least(pnl, 0), 2))), 0), 6) AS sortino,
    round(count(*) FILTER (pnl > 0) / nullif(count(*) FILTER (pnl <> 0), 0), 6) AS hit_rate, CAST(sum(turn) AS BIGINT) AS turnover, round(avg(abs(pos)), 6) AS exposure FROM t GROUP BY ALL""")
def a46(spark, d):
    return rounded(trading.performance(earned_of(spark, d), YEAR), "sharpe", "sortino", "hit_rate", "exposure")


@query("a47_tail_risk", f"""WITH {_TO_EARNED}, v AS (SELECT sym_y, sym_x, quantile_cont(pnl, 0.05) AS q FROM earned GROUP BY ALL)
    SELECT e.sym_y, e.sym_x, round(any_value(q), 6) AS value_at_risk, round(avg(pnl) FILTER (pnl <= q), 6) AS shortfall FROM earned e JOIN v ON e.sym_y = v.sym_y AND e.sym_x = v.sym_x GROUP BY ALL""")
def a47(spark, d):
    return rounded(trading.tail_risk(earned_of(spark, d), 0.05), "value_at_risk", "shortfall")


_GRP = "substr(symbol, 1, 1) < 'f'"


@query("a48_cross_section", f"WITH {_DAILY}, g AS (SELECT *, {_GRP} AS grp FROM bars) SELECT bar_ts, symbol, CAST(rank() OVER (PARTITION BY bar_ts ORDER BY avg_price DESC) AS INTEGER) AS rank, round((avg_price - avg(avg_price) OVER t) / nullif(stddev_samp(avg_price) OVER t, 0), 6) AS z, round(avg_price - avg(avg_price) OVER t, 6) AS demeaned, round(avg_price - avg(avg_price) OVER (PARTITION BY bar_ts, grp), 6) AS neutral FROM g WINDOW t AS (PARTITION BY bar_ts)")
def a48(spark, d):
    x = daily(spark, d).select("bar_ts", "symbol", F.col("avg_price").alias("x"), F.expr(_GRP).alias("grp"))
    return rounded(trading.cross_section(x), "z", "demeaned", "neutral")


@query("a49_long_short", f"WITH {_DAILY}, t AS (SELECT bar_ts, symbol, CAST(ntile(3) OVER (PARTITION BY bar_ts ORDER BY avg_price, symbol) AS INTEGER) AS tile FROM bars) SELECT *, round(CAST(CASE tile WHEN 3 THEN 1.0 / count(*) FILTER (tile = 3) OVER w WHEN 1 THEN -1.0 / count(*) FILTER (tile = 1) OVER w ELSE 0 END AS DOUBLE), 6) AS weight FROM t WINDOW w AS (PARTITION BY bar_ts)")
def a49(spark, d):
    return rounded(trading.long_short(daily(spark, d).select("bar_ts", "symbol", F.col("avg_price").alias("x")), 3), "weight")


@query("a50_portfolio", f"""WITH {_TO_EARNED}, i AS (SELECT sym_y AS a, sym_x AS b, coalesce(1 / nullif(stddev_samp(pnl), 0), 0) AS v FROM earned GROUP BY ALL),
    k AS (SELECT a, b, v / nullif((SELECT sum(v) FROM i), 0) AS weight FROM i)
    SELECT bar_ts, round(sum(pnl), 6) AS pnl, round(avg(pnl), 6) AS pnl_per_pair, round(sum(pnl * coalesce(weight, 0)), 6) AS pnl_weighted, count(*) FILTER (pos <> 0) AS open_pairs FROM earned JOIN k ON sym_y = a AND sym_x = b GROUP BY 1""")
def a50(spark, d):
    earned = earned_of(spark, d)
    return rounded(trading.portfolio(earned, trading.capital(earned)), "pnl", "pnl_per_pair", "pnl_weighted")


GRID = [(n, e, q) for n in (5, 10) for e, q in ((0.5, 0.25), (1.0, 0.25), (1.0, 0.5), (1.5, 0.5))]
_SCORED_N = " UNION ALL ".join(f"SELECT *, {n} AS n, CASE WHEN count(spread) OVER w{n} = {n} THEN (spread - avg(spread) OVER w{n}) / nullif(stddev_samp(spread) OVER w{n}, 0) END AS z FROM spreads WINDOW w{n} AS (PARTITION BY sym_y, sym_x ORDER BY bar_ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 10))


@query("a51_sweep", f"""WITH {_TO_SPREADS}, scored AS ({_SCORED_N}), g AS (SELECT * FROM (VALUES {", ".join(f"({n}, CAST({e} AS DOUBLE), CAST({q} AS DOUBLE))" for n, e, q in GRID)}) v(n, entry, leave)),
    p AS (SELECT s.*, entry, leave, coalesce(last_value(CASE WHEN z < -entry THEN 1 WHEN z > entry THEN -1 WHEN abs(z) < leave THEN 0 END IGNORE NULLS) OVER (PARTITION BY sym_y, sym_x, s.n, entry, leave ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS pos FROM scored s JOIN g ON s.n = g.n),
    e AS (SELECT *, {_MADE.format(c=COST)} FROM p WINDOW w AS (PARTITION BY sym_y, sym_x, n, entry, leave ORDER BY bar_ts)) SELECT sym_y, sym_x, CAST(n AS INTEGER) AS n, entry, leave, round(sum(pnl), 6) AS pnl FROM e GROUP BY ALL""")
def a51(spark, d):
    return rounded(trading.sweep(spread_of(spark, d), GRID, COST), "pnl")


@query("a52_stream_bars", f"WITH {_HOURLY} SELECT symbol, bar_ts, open, high, low, close, n FROM bars")
def a52(spark, d):
    return jobs.drained(jobs.bars(jobs.ticks(spark, d), "1 hour"))


@query("a53_stream_sliding", "WITH w AS (SELECT event_type AS symbol, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start, value FROM events) SELECT symbol, start, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY ALL")
def a53(spark, d):
    return jobs.drained(jobs.sliding(jobs.ticks(spark, d), "1 hour", "30 minutes"))


@query("a54_stream_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER u < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '2 hours' AS stop, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")
def a54(spark, d):
    return jobs.drained(jobs.sessions(jobs.ticks(spark, d), "2 hours"))


@query("a55_stream_dedup", "SELECT event_id AS seq, event_type AS symbol, value AS price, user_id FROM events")
def a55(spark, d):
    """Every row arrives twice and is kept once."""
    return jobs.drained(jobs.first_seen(jobs.ticks(spark, d, repeated=True), "seq")).select("seq", "symbol", "price", "user_id")


@query("a56_stream_relation", "WITH w AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 day', ts) AS start, value AS y, CAST(hour(ts) AS DOUBLE) AS x FROM events) SELECT symbol, start, round(covar_pop(y, x) / nullif(sqrt(var_pop(x) * var_pop(y)), 0), 6) AS corr, round(covar_pop(y, x) / nullif(var_pop(x), 0), 6) AS slope FROM w GROUP BY ALL")
def a56(spark, d):
    return jobs.drained(jobs.relation(jobs.ticks(spark, d), "1 day"))


@query("a57_stream_positions", f"WITH s AS (SELECT event_type AS symbol, ts, event_id AS seq, (value - 20) / 15 AS z FROM events) SELECT symbol, ts, seq, CAST(coalesce(last_value({_DECIDE.format(e=ENTRY, l=LEAVE)} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS pos FROM s")
def a57(spark, d):
    z = jobs.ticks(spark, d).select("symbol", "ts", "seq", ((F.col("price") - 20) / 15).alias("z"))
    return jobs.drained(jobs.position_machine(z, ENTRY, LEAVE)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("a58_stream_late", f"WITH {_HOURLY} SELECT symbol, bar_ts, n FROM bars")
def a58(spark, d):
    """Rows of the first hour come once more after all others: the watermark has passed them, so they count for nothing."""
    return jobs.drained(jobs.bars(jobs.ticks(spark, d, late=True), "1 hour")).select("symbol", "bar_ts", "n")
