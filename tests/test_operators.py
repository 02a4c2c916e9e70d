"""Operators on small series with known answers, and properties that must hold."""

import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions.quantiles import exact_quantiles, quantile_columns
from pairloom.operators import pairs as P
from pairloom.operators import panel, rolling, sequential, trading
from pairloom.sources import tables
from pairloom.streaming import jobs

T0 = datetime.datetime(2024, 1, 1)
day = lambda i: T0 + datetime.timedelta(days=i)


def pair_frame(spark, y, x):
    return spark.createDataFrame([("b", "a", day(i), float(p), float(q)) for i, (p, q) in enumerate(zip(y, x, strict=True))], "sym_y string, sym_x string, bar_ts timestamp_ntz, y double, x double")


def test_hedge_ratio_of_a_line(spark):
    r = P.hedge_ratios(pair_frame(spark, [2 + 3 * i for i in range(20)], range(20))).first()
    assert r.beta == pytest.approx(3) and r.alpha == pytest.approx(2)


def test_constant_series_give_null(spark):
    r = P.hedge_ratios(pair_frame(spark, range(5), [1] * 5)).first()
    assert r.beta is None
    assert P.correlations(pair_frame(spark, range(5), [1] * 5)).first()["corr"] is None


def test_dickey_fuller_finds_the_coefficient(spark):
    rng, s = np.random.default_rng(1), [0.0]
    for _ in range(4000):
        s.append(0.5 * s[-1] + rng.normal())
    df = spark.createDataFrame([("b", "a", day(i), float(v)) for i, v in enumerate(s)], "sym_y string, sym_x string, bar_ts timestamp_ntz, spread double")
    r = P.dickey_fuller(df).first()
    assert r.lam == pytest.approx(-0.5, abs=0.05) and r.half_life == pytest.approx(1.0, abs=0.15)
    d, lag = np.diff(s), np.array(s[:-1])
    x = np.column_stack([lag, np.ones(len(lag))])
    b = np.linalg.lstsq(x, d, rcond=None)[0]
    res = d - x @ b
    se = np.sqrt(res @ res / (len(d) - 2) * np.linalg.inv(x.T @ x)[0, 0])
    assert r.t_stat == pytest.approx(b[0] / se)
    plain = P.augmented_dickey_fuller(df, 0).first()
    assert plain.t_stat == pytest.approx(b[0] / se) and (plain.n, plain.lags) == (4000, 0)


def test_johansen_and_engle_granger_tell_related_from_unrelated(spark):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=500))
    near, far = 2 * x + rng.normal(size=500), np.cumsum(rng.normal(size=500))
    assert P.johansen(pair_frame(spark, near, x)).first()["rank"] >= 1
    assert P.johansen(pair_frame(spark, far, x)).first()["rank"] == 0
    assert P.engle_granger(pair_frame(spark, near, x)).first().cointegrated
    assert not P.engle_granger(pair_frame(spark, far, x)).first().cointegrated


def test_kalman_follows_a_constant_ratio(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300) + 5
    last = P.kalman(pair_frame(spark, 2 * x + 1, x)).orderBy(F.col("bar_ts").desc()).first()
    assert last.beta * 5 + last.alpha == pytest.approx(11, abs=0.2)


def test_as_of_ties_and_gaps(spark):
    left = spark.createDataFrame([(1, day(2), 1, 0.0), (1, day(0), 2, 0.0), (2, day(1), 3, 0.0)], "k int, ts timestamp_ntz, id int, v double")
    right = spark.createDataFrame([(1, day(2), 7, 1.0), (1, day(2), 9, 2.0), (1, day(1), 8, 3.0)], "k int, ts timestamp_ntz, id int, v double")
    got = {r.id: r.as_of_value for r in panel.as_of(left, right, "k", "ts", "v", "id").collect()}
    assert got == {1: 2.0, 2: None, 3: None}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-4, 4)), max_size=40))
def test_guarded_rule_stays_in_bounds(z):
    out = trading.guarded_reference(z, 1.0, 0.5, 2.0, 3)
    assert len(out) == len(z) and set(out) <= {-1, 0, 1}


def test_guarded_fold_is_the_rule(spark):
    rng = np.random.default_rng(5)
    z = [None if v > 3.4 else float(v) for v in rng.normal(size=400) * 1.6]
    df = spark.createDataFrame([("b", "a", day(i), v) for i, v in enumerate(z)], "sym_y string, sym_x string, bar_ts timestamp_ntz, z double")
    got = [r.pos for r in trading.guarded_positions(df, 1.0, 0.5, 2.0, 3).orderBy("bar_ts").collect()]
    assert got == trading.guarded_reference(z, 1.0, 0.5, 2.0, 3)


def test_trades_add_up_and_nothing_looks_ahead(spark):
    rng = np.random.default_rng(6)
    x = np.cumsum(rng.normal(size=120)) + 50
    full = pair_frame(spark, x + rng.normal(size=120) * 2, x)

    def earned(frame):
        scored = P.spread_zscores(frame.withColumns({"beta": F.lit(1.0), "spread": F.col("y") - F.col("x")}), 10)
        return trading.pnl(trading.positions(scored), 0.0)

    e = earned(full)
    assert trading.trades(e).agg(F.sum("pnl")).first()[0] == pytest.approx(e.agg(F.sum("pnl")).first()[0])
    early = {r.bar_ts: (r.z, r.pos, r.pnl) for r in earned(full.where(F.col("bar_ts") < day(80))).collect()}
    late = {r.bar_ts: (r.z, r.pos, r.pnl) for r in e.collect()}
    assert all(late[t] == v for t, v in early.items())


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "symbol string, bar_ts timestamp_ntz, x double")
    for f in (lambda: rolling.rolling_stats(empty, 3), lambda: rolling.rolling_quantile(empty, 3, 0.5), lambda: rolling.exponential_mean(empty, 0.1), lambda: rolling.hurst(empty, (1, 2)), lambda: panel.aligned(empty)):
        assert f().count() == 0


def test_zscore_ignores_scale(spark):
    rng = np.random.default_rng(7).normal(size=60)
    frame = lambda v: spark.createDataFrame([("s", day(i), float(a)) for i, a in enumerate(v)], "symbol string, bar_ts timestamp_ntz, x double")
    a, b = (np.array([r.z or 0.0 for r in rolling.rolling_zscore(frame(v), 10).orderBy("bar_ts").collect()]) for v in (rng, 3 * rng + 7))
    assert np.allclose(a, b)


def test_pca_leaves_nothing_of_two_factors(spark):
    rng = np.random.default_rng(8)
    f, g = rng.normal(size=(2, 60))
    columns = {"p": f + 3, "q": 2 * f - g, "r": g - 1, "s": f + g}
    wide = spark.createDataFrame([(day(i), *(float(v[i]) for v in columns.values())) for i in range(60)], ["bar_ts", *columns]).withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz"))
    found = P.pca_residuals(wide, 2).collect()
    assert max(abs(r[c]) for r in found for c in columns) < 1e-9
    # One factor: the residuals are those of the leading eigenvector.
    m = np.column_stack(list(columns.values()))
    m = m - m.mean(0)
    lead = np.linalg.eigh(m.T @ m)[1][:, -1]
    want = m - np.outer(m @ lead, lead)
    got = np.array([[r[c] for c in columns] for r in P.pca_residuals(wide, 1).orderBy("bar_ts").collect()])
    assert np.allclose(got, want)


def test_clusters_of_two_groups(spark):
    rows = [(f"s{i}", float(i % 2) * 50 + i * 0.1, float(i % 2) * 9) for i in range(12)]
    got = {r.symbol: r.cluster for r in P.clusters(spark.createDataFrame(rows, "symbol string, mean double, sd double"), ["mean", "sd"], 2).collect()}
    assert len({got[f"s{i}"] for i in range(0, 12, 2)}) == len({got[f"s{i}"] for i in range(1, 12, 2)}) == 1 and got["s0"] != got["s1"]


def test_correlation_matrix_is_numpys(spark):
    rng = np.random.default_rng(9)
    values = rng.normal(size=(3, 40))
    bars = spark.createDataFrame([(s, day(i), float(values[k, i])) for k, s in enumerate("abc") for i in range(40)] + [("flat", day(i), 1.0) for i in range(40)], "symbol string, bar_ts timestamp_ntz, v double")
    got = {(r.symbol, r.other): r["corr"] for r in P.correlation_matrix(bars, "v").collect()}
    want = np.corrcoef(values)
    assert len(got) == 16 and all(got[a, b] == pytest.approx(want["abc".index(a), "abc".index(b)]) for a in "abc" for b in "abc")
    assert got["flat", "a"] is None and got["flat", "flat"] == 1.0


def test_kalman_is_the_filter(spark):
    rng = np.random.default_rng(13)
    x, y = rng.normal(size=(2, 50)) + 3
    state, cov, q = np.zeros(2), np.eye(2), 1e-4 / (1 - 1e-4) * np.eye(2)
    for k, r in enumerate(P.kalman(pair_frame(spark, y, x)).orderBy("bar_ts").collect()):
        h, cov = np.array([x[k], 1.0]), cov + q
        error, size = y[k] - h @ state, h @ cov @ h + 1.0
        gain = cov @ h / size
        state, cov = state + gain * error, cov - np.outer(gain, h) @ cov
        assert (r.beta, r.alpha, r.innovation) == pytest.approx((*state, error / np.sqrt(size)))


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_recursions_go_over_batches(spark, batch):
    rows = [(s, day(i), None if i % 7 == 3 else float(i * k)) for k, s in enumerate("ab", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, x double").orderBy(F.rand(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.symbol, r.bar_ts): r.ewm for r in rolling.exponential_mean(df, 0.5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in "ab":
        mean = None
        for _, t, v in (r for r in rows if r[0] == s):
            mean = mean if v is None else v if mean is None else 0.5 * v + 0.5 * mean
            assert got[s, t] == pytest.approx(mean)


def test_a_long_series_takes_time_in_proportion(spark):
    df = spark.range(200_000).select(F.lit("s").alias("symbol"), (F.lit(T0).cast("timestamp_ntz") + F.make_interval(mins=F.col("id").cast("int"))).alias("bar_ts"), (F.col("id") % 97).cast("double").alias("x"))
    last = rolling.exponential_mean(df, 0.5).orderBy(F.desc("bar_ts")).first()
    mean = 0.0
    for i in range(199_900, 200_000):
        mean = 0.5 * (i % 97) + 0.5 * mean
    assert last.ewm == pytest.approx(mean)


@pytest.mark.parametrize("small", [0, 20_000])
def test_exact_quantiles(spark, monkeypatch, small):
    """Against numpy, ranked whole and by brackets; ties, nulls, a group of one row and a null key."""
    from pairloom.functions import quantiles

    monkeypatch.setattr(quantiles, "SMALL", small)
    rng = np.random.default_rng(10)
    groups = {"even": rng.normal(size=30_000), "ties": rng.integers(0, 3, 25_000).astype(float), "one": np.array([4.0]) if small else rng.normal(size=21_000), None: rng.exponential(size=22_000)}
    rows = [(k, float(v)) for k, g in groups.items() for v in g] + [("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    levels = (0.0, 0.05, 0.5, 0.9731, 1.0)
    got = {(r.k, r.level): r.value for r in exact_quantiles(df, ("k",), "v", levels).collect()}
    assert got == {(k, q): pytest.approx(np.quantile(g, q)) for k, g in groups.items() for q in levels}
    whole = quantile_columns(df, (), "v", {"a": 0.25, "b": 0.75}).first()
    every = np.concatenate(list(groups.values()))
    assert (whole.a, whole.b) == pytest.approx((np.quantile(every, 0.25), np.quantile(every, 0.75)))


def test_as_of_over_buckets_of_a_busy_key_and_of_any_type(spark):
    rng = np.random.default_rng(11)
    left = [(1, T0 + datetime.timedelta(seconds=int(s)), i, "l") for i, s in enumerate(rng.integers(0, 10**6, 300))]
    right = [(1, T0 + datetime.timedelta(seconds=int(s)), i, f"r{i}") for i, s in enumerate(rng.integers(0, 10**6, 40))]
    schema = "k int, ts timestamp_ntz, id int, v string"
    for seconds in (60, 86_400, 10**7):
        got = {r.id: (r.as_of_ts, r.as_of_value) for r in panel.as_of(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", "ts", "v", "id", bucket_seconds=seconds).collect()}
        for _, t, i, _ in left:
            best = max((r for r in right if r[1] <= t), key=lambda r: (r[1], r[2]), default=None)
            assert got[i] == ((best[1], best[3]) if best else (None, None))


def fitted_by_hand(s, max_lags):
    """(lags, t statistic) of the least Schwarz criterion, by least squares on the same rows."""
    d, best = np.diff(s), None
    rows = np.arange(max_lags, len(d))
    for lags in range(max_lags + 1):
        x = np.column_stack([s[rows], *(d[rows - j] for j in range(1, lags + 1)), np.ones(len(rows))])
        beta = np.linalg.lstsq(x, d[rows], rcond=None)[0]
        left = d[rows] - x @ beta
        t = beta[0] / np.sqrt(left @ left / (len(rows) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])
        schwarz = len(rows) * np.log(left @ left / len(rows)) + x.shape[1] * np.log(len(rows))
        best = min(best or (schwarz, lags, t), (schwarz, lags, t))
    return best[1:]


def test_lags_and_statistic_equal_least_squares(spark):
    rng, rows, wanted = np.random.default_rng(21), [], {}
    for k, (own, past) in enumerate([(0.9, 0.0), (0.7, 0.5), (1.0, -0.6), (0.2, 0.3)]):
        s = [0.0, 0.0, 0.0, 0.0]
        for _ in range(300):
            s.append(s[-1] + (own - 1) * s[-1] + past * (s[-2] - s[-4]) + rng.normal())
        rows += [("y", f"x{k}", day(i), float(v) + 1e6) for i, v in enumerate(s)]
        wanted[f"x{k}"] = fitted_by_hand(np.array(s), 3)  # a level changes nothing
    df = spark.createDataFrame(rows, "sym_y string, sym_x string, bar_ts timestamp_ntz, spread double").repartition(3)
    got = {r.sym_x: r for r in P.augmented_dickey_fuller(df, 3).collect()}
    for k, (lags, t) in wanted.items():
        assert got[k].lags == lags and got[k].t_stat == pytest.approx(t, rel=1e-5) and got[k].n == 300
    assert len({w[0] for w in wanted.values()}) > 1


def test_series_without_a_statistic_give_null(spark):
    long = [float(v) for v in np.random.default_rng(22).normal(size=40)]
    series = {"constant": [3.0] * 40, "short": long[:5], "one": long[:1], "line": [float(i) for i in range(40)], "nulls": [None] * 40, "good": long, "big": [1e9] * 40}
    rows = [("y", k, day(i), v) for k, s in series.items() for i, v in enumerate(s)]
    got = {r.sym_x: r for r in P.augmented_dickey_fuller(spark.createDataFrame(rows, "sym_y string, sym_x string, bar_ts timestamp_ntz, spread double"), 2).collect()}
    assert set(got) == set(series) and got["good"].t_stat < -3
    assert all(got[k].t_stat is None and got[k].lags is None for k in series if k != "good")


def test_p_values_at_published_critical_values(spark):
    """Asymptotic critical values of the two-variable test with a constant; the function falls nowhere."""
    at = [(-3.90, 0.01), (-3.34, 0.05), (-3.04, 0.10)]
    df = spark.createDataFrame([(float(t),) for t, _ in at] + [(float(t),) for t in np.arange(-20, 1.2, 0.05)] + [(None,)], "t double")
    got = [r.p for r in df.select(P.cointegration_p_value(F.col("t")).alias("p")).collect()]
    assert all(abs(p - q) < 0.0015 for p, (_, q) in zip(got, at, strict=False))
    curve = got[3:-1]
    assert got[-1] is None and curve == sorted(curve) and (curve[0], curve[-1]) == (0.0, 1.0)


def test_engle_granger_holds_no_series_in_a_worker(spark):
    plan = P.engle_granger(pair_frame(spark, range(9), range(9)))._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Python" not in plan and "partial_covar" in plan


def trace_by_hand(levels, lags):
    """Trace statistics by least squares on the rows and an eigenvalue problem."""
    d = np.diff(levels, axis=0)
    rows = np.arange(lags, len(d))
    z = np.column_stack([*(d[rows - j] for j in range(1, lags + 1)), np.ones(len(rows))])
    out = lambda v: v - z @ np.linalg.lstsq(z, v, rcond=None)[0]
    r0, r1 = out(d[rows]), out(levels[rows])
    values = np.sort(np.linalg.eigvals(np.linalg.inv(r1.T @ r1) @ r1.T @ r0 @ np.linalg.inv(r0.T @ r0) @ r0.T @ r1).real)[::-1]
    return [-len(rows) * np.log(1 - values[k:]).sum() for k in range(len(values))]


def test_johansen_rank_of_systems_of_several_series(spark):
    """Four series driven by 4, 3, 2 and 1 random walks: 0 to 3 relations."""
    rng, rows, systems = np.random.default_rng(31), [], {}
    for relations in range(4):
        walks = np.cumsum(rng.normal(size=(800, 4 - relations)), axis=0)
        mixed = [walks[:, i % walks.shape[1]] * (1 + i) + (rng.normal(size=800) if i >= walks.shape[1] else 0) for i in range(4)]
        systems[f"r{relations}"] = np.column_stack(mixed)
    for name, levels in systems.items():
        rows += [(name, day(i), *map(float, v)) for i, v in enumerate(levels)]
    rows += [("short", day(i), 1.0 * i, 2.0, 3.0, 4.0) for i in range(5)] + [("flat", day(i), float(rng.normal()), 2.0, float(rng.normal()), 4.0) for i in range(60)]
    rows += [("twice", day(i), float(v[0]), float(v[0]), float(v[1]), float(v[2])) for i, v in enumerate(systems["r0"])] + [(None, day(0), None, None, None, None)]
    df = spark.createDataFrame(rows, "g string, bar_ts timestamp_ntz, a double, b double, c double, d double").repartition(3)
    for lags in (1, 2):
        got = {r.g: r for r in P.johansen_of(df, ("g",), ["a", "b", "c", "d"], lags).collect()}
        for name, levels in systems.items():
            assert got[name].trace == pytest.approx(trace_by_hand(levels, lags), rel=1e-6)
        assert [got[f"r{k}"]["rank"] for k in range(4)] == [0, 1, 2, 3]
        assert all(got[g].trace is None and got[g]["rank"] is None for g in ("short", "flat", "twice", None))


def test_nulls_match_nothing_as_of(spark):
    import duckdb

    ts = lambda v: None if v is None else T0 + datetime.timedelta(seconds=v)
    left = [(1, ts(10), 1, 1.0), (None, ts(10), 2, 1.0), (1, None, 3, 1.0), (2, ts(10), 4, 1.0), (None, None, 5, 1.0), (3, ts(1), 6, 1.0)]
    right = [(1, ts(5), 1, 5.0), (1, None, 2, 9.0), (None, ts(5), 3, 7.0), (2, None, 4, 8.0), (3, ts(0), 5, None)]
    schema = "k int, ts timestamp_ntz, id int, v double"
    got = {r.id: (r.as_of_ts, r.as_of_value) for r in panel.as_of(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", "ts", "v", "id").collect()}
    con = duckdb.connect()
    for name, rows in (("l", left), ("r", right)):
        con.execute(f"CREATE TABLE {name} (k INT, ts TIMESTAMP, id INT, v DOUBLE)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?)", rows)
    wanted = {i: (t, v) for i, t, v in con.execute("SELECT l.id, r.ts, r.v FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.ts >= r.ts").fetchall()}
    assert got == wanted and got[1] == (ts(5), 5.0) and got[2] == (None, None)


def test_winsorizing_keeps_every_row(spark):
    import duckdb

    rows = [("a", 1.0), ("a", 2.0), ("a", 50.0), ("a", None), (None, 3.0), (None, 4.0), ("b", None)]
    got = panel.winsorized(spark.createDataFrame(rows, "symbol string, price double"), 0.1, 0.9)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (symbol VARCHAR, price DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    sql = "WITH b AS (SELECT symbol, quantile_cont(price, 0.1) AS lo, quantile_cont(price, 0.9) AS hi FROM t GROUP BY 1) SELECT t.symbol, price, CASE WHEN price IS NOT NULL THEN greatest(least(price, hi), lo) END AS w FROM t JOIN b ON t.symbol IS NOT DISTINCT FROM b.symbol"
    wanted = con.execute(sql).fetchall()
    assert sorted([(r.symbol, r.price, r.winsorized) for r in got.collect()], key=repr) == [(s, p, pytest.approx(w) if w is not None else None) for s, p, w in sorted(wanted, key=repr)]


def test_tail_risk_of_pairs_without_profit(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("a", "b", -2.0), ("a", "c", None), (None, "c", 5.0)], "sym_y string, sym_x string, pnl double")
    got = {(r.sym_y, r.sym_x): (r.value_at_risk, r.shortfall) for r in trading.tail_risk(df, 0.5).collect()}
    assert got == {("a", "b"): (-0.5, -2.0), ("a", "c"): (None, None), (None, "c"): (5.0, 5.0)}


def test_position_machine_over_many_batches_and_files(spark, tmp_path):
    """More rows a symbol than an Arrow batch, null signals, files in swapped order, and rows of one hour in several files:
    all are decided in order of time, and only once."""
    rng = np.random.default_rng(12)
    z = [None if v > 2.4 else float(v) for v in rng.normal(size=900) * 1.2]
    schema = "symbol string, ts timestamp, seq long, z double"
    rows = [("s", T0 + datetime.timedelta(minutes=i // 2), i, v) for i, v in enumerate(z)]
    part = np.minimum(np.maximum(np.arange(900) // 300 + (rng.random(900) < 0.3), 0), 2)  # some come a file late
    for number, k in enumerate((1, 0, 2)):
        mine = [r for r, p in zip(rows, part, strict=True) if p == k]
        order = rng.permutation(len(mine))
        spark.createDataFrame([mine[i] for i in order], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={number}")
    spark.createDataFrame([("end", T0 + datetime.timedelta(days=9), -1, None)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part=9")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "8 hours")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = jobs.drained(jobs.position_machine(stream, 1.0, 0.5)).where("symbol = 's'").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got, pos = {r.seq: r.pos for r in found}, 0
    assert len(found) == len(got) == 900
    for i, v in enumerate(z):
        pos = pos if v is None else 1 if v < -1 else -1 if v > 1 else 0 if abs(v) < 0.5 else pos
        assert got[i] == pos
    assert spark.conf.get(jobs.STORE, None) is None or "RocksDB" not in spark.conf.get(jobs.STORE)


def test_parts_of_many_files_are_batches_of_the_stream(spark, monkeypatch):
    monkeypatch.setattr(jobs, "FILE_ROWS", 100)
    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet")
    path = jobs.landed(spark, folder)
    files = spark.read.option("recursiveFileLookup", "true").parquet(path).inputFiles()
    assert len(files) == 3 * jobs.files_of(events.count(), 3) + 1 > 6
    assert jobs.drained(jobs.bars(jobs.ticks(spark, folder), "1 hour")).agg(F.sum("n")).first()[0] == events.count()


def test_late_rows_are_dropped_and_repeated_ones_kept_once(spark):
    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/events.parquet").count()
    assert jobs.drained(jobs.bars(jobs.ticks(spark, folder, late=True), "1 hour")).agg(F.sum("n")).first()[0] == n
    path = jobs.landed(spark, folder, repeated=True, late=True)
    assert spark.read.option("recursiveFileLookup", "true").parquet(path).count() > 2 * n


def test_partitions_are_pruned_and_buckets_joined_without_a_shuffle(spark, tmp_path):
    orders = tables.table(spark, "/root/testdata/sf0.001", "orders")
    tables.write(orders.select("o_orderkey", "o_orderstatus"), f"{tmp_path}/o", partition_by=("o_orderstatus",))
    some = tables.read(spark, f"{tmp_path}/o").where("o_orderstatus = 'F'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan and some.count() == orders.where("o_orderstatus = 'F'").count()
    try:
        tables.write_bucketed(orders, "bucketed_orders", 4, "o_orderkey")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        a, b = spark.table("bucketed_orders"), spark.table("bucketed_orders").select("o_orderkey", "o_custkey").alias("b")
        joined = a.join(b, "o_orderkey")
        assert joined.count() == orders.count()
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucketed_orders")


def test_hard_series_of_rolling_and_returns(spark):
    """Constant, one-row and zero-price series, and times that repeat."""
    rows = [("flat", day(i), 5.0) for i in range(6)] + [("one", day(0), 1.0)] + [("zero", day(i), float(i % 2)) for i in range(6)] + [("twice", day(i // 2), float(i)) for i in range(6)]
    bars = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, x double")
    z = rolling.rolling_zscore(bars, 3).where("symbol = 'flat'").collect()
    assert len(z) == 6 and all(r.z is None for r in z)
    assert all(r.z is None for r in rolling.rolling_zscore(bars, 3).where("symbol = 'one'").collect())
    returns = rolling.with_returns(bars.withColumn("close", F.col("x"))).where("symbol = 'zero'").orderBy("bar_ts").collect()
    assert [r.ret for r in returns] == [None, None, -1.0, None, -1.0, None] and all(r.log_ret is None for r in returns)
    assert panel.duplicates(bars, "symbol", "bar_ts").count() == 3
    assert rolling.hurst(bars, (1, 2)).where("symbol in ('flat', 'one')").count() == 0
    assert rolling.variance_ratio(bars, 2).where("symbol = 'flat'").first().vr is None


def test_walk_forward_trades_all_bars_after_the_first_formation(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=43)
    got = trading.walk_forward(pair_frame(spark, 2 * x + 1, x), 10, 5).collect()
    assert sorted(r.bar_ts for r in got) == [day(i) for i in range(10, 43)] and all(abs(r.spread) < 1e-9 for r in got)
    assert {r.fold for r in got} == set(range(7)) and trading.walk_forward(pair_frame(spark, x[:4], x[:4]), 10, 5).count() == 0
