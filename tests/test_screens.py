"""Pair screens against all pairs, and recursions cut in parts against one pass."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import pairs as P
from pairloom.operators import rolling, screens, trading

T0 = datetime.datetime(2024, 1, 1)
day = lambda i: T0 + datetime.timedelta(days=i)
BARS = "symbol string, bar_ts timestamp_ntz, close double"


def walks(seed, symbols, bars):
    rng = np.random.default_rng(seed)
    return 100 + np.cumsum(rng.normal(size=(symbols, bars)), axis=1)


def frame(spark, values, names=None):
    import pandas as pd

    s, t = values.shape
    names = names or [f"s{i:05d}" for i in range(s)]
    pdf = pd.DataFrame({"symbol": np.repeat(names, t), "bar_ts": np.tile([day(i) for i in range(t)], s), "close": values.ravel()})
    return spark.createDataFrame(pdf).select("symbol", F.col("bar_ts").cast("timestamp_ntz").alias("bar_ts"), "close")


def test_top_pairs_of_many_symbols_without_all_pairs(spark):
    values = walks(1, 2000, 64)
    got = screens.top_correlated(frame(spark, values), 20).collect()
    u = values - values.mean(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    corr = np.round(np.triu(u @ u.T, 1) - np.tri(2000), 6)
    wanted = sorted(((-c, i, j) for i, j in np.argwhere(corr >= np.sort(corr, axis=None)[-20]) for c in [corr[i, j]]))[:20]
    assert [(r.sym_y, r.sym_x, round(r["corr"], 6)) for r in got] == [(f"s{i:05d}", f"s{j:05d}", -c) for c, i, j in wanted]
    assert got[0].verified < 0.05 * 2000 * 1999 / 2 and got[0].n == 64


def test_closest_prices_equal_all_pairs(spark):
    values = walks(2, 150, 40)
    bars = frame(spark, values)
    got = [(r.sym_y, r.sym_x, round(r.ssd, 6)) for r in screens.closest_prices(bars, 15).collect()]
    wanted = P.distances(P.candidate_pairs(bars)).orderBy(F.round("ssd", 6), *P.PAIR).limit(15).collect()
    assert got == [(r.sym_y, r.sym_x, round(r.ssd, 6)) for r in wanted]


def test_screens_of_hard_panels(spark):
    rows = [(s, day(i), v) for s, vs in {"a": [1, 2, 4], "b": [2, 4, 8], "flat": [3, 3, 3], "gap": [1, None, 2], "c": [3, 2, 1], "d": [1, 2, 4]}.items() for i, v in enumerate(vs)]
    bars = spark.createDataFrame([(s, t, None if v is None else float(v)) for s, t, v in rows] + [(None, day(0), 1.0)], BARS)
    got = [(r.sym_y, r.sym_x, round(r["corr"], 6)) for r in screens.top_correlated(bars, 3).collect()]
    assert got == [("a", "b", 1.0), ("a", "d", 1.0), ("b", "d", 1.0)]
    assert len(screens.top_correlated(bars, 100).collect()) == 6
    assert screens.top_correlated(spark.createDataFrame([], BARS), 5).collect() == []
    same = frame(spark, np.ones((50, 1)) * np.arange(1.0, 9.0))
    assert [(r.sym_y, r.sym_x) for r in screens.top_correlated(same, 2).collect()] == [("s00000", "s00001"), ("s00000", "s00002")]


def test_pairs_within_clusters(spark):
    """Three clear groups: as many clusters are found, and the pairs are those within them."""
    rng, centres = np.random.default_rng(3), [(0.0, 0.0), (50.0, 0.0), (0.0, 80.0)]
    rows = [(f"s{i:02d}", *(float(c + e) for c, e in zip(centres[i % 3], rng.normal(size=2), strict=True))) for i in range(30)] + [("none", None, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, a double, b double")
    assert P.best_clusters(df, ["a", "b"], (2, 3, 4, 5))[1] == 3
    got = [(r.sym_y, r.sym_x) for r in P.cluster_pairs(df, ["a", "b"], (2, 3, 4, 5)).collect()]
    assert sorted(got) == [(f"s{i:02d}", f"s{j:02d}") for i in range(30) for j in range(i + 1, 30) if i % 3 == j % 3]
    small = P.cluster_pairs(df, ["a", "b"], (2, 3, 4, 5), most=4).collect()
    members = {}
    for r in small:
        members.setdefault(r.cluster, set()).update((r.sym_y, r.sym_x))
    assert max(map(len, members.values())) <= 4 and all(len({int(s[1:]) % 3 for s in m}) == 1 for m in members.values())
    assert all((r.sym_y, r.sym_x) in set(got) for r in small)


def test_symbols_of_equal_features_are_parted_by_name(spark):
    df = spark.createDataFrame([(f"s{i}", 1.0) for i in range(200)], "symbol string, a double")
    got = P.cluster_pairs(df, ["a"], (2,), most=50).collect()
    members = {}
    for r in got:
        members.setdefault(r.cluster, set()).update((r.sym_y, r.sym_x))
    assert max(map(len, members.values())) <= 50 and len(got) == sum(len(m) * (len(m) - 1) // 2 for m in members.values())


# --- recursions in parts of time


def series(seed, n, share=0.15):
    rng = np.random.default_rng(seed)
    return [None if rng.random() < share else float(v) for v in rng.normal(size=n) * 1.2]


def one_pass(rule, columns):
    state, out = rule.start, []
    for row in zip(*columns, strict=True):
        state, made = rule.step(state, row)
        out.append(made)
    return out


def near(got, wanted):
    assert len(got) == len(wanted)
    for g, w in zip(got, wanted, strict=True):
        assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9)) for a, b in zip(g, w, strict=True)), (g, w)


@pytest.mark.parametrize("seconds", [3 * 86_400, 50 * 86_400, 10**9])
def test_exponential_mean_in_parts(spark, seconds):
    sides = {"a": series(1, 120), None: series(2, 90), "b": [None, None, *series(3, 40)]}
    rows = [(s, day(i), v) for s, vs in sides.items() for i, v in enumerate(vs)]
    found = rolling.exponential_mean(spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, x double").repartition(3), 0.3, part_seconds=seconds).collect()
    for s, vs in sides.items():
        near([(r.ewm,) for r in sorted((r for r in found if r.symbol == s), key=lambda r: r.bar_ts)], one_pass(rolling.exponential_rule(0.3), [vs]))


@pytest.mark.parametrize("seconds", [3 * 86_400, 10**9])
def test_kalman_in_parts(spark, seconds):
    y, x = series(4, 150), series(5, 150)
    df = spark.createDataFrame([("b", "a", day(i), p, q) for i, (p, q) in enumerate(zip(y, x, strict=True))], "sym_y string, sym_x string, bar_ts timestamp_ntz, y double, x double")
    found = P.kalman(df, 1e-3, part_seconds=seconds).orderBy("bar_ts").collect()
    near([(r.beta, r.alpha, r.innovation) for r in found], one_pass(P.kalman_rule(1e-3 / (1 - 1e-3), 1.0), [y, x]))


@pytest.mark.parametrize("seconds", [2 * 86_400, 10**9])
def test_guarded_positions_in_parts(spark, seconds):
    z = series(6, 400)
    df = spark.createDataFrame([("b", "a", day(i), v) for i, v in enumerate(z)], "sym_y string, sym_x string, bar_ts timestamp_ntz, z double")
    found = [r.pos for r in trading.guarded_positions(df, 1.0, 0.5, 2.0, 3, part_seconds=seconds).orderBy("bar_ts").collect()]
    assert found == trading.guarded_reference(z, 1.0, 0.5, 2.0, 3) and len(set(found)) == 3


def test_a_long_series_is_no_single_task(spark):
    df = spark.range(20_000).select(F.lit("a").alias("symbol"), (F.lit(T0) + F.make_interval(secs=F.col("id"))).cast("timestamp_ntz").alias("bar_ts"), F.rand(1).alias("x"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in rolling.exponential_mean(df, 0.1, part_seconds=500).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 20_000 and len(sizes) > 1 and max(sizes) < 12_000
