"""Pair selection: candidates, screens, hedge ratios, spreads, and tests of mean reversion."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.stats import safe_beta, safe_corr

from .sequential import PART_SECONDS, Recursion, scanned_in_parts

PAIR = ("sym_y", "sym_x")
#: The published response surface of the p-value of the two-variable cointegration test with a constant (the
#: range of the statistic with its bend, and polynomials below and above it), the coefficients of a published approximation
#: of the normal distribution, and 5 % critical values of the Johansen trace test with a constant, for 1, 2, ... series
#: that are left.
TAU_RANGE = (-18.86, -2.62, 0.92)
TAU_SMALL = (2.92, 1.5012, 0.039796)
TAU_LARGE = (2.1945, 0.64695, -0.29198, -0.042377)
NORMAL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
JOHANSEN_TRACE_5 = (3.76, 15.41, 29.68, 47.21, 68.52, 94.15)
#: Share of a variable's variance below which what is left of it is rounding.
SINGULAR = 1e-12


def by_pair():
    return Window.partitionBy(*PAIR).orderBy("bar_ts")


def candidate_pairs(bars: DataFrame, x: str = "close") -> DataFrame:
    """sym_y < sym_x on common bars, with y and x. Quadratic in symbols by definition; time splits the work."""
    a = bars.select("bar_ts", F.col("symbol").alias("sym_y"), F.col(x).alias("y"))
    b = bars.select("bar_ts", F.col("symbol").alias("sym_x"), F.col(x).alias("x"))
    return a.join(b, "bar_ts").where("sym_y < sym_x").select("sym_y", "sym_x", "bar_ts", "y", "x")


def correlations(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*PAIR).agg(safe_corr(F.col("y"), F.col("x")).alias("corr"), F.count("*").alias("n"))


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    return correlations(pairs).orderBy(F.round("corr", 6).desc_nulls_last(), *PAIR).limit(k)


def distances(pairs: DataFrame) -> DataFrame:
    """Sum of squared differences of prices divided by their first."""
    scaled = lambda c: F.col(c) / F.nullif(F.first(c).over(by_pair()), F.lit(0.0))
    return pairs.withColumns({"ny": scaled("y"), "nx": scaled("x")}).groupBy(*PAIR).agg(F.sum(F.pow(F.col("ny") - F.col("nx"), 2)).alias("ssd"))


def hedge_ratios(pairs: DataFrame) -> DataFrame:
    """alpha and beta of y on x by least squares."""
    beta = safe_beta(F.col("y"), F.col("x"))
    return pairs.groupBy(*PAIR).agg(beta.alias("beta"), (F.avg("y") - beta * F.avg("x")).alias("alpha"))


def spreads(pairs: DataFrame, ratios: DataFrame) -> DataFrame:
    """The residual y - alpha - beta x; a row a pair comes from ratios and joins on the pair."""
    return pairs.join(ratios, list(PAIR)).select(*PAIR, "bar_ts", "y", "x", "alpha", "beta", (F.col("y") - F.col("alpha") - F.col("beta") * F.col("x")).alias("spread"))


def spread_zscores(spread: DataFrame, n: int) -> DataFrame:
    w = by_pair().rowsBetween(-(n - 1), 0)
    s = F.col("spread")
    z = F.when(F.count(s).over(w) == n, (s - F.avg(s).over(w)) / F.nullif(F.stddev_samp(s).over(w), F.lit(0.0)))
    return spread.withColumn("z", z)


def dickey_fuller(spread: DataFrame) -> DataFrame:
    """Regression of d(s) on s[-1] with a constant: lam, its t statistic (n - 2 degrees of freedom) and the half-life."""
    lagged = spread.select(*PAIR, F.lag("spread").over(by_pair()).alias("l"), F.col("spread").alias("s")).where("l is not null").withColumn("d", F.col("s") - F.col("l"))
    n, vl, vd = F.count("*"), F.var_pop("l"), F.var_pop("d")
    fit = lagged.groupBy(*PAIR).agg(n.alias("n"), safe_beta(F.col("d"), F.col("l")).alias("lam"), vl.alias("vl"), vd.alias("vd"))
    rss = F.col("n") * (F.col("vd") - F.col("lam") * F.col("lam") * F.col("vl"))
    se = F.sqrt(rss / (F.col("n") - 2) / F.nullif(F.col("n") * F.col("vl"), F.lit(0.0)))
    half = F.when((F.col("lam") > -1) & (F.col("lam") < 0), -F.ln(F.lit(2.0)) / F.ln(1 + F.col("lam")))
    return fit.where("n > 2").select(*PAIR, "lam", (F.col("lam") / F.nullif(se, F.lit(0.0))).alias("t_stat"), half.alias("half_life"))


def swept(fit: DataFrame, first: str, others: list[str]) -> DataFrame:
    """Moments of `others` with what `first` explains taken out: one step of solving the normal equations. A variable that
    earlier ones explain but for rounding has no part of its own: nulls."""
    pivot = F.when(F.col(f"{first}_{first}") > SINGULAR * F.col(f"{first}_all"), F.col(f"{first}_{first}"))
    left = {f"{a}_{b}": F.col(f"{a}_{b}") - F.col(f"{first}_{a}") * F.col(f"{first}_{b}") / pivot for i, a in enumerate(others) for b in others[i:]}
    return fit.withColumns(left)


def augmented_dickey_fuller(spread: DataFrame, max_lags: int = 2) -> DataFrame:
    """Regression of d(s) on s[-1], lagged changes and a constant, for each pair: n, lags, t_stat of s[-1].

    All numbers of lags up to the greatest are fitted on the same rows, from one aggregation of the products of all
    variables; the one with the least Schwarz criterion counts (the smallest of equals). So a series is never in one
    place: what is shuffled after the lags is one row of moments a pair and task. Series too short, constant, or explained
    by their lags give nulls."""
    w = by_pair()
    rows = spread.select(*PAIR, "bar_ts", F.lag("spread").over(w).alias("l"), (F.col("spread") - F.lag("spread").over(w)).alias("y"))
    lagged = [f"d{j}" for j in range(1, max_lags + 1)]
    rows = rows.withColumns({d: F.lag("y", j).over(w) for j, d in enumerate(lagged, 1)})
    names = [*lagged, "l", "y"]
    whole = rows.dropna(subset=names)
    products = [F.covar_pop(a, b).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    fit = spread.select(*PAIR).distinct().join(whole.groupBy(*PAIR).agg(F.count("*").alias("n"), *products), list(PAIR), "left")
    fit = fit.withColumns({f"{c}_all": F.col(f"{c}_{c}") for c in names})
    for lags in range(max_lags + 1):
        level = F.when(F.col("l_l") > SINGULAR * F.col("l_all"), F.col("l_l"))
        slope, freedom = F.col("l_y") / level, F.col("n") - (lags + 2)
        rest = F.col("y_y") - slope * F.col("l_y")
        rest = F.when((freedom > 0) & (rest > SINGULAR * F.col("y_all")), rest)
        fit = fit.withColumns({f"rest{lags}": rest, f"slope{lags}": slope, f"level{lags}": level})
        if lags < max_lags:
            fit = swept(fit, names[lags], names[lags + 1 :])
    n = F.col("n").cast("double")
    tried = [
        F.struct((n * F.ln(f"rest{k}") + F.ln(n) * (k + 2)).alias("schwarz"), F.lit(k).alias("lags"), (F.col(f"slope{k}") / F.sqrt(F.col(f"rest{k}") / F.nullif(n - (k + 2), F.lit(0.0)) / F.col(f"level{k}"))).alias("t_stat"))
        for k in range(max_lags + 1)
    ]
    best = fit.select(*PAIR, "n", F.array_min(F.filter(F.array(*tried), lambda t: t["schwarz"].isNotNull())).alias("best"))
    return best.select(*PAIR, F.coalesce("n", F.lit(0)).alias("n"), "best.lags", "best.t_stat")


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, by a published rational approximation with an error below 7.5e-8."""
    k = 1 / (1 + 0.2316419 * F.abs(x))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * k * (NORMAL[0] + k * (NORMAL[1] + k * (NORMAL[2] + k * (NORMAL[3] + k * NORMAL[4]))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def cointegration_p_value(t: Column) -> Column:
    """Asymptotic p-value of the residual-based statistic for two variables with a constant."""
    poly = lambda c: sum((t**i * v for i, v in enumerate(c[1:], 1)), F.lit(c[0]))
    low, bend, high = TAU_RANGE
    inside = F.when(t <= bend, poly(TAU_SMALL)).otherwise(poly(TAU_LARGE))
    return F.when(t > high, 1.0).when(t < low, 0.0).when(t.isNotNull(), normal_cdf(inside))


def engle_granger(pairs: DataFrame, max_lags: int = 2, level: float = 0.05) -> DataFrame:
    """The augmented statistic of each pair's residuals, its number of lags and p-value, and whether it rejects that the
    pair is not cointegrated. Nulls where there is no statistic."""
    found = augmented_dickey_fuller(spreads(pairs, hedge_ratios(pairs)), max_lags)
    return found.withColumn("p_value", cointegration_p_value(F.col("t_stat"))).select(*PAIR, "n", "lags", "t_stat", "p_value", (F.col("p_value") < level).alias("cointegrated"))


def trace_of_moments(moments: np.ndarray, n: int, k: int) -> tuple[list[float] | None, int | None]:
    """Trace statistics for 0, 1, ... relations and the rank they give, from the covariances of k changes, k levels before
    them, and the lagged changes; None where there are too few rows or a level or change has no part of its own."""
    if n <= len(moments) + 1 or not np.isfinite(moments).all():
        return None, None
    z = moments[2 * k :, 2 * k :]
    s = moments[: 2 * k, : 2 * k] - moments[: 2 * k, 2 * k :] @ np.linalg.pinv(z, rcond=SINGULAR, hermitian=True) @ moments[2 * k :, : 2 * k]
    scale = np.sqrt(np.diag(moments)[: 2 * k])
    if (np.diag(s) <= SINGULAR * scale**2).any():
        return None, None
    s = s / np.outer(scale, scale)
    s00, s11, s01 = s[:k, :k], s[k:, k:], s[:k, k:]
    if min(np.linalg.eigvalsh(s00)[0], np.linalg.eigvalsh(s11)[0]) <= SINGULAR:
        return None, None
    root = np.linalg.inv(np.linalg.cholesky(s11))
    values = np.linalg.eigvalsh(root @ s01.T @ np.linalg.solve(s00, s01) @ root.T)[::-1].clip(0, 1 - 1e-12)
    trace = [float(-n * np.log(1 - values[r:]).sum()) for r in range(k)]
    critical = JOHANSEN_TRACE_5[k - 1 :: -1]
    return trace, next((r for r in range(k) if trace[r] < critical[r]), k)


def johansen_of(panel: DataFrame, keys: tuple[str, ...], values: list[str], lags: int = 1) -> DataFrame:
    """keys, n, trace (statistics for 0, 1, ... relations among the named series) and rank at 5 %, for each group of rows.

    One aggregation gives all covariances of changes, levels and lagged changes; only one row of them a group is solved in
    Python, so no series is in a worker. Rows with a null, or before all lags are there, do not count."""
    k = len(values)
    if not 1 <= k <= len(JOHANSEN_TRACE_5):
        raise ValueError(f"critical values are known for 1 to {len(JOHANSEN_TRACE_5)} series")
    w = Window.partitionBy(*keys).orderBy("bar_ts")
    rows = panel.select(*keys, "bar_ts", *((F.col(c) - F.lag(c).over(w)).alias(f"_d{i}") for i, c in enumerate(values)), *(F.lag(c).over(w).alias(f"_l{i}") for i, c in enumerate(values)))
    rows = rows.withColumns({f"_z{i}_{j}": F.lag(f"_d{i}", j).over(w) for j in range(1, lags + 1) for i in range(k)})
    names = [*(f"_d{i}" for i in range(k)), *(f"_l{i}" for i in range(k)), *(f"_z{i}_{j}" for j in range(1, lags + 1) for i in range(k))]
    m = len(names)
    products = [F.covar_pop(names[i], names[j]) for i in range(m) for j in range(i, m)]
    whole = rows.dropna(subset=names).groupBy(*keys).agg(F.count("*").alias("n"), F.array(*products).alias("moments"))
    fit = panel.select(*keys).distinct().select(*(F.col(c).alias(f"_{c}") for c in keys)).join(whole, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys)), "left")
    fit = fit.select(*(F.col(f"_{c}").alias(c) for c in keys), F.coalesce("n", F.lit(0)).alias("n"), "moments")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(m)
        for pdf in batches:
            found = []
            for n, flat in zip(pdf.n, pdf.moments, strict=True):
                square = np.full((m, m), np.nan)
                if flat is not None:
                    square[upper] = np.asarray(flat, float)
                    square.T[upper] = square[upper]
                found.append(trace_of_moments(square, int(n), k))
            out = pdf.drop(columns="moments").assign(trace=pd.Series([t for t, _ in found], index=pdf.index, dtype=object), rank=pd.Series([r for _, r in found], index=pdf.index, dtype="Int32"))
            yield out

    schema = T.StructType([*fit.drop("moments").schema.fields, T.StructField("trace", T.ArrayType(T.DoubleType())), T.StructField("rank", T.IntegerType())])
    return fit.mapInPandas(solve, schema)


def johansen(pairs: DataFrame, lags: int = 1) -> DataFrame:
    """The test for each pair's two series: n, trace_0, trace_1, rank."""
    found = johansen_of(pairs, PAIR, ["y", "x"], lags)
    return found.select(*PAIR, "n", F.col("trace")[0].alias("trace_0"), F.col("trace")[1].alias("trace_1"), "rank")


def correlation_matrix(bars: DataFrame, column: str) -> DataFrame:
    """symbol, other, corr for all ordered pairs of symbols; as many rows as the square of their number, by definition."""
    one, two = (bars.select(F.col("symbol").alias(n), "bar_ts", F.col(column).alias(v)) for n, v in (("symbol", "y"), ("other", "x")))
    found = one.join(two, "bar_ts").groupBy("symbol", "other").agg(safe_corr(F.col("y"), F.col("x")).alias("_c"))
    return found.select("symbol", "other", F.when(F.col("symbol") == F.col("other"), 1.0).otherwise(F.col("_c")).alias("corr"))


def pca_residuals(wide: DataFrame, k: int) -> DataFrame:
    """bar_ts, factors, and what the factors leave of each symbol's (demeaned) return; the symbols are the columns of the
    panel beside bar_ts. Times at which a symbol has no value are left out."""
    symbols = [c for c in wide.columns if c != "bar_ts"]
    wide = wide.dropna(subset=symbols)
    vectors = VectorAssembler(inputCols=symbols, outputCol="v", handleInvalid="skip").transform(wide)
    means = wide.agg(*(F.avg(s).alias(s) for s in symbols)).first()
    model = PCA(k=k, inputCol="v", outputCol="f").fit(vectors)
    pc = model.pc.toArray()
    back = [sum((F.get("factors", F.lit(j)) - F.lit(float(pc[:, j] @ np.array([means[s] for s in symbols])))) * F.lit(float(pc[i, j])) for j in range(k)) for i in range(len(symbols))]
    return model.transform(vectors).withColumn("factors", vector_to_array("f")).select("bar_ts", "factors", *((F.col(s) - F.lit(float(means[s])) - b).alias(s) for s, b in zip(symbols, back, strict=True)))


def clusters(features: DataFrame, names: list[str], k: int, seed: int = 1) -> DataFrame:
    """symbol and cluster, by k-means on named features."""
    vectors = VectorAssembler(inputCols=names, outputCol="v", handleInvalid="skip").transform(features)
    return KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(vectors).transform(vectors).select("symbol", "cluster")


def best_clusters(features: DataFrame, names: list[str], ks: tuple[int, ...], seed: int = 1) -> tuple[DataFrame, int]:
    """symbol, cluster and the features' vector, for the number of clusters with the highest silhouette (the smallest of
    equals), and that number. Numbers that do not give at least two clusters are no choice; without any, all are in one."""
    vectors = VectorAssembler(inputCols=names, outputCol="v", handleInvalid="skip").transform(features).select("symbol", "v").persist()
    judge, best = ClusteringEvaluator(featuresCol="v", predictionCol="cluster"), None
    for k in sorted(ks):
        found = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(vectors).transform(vectors)
        if found.select("cluster").distinct().count() > 1:
            score = judge.evaluate(found)
            best = max(best or (score, -k, found), (score, -k, found), key=lambda b: b[:2])
    return (best[2], -best[1]) if best else (vectors.withColumn("cluster", F.lit(0)), 1)


def cluster_pairs(features: DataFrame, names: list[str], ks: tuple[int, ...] = (2, 3, 4, 6, 8, 12, 16), most: int = 500, seed: int = 1) -> DataFrame:
    """sym_y < sym_x and cluster: the pairs of symbols within a cluster, the universe of a pair search.

    Clusters of more than `most` symbols are clustered again, into as many parts as bring them to that size, until none is
    larger, so a cluster gives most * (most - 1) / 2 pairs at most and their number grows with that of the symbols. Only
    symbols of equal features cannot be parted so: they are dealt by a hash of their names. Symbols with a null feature are
    in no cluster."""
    found = best_clusters(features, names, ks, seed)[0].select("symbol", "v", F.col("cluster").cast("string").alias("cluster")).persist()
    while True:
        large = [(r.cluster, r["count"]) for r in found.groupBy("cluster").count().where(F.col("count") > most).collect()]  # names of clusters
        if not large:
            break
        parts = [found.where(~F.col("cluster").isin([c for c, _ in large]))]
        for name, size in large:
            mine, k = found.where(F.col("cluster") == name), -(-size // most)
            split = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="part").fit(mine).transform(mine)
            if split.select("part").distinct().count() < 2:
                split = mine.withColumn("part", F.pmod(F.xxhash64("cluster", "symbol"), F.lit(k)))
            parts.append(split.select("symbol", "v", F.concat_ws(".", "cluster", "part").alias("cluster")))
        found = reduce(DataFrame.unionByName, parts).persist()
    y, x = (found.select("cluster", F.col("symbol").alias(n)) for n in PAIR)
    return y.join(x, "cluster").where("sym_y < sym_x").select(*PAIR, "cluster")


def element_of(first: tuple, then: tuple) -> tuple:
    """Filtering elements (A, b, C, eta, J) of stretches of rows, one after the other; arrays over many at once."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = first, then
    eye, turned = np.eye(2), lambda m: np.swapaxes(m, -1, -2)
    left = a2 @ np.linalg.inv(eye + c1 @ j2)
    right = turned(a1) @ np.linalg.inv(eye + j2 @ c1)
    return left @ a1, left @ (b1 + c1 @ e2) + b2, left @ c1 @ turned(a2) + c2, right @ (e2 - j2 @ b1) + e1, right @ j2 @ a1 + j1


def packed(element: tuple) -> list[float]:
    return np.concatenate([np.ravel(m) for m in element]).tolist()


def unpacked(values: list[float]) -> tuple:
    v = np.asarray(values, float)
    return v[:4].reshape(2, 2), v[4:6].reshape(2, 1), v[6:10].reshape(2, 2), v[10:12].reshape(2, 1), v[12:16].reshape(2, 2)


def kalman_rule(drift: float, noise: float) -> Recursion:
    """A random-walk (beta, alpha). The map of rows is a filtering element: how the state behind them depends on the state
    before, and what they say of that one; elements compose associatively."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (beta, alpha, bb, ba, aa), (y, x) = state, row
        bb, aa = bb + drift, aa + drift
        if y is None or x is None:
            return (beta, alpha, bb, ba, aa), (beta, alpha, None)
        gain_b, gain_a = bb * x + ba, ba * x + aa
        size = x * gain_b + gain_a + noise
        error = y - beta * x - alpha
        beta, alpha = beta + gain_b / size * error, alpha + gain_a / size * error
        bb, ba, aa = bb - gain_b * gain_b / size, ba - gain_b * gain_a / size, aa - gain_a * gain_a / size
        return (beta, alpha, bb, ba, aa), (beta, alpha, error / math.sqrt(size))

    def of_rows(columns: list[np.ndarray]) -> list[float]:
        known = np.array([y is not None and x is not None for y, x in zip(*columns, strict=True)])
        y, x = (np.array([v if k else 0.0 for v, k in zip(c, known, strict=True)], float) for c in columns)
        h = np.stack([x, np.ones(len(x))], 1)[:, :, None] * known[:, None, None]  # nothing is seen of a row without both
        size = drift * (h * h).sum(1)[:, :, None] + noise
        kept = np.eye(2) - drift * h @ np.swapaxes(h, 1, 2) / size
        element = (kept, drift * h * y[:, None, None] / size, drift * kept, h * y[:, None, None] / size, h @ np.swapaxes(h, 1, 2) / size)
        while len(element[0]) > 1:  # neighbours at a time
            n = len(element[0]) // 2 * 2
            joined = element_of(tuple(m[:n:2] for m in element), tuple(m[1:n:2] for m in element))
            element = tuple(np.concatenate([j, m[n:]]) for j, m in zip(joined, element, strict=True))
        return packed(element)

    def composed(first: list[float], then: list[float]) -> list[float]:
        return packed(element_of(unpacked(first), unpacked(then)))

    def passed(map_: list[float], state: tuple) -> tuple:
        a, b, c, eta, j = unpacked(map_)
        beta, alpha, bb, ba, aa = state
        mean, spread = np.array([[beta], [alpha]]), np.array([[bb, ba], [ba, aa]])
        left = a @ np.linalg.inv(np.eye(2) + spread @ j)
        mean, spread = left @ (mean + spread @ eta) + b, left @ spread @ a.T + c
        return float(mean[0, 0]), float(mean[1, 0]), float(spread[0, 0]), float((spread[0, 1] + spread[1, 0]) / 2), float(spread[1, 1])

    state = "_beta double, _alpha double, _bb double, _ba double, _aa double"
    return Recursion((0.0, 0.0, 1.0, 0.0, 1.0), step, "beta double, alpha double, innovation double", state, of_rows, composed, passed)


def kalman(pairs: DataFrame, delta: float = 1e-4, noise: float = 1.0, part_seconds: int = PART_SECONDS) -> DataFrame:
    """Dynamic hedge ratio: a random-walk (beta, alpha) filtered along each pair's series, in time order. Bars without y or
    x leave the state as it is, but for the drift of its spread, and have no innovation. Parts of a series run at once."""
    rows = pairs.select(*PAIR, "bar_ts", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    return scanned_in_parts(rows, PAIR, ("bar_ts",), ("y", "x"), kalman_rule(delta / (1 - delta), noise), part_seconds).drop("y", "x")
