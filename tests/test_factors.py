"""Factors by block power iteration against the singular value decomposition."""

import numpy as np

from pairloom.operators import factors

from .test_screens import BARS, day, frame


def residuals_by_hand(values, k):
    centred = values - values.mean(1, keepdims=True)
    u, s, v = np.linalg.svd(centred, full_matrices=False)
    return centred - (u[:, :k] * s[:k]) @ v[:k]


def test_residuals_of_many_symbols(spark):
    rng = np.random.default_rng(1)
    values = 50 + rng.normal(size=(5000, 3)) @ (np.array([[9.0], [5.0], [3.0]]) * rng.normal(size=(3, 24))) + rng.normal(size=(5000, 24)) * 0.3
    wanted = residuals_by_hand(values, 3)
    got = factors.factor_residuals(frame(spark, values), 3).toPandas()
    table = got.assign(i=got.symbol.str[1:].astype(int)).sort_values(["i", "bar_ts"]).residual.to_numpy().reshape(values.shape)
    assert np.abs(table - wanted).max() < 1e-3 and abs((table**2).sum() / (wanted**2).sum() - 1) < 1e-6


def test_small_and_odd_panels(spark):
    assert factors.factor_residuals(spark.createDataFrame([], BARS), 2).collect() == []
    rows = [(s, day(i), float(v * (1 + j))) for j, s in enumerate("abc") for i, v in enumerate([1, 5, 2, 8])]
    gaps = [("a", day(9), 1.0), (None, day(0), 3.0), ("b", day(8), None)]
    found = factors.factor_residuals(spark.createDataFrame(rows + gaps, BARS), 2).collect()  # of rank one: nothing is left
    assert len(found) == 12 and max(abs(r.residual) for r in found) < 1e-9
    flat = factors.factor_residuals(spark.createDataFrame([(s, day(i), 4.0) for s in "ab" for i in range(3)], BARS), 1).collect()
    assert [r.residual for r in flat] == [0.0] * 6
