"""Statistics as columns, written with moments so that constant series give null instead of an error.

Aggregates take an optional window; all stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def on(c: Column, window: WindowSpec | None) -> Column:
    return c if window is None else c.over(window)


def round6(c: Column) -> Column:
    return F.round(c, 6)


def safe_corr(y: Column, x: Column, window: WindowSpec | None = None) -> Column:
    """Correlation; null where a side is constant."""
    spread = on(F.stddev_pop(y), window) * on(F.stddev_pop(x), window)
    return on(F.covar_pop(y, x), window) / F.nullif(spread, F.lit(0.0))


def safe_beta(y: Column, x: Column, window: WindowSpec | None = None) -> Column:
    """Slope of y on x; null where x is constant."""
    return on(F.covar_pop(y, x), window) / F.nullif(on(F.var_pop(x), window), F.lit(0.0))


def full(c: Column, counted: Column, window: WindowSpec, n: int) -> Column:
    """c where the frame holds n values, else null."""
    return F.when(F.count(counted).over(window) == n, c)


def zscore(x: Column, window: WindowSpec, n: int) -> Column:
    return full((x - F.avg(x).over(window)) / F.nullif(F.stddev_samp(x).over(window), F.lit(0.0)), x, window, n)


def sample_skewness(x: Column) -> Column:
    """Skewness with the correction for samples; null below three values."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column) -> Column:
    """Excess kurtosis with the correction for samples; null below four values."""
    n = F.count(x)
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))
