"""Windows over a series: rows of one symbol and timeframe in order of ts.

A series has one row a bar, so its length is bounded by time, not by the ticks behind it; all functions of a select share
one partitioning and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("symbol", "timeframe")


def series(keys: tuple[str, ...] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("ts")


def last_rows(n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return series().rowsBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def roll(f: Callable[[Column], Column], x: str | Column, n: int, min_periods: int | None = None) -> Column:
    """f over the last n rows; null until n (or min_periods) of their values aren't null."""
    x, w = col(x), last_rows(n)
    return F.when(F.count(x).over(w) >= (n if min_periods is None else min_periods), f(x).over(w))


def div(a: Column, b: Column) -> Column:
    """a / b; null for a zero divisor."""
    return F.try_divide(a, b)


def root(x: Column) -> Column:
    """Square root; null below zero."""
    return F.when(x >= 0, F.sqrt(x))


def finite(x: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def quantile(x: str | Column, q: float, n: int) -> Column:
    """Linearly interpolated quantile of the last n rows."""
    return roll(lambda c: F.percentile(c, F.lit(q)), x, n)


def skewness(x: str | Column, n: int) -> Column:
    """Bias-corrected skewness of the last n rows; null without spread."""
    x, w = col(x), last_rows(n)
    k = (n * (n - 1)) ** 0.5 / (n - 2)
    return F.when((F.count(x).over(w) == n) & (F.var_pop(x).over(w) > 0), k * F.skewness(x).over(w))


def kurtosis(x: str | Column, n: int) -> Column:
    """Bias-corrected excess kurtosis of the last n rows; null without spread."""
    x, w = col(x), last_rows(n)
    return F.when((F.count(x).over(w) == n) & (F.var_pop(x).over(w) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(w) + 6))


def corr(x: str | Column, y: str | Column, w: WindowSpec | None = None) -> Column:
    """Pearson's correlation of the pairs without a null, as an aggregate or over a window; null without spread, where corr() raises."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    over = (lambda e: e) if w is None else (lambda e: e.over(w))
    return div(over(F.covar_pop(a, b)), over(F.stddev_pop(a)) * over(F.stddev_pop(b)))


def correlation(x: str | Column, y: str | Column, n: int) -> Column:
    """Correlation of the last n rows; null until there are n pairs."""
    x, y, w = col(x), col(y), last_rows(n)
    return F.when(F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(w) == n, corr(x, y, w))
