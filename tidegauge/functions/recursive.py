"""Recursions along a series: exponential averages, MACD, GARCH variance. Each series is one ordered pass in a grouped pandas function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from .windows import KEYS


def along(df: DataFrame, f: Callable[[pd.DataFrame], dict[str, np.ndarray]], columns: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """df with columns that f makes of each series in order of ts; NaN and infinities become null."""
    schema = StructType([*df.schema, *[StructField(c, DoubleType()) for c in columns]])

    def one(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("ts", kind="stable").reset_index(drop=True)
        made = f(own)
        for c in columns:
            x = np.asarray(made[c], float)
            own[c] = np.where(np.isfinite(x), x, np.nan)
        return own

    return df.groupBy(*keys).applyInPandas(one, schema)


def ewm(df: DataFrame, x: str, span: float | None = None, alpha: float | None = None, operation: str = "mean", adjust: bool = True, out: str | None = None) -> DataFrame:
    """Exponentially weighted mean, std or var by span or alpha."""
    if (span is None) == (alpha is None):
        raise ValueError("give span or alpha")
    if operation not in ("mean", "std", "var"):
        raise ValueError(f"unknown operation {operation!r}")
    name = out or f"ewm_{operation}"
    return along(df, lambda s: {name: getattr(s[x].ewm(span=span, alpha=alpha, adjust=adjust), operation)().to_numpy()}, [name])


def macd(df: DataFrame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Averages begin with the first price."""

    def one(s: pd.DataFrame) -> dict[str, np.ndarray]:
        mean = lambda v, n: v.ewm(span=n, adjust=False).mean()
        line = mean(s[x], fast) - mean(s[x], slow)
        smooth = mean(line, signal)
        return {"macd": line, "macd_signal": smooth, "macd_histogram": line - smooth}

    return along(df, one, ["macd", "macd_signal", "macd_histogram"])


def garch_path(r: np.ndarray, omega: float, alpha: float, beta: float, first: float | None = None) -> np.ndarray:
    """Conditional variances of returns; the first is their own variance."""
    start = r.var() if first is None else first
    own = omega + alpha * r[:-1] ** 2
    if beta >= 1 - 1e-9:
        return start + np.r_[0.0, np.cumsum(own)]
    # v[t] = beta v[t-1] + own[t-1] is an exponential mean of own / (1 - beta), which pandas runs through in compiled code.
    return pd.Series(np.r_[start, own / (1 - beta)]).ewm(alpha=1 - beta, adjust=False).mean().to_numpy()


def garch_volatility(df: DataFrame, x: str = "returns", omega: float = 1e-5, alpha: float = 0.1, beta: float = 0.85, out: str = "garch_vol") -> DataFrame:
    """Conditional deviation by fixed parameters over returns that aren't null; none for under 10 of them."""

    def one(s: pd.DataFrame) -> dict[str, np.ndarray]:
        r, v = s[x].to_numpy(float), np.full(len(s), np.nan)
        known = np.isfinite(r)
        if known.sum() >= 10:
            v[known] = np.sqrt(garch_path(r[known], omega, alpha, beta))
        return {out: v}

    return along(df, one, [out])
