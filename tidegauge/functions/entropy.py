"""Entropy and complexity of windows: histogram and ordinal forms as column expressions, template and spectral ones as pandas functions."""

from __future__ import annotations

import math
from collections import Counter
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recursive import along
from .windows import KEYS, col, finite, last_rows, series


def histogram(x: str, n: int, bins: int = 10) -> Column:
    """Shares of the occupied ones of equal bins between the least and greatest of the last n values; null until there are n."""
    w = last_rows(n)
    values = F.collect_list(col(x)).over(w)
    low, high = F.min(col(x)).over(w), F.max(col(x)).over(w)
    number = lambda v: F.when(high == low, F.lit(bins // 2)).otherwise(F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(F.transform(values, number), lambda k: k == b)) / F.size(values))
    return F.when(F.count(col(x)).over(w) == n, F.filter(counts, lambda p: p > 0))


def with_histogram_entropies(df: DataFrame, x: str = "close", n: int = 100, bins: int = 10, alpha: float = 2.0) -> DataFrame:
    """shannon (bits), shannon_nats and renyi (bits)."""
    df = df.withColumn("_p", histogram(x, n, bins))
    total = lambda f: F.aggregate("_p", F.lit(0.0), lambda a, p: a + f(p))
    bits = -total(lambda p: p * F.log2(p))
    renyi = bits if alpha == 1 else F.log2(total(lambda p: F.pow(p, F.lit(alpha)))) / (1 - alpha)
    return df.withColumns({"shannon": bits + 0.0, "shannon_nats": bits * math.log(2), "renyi": renyi}).drop("_p")


def with_permutation_entropy(df: DataFrame, x: str = "close", n: int = 100, order: int = 3, out: str = "permutation") -> DataFrame:
    """Entropy of the order patterns of consecutive values in the last n, over its greatest possible value."""
    now = [F.lag(col(x), order - 1 - k).over(series()) for k in range(order)]
    signs = [(now[i] > now[j]).cast("string") for i in range(order) for j in range(i + 1, order)]
    df = df.withColumn("_pattern", F.when(now[0].isNotNull(), F.concat_ws("", *signs)))
    w, m = last_rows(n - order + 1), n - order + 1
    df = df.withColumn("_all", F.when(F.count("_pattern").over(w) == m, F.collect_list("_pattern").over(w)))
    shares = F.transform(F.array_distinct("_all"), lambda p: F.size(F.filter("_all", lambda q: q == p)) / m)
    total = F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.ln(p))
    return df.withColumn(out, total / math.log(math.factorial(order))).drop("_pattern", "_all")


def _templates(x: np.ndarray, m: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, m)


def _near(t: np.ndarray, r: float) -> np.ndarray:
    return np.abs(t[:, None, :] - t[None, :, :]).max(axis=2) <= r


def approximate(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """Approximate entropy with tolerance r population deviations; a template matches itself."""
    if not x.std() > 0:
        return math.nan
    phi = [np.log(_near(_templates(x, k), r * x.std()).mean(axis=1)).mean() for k in (m, m + 1)]
    return phi[0] - phi[1]


def sample(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """Sample entropy: pairs of different templates, as many of either length; NaN without a match."""
    if not x.std() > 0:
        return math.nan
    count = []
    for k in (m, m + 1):
        t = _templates(x, k)[: len(x) - m]
        count.append(np.triu(_near(t, r * x.std()), 1).sum())
    return -math.log(count[1] / count[0]) if count[0] and count[1] else math.nan


def spectral(x: np.ndarray) -> float:
    """Entropy (bits) of the normalised periodogram of the centred values."""
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    power = power[1:] * np.where(np.arange(1, len(power)) == len(x) / 2, 1.0, 2.0)
    p = power[power > 0] / power.sum() if power.sum() > 0 else np.zeros(0)
    return float(-(p * np.log2(p)).sum()) if len(p) else math.nan


def _joint(*columns: np.ndarray) -> float:
    counts = np.array(list(Counter(zip(*columns)).values())) / len(columns[0])
    return float(-(counts * np.log2(counts)).sum())


def _binned(x: np.ndarray, bins: int) -> np.ndarray:
    low, high = x.min(), x.max()
    return np.full(len(x), bins // 2) if high == low else np.minimum(((x - low) / (high - low) * bins).astype(int), bins - 1)


def conditional(x: np.ndarray, bins: int = 10, lag: int = 1) -> float:
    """Entropy (bits) of a value given the one lag before."""
    b = _binned(x, bins)
    return _joint(b[lag:], b[:-lag]) - _joint(b[:-lag])


def transfer(x: np.ndarray, y: np.ndarray, bins: int = 5, lag: int = 1) -> float:
    """Bits that x's past adds to y's own past about y."""
    a, b = _binned(x, bins), _binned(y, bins)
    return max(0.0, _joint(b[lag:], b[:-lag]) - _joint(b[:-lag]) - _joint(b[lag:], b[:-lag], a[:-lag]) + _joint(b[:-lag], a[:-lag]))


def lempel_ziv(x: np.ndarray) -> float:
    """Phrases of the sequence above and below its median, times log2(n) / n."""
    s = "".join("1" if v > np.median(x) else "0" for v in x)
    seen, at, phrases = set(), 0, 0
    while at < len(s):
        size = 1
        while at + size <= len(s) and s[at : at + size] in seen:
            size += 1
        seen.add(s[at : at + size])
        at += size
        phrases += 1
    return phrases * math.log2(len(s)) / len(s)


def hurst(x: np.ndarray) -> float:
    """Slope of the log of the mean rescaled range against the log of the chunk length."""
    sizes, ranges = [], []
    for k in range(4, max(5, len(x) // 2)):
        t = x[: len(x) // k * k].reshape(-1, k)
        path = np.cumsum(t - t.mean(axis=1, keepdims=True), axis=1)
        sd = t.std(axis=1)
        if (sd > 0).any():
            sizes.append(math.log(k))
            ranges.append(math.log(((path.max(axis=1) - path.min(axis=1))[sd > 0] / sd[sd > 0]).mean()))
    return float(np.polyfit(sizes, ranges, 1)[0]) if len(sizes) > 1 else math.nan


def correlation_dimension(x: np.ndarray, most: int = 10, r: float | None = None) -> float:
    """Slope of the log correlation sum against the embedding dimension."""
    dims, sums = [], []
    for m in range(2, most + 1):
        t = _templates(x, m)
        c = np.triu(_near(t, r or x.std()), 1).sum() / max(1, len(t) * (len(t) - 1) / 2)
        if c > 0:
            dims.append(m)
            sums.append(math.log(c))
    return abs(float(np.polyfit(dims, sums, 1)[0])) if len(dims) > 1 else math.nan


def partial_autocorrelation(x: np.ndarray, k: int = 1) -> float:
    """By the Yule-Walker equations with unbiased covariances."""
    c = x - x.mean()
    r = np.array([c[: len(c) - i] @ c[i:] / (len(c) - i) for i in range(k + 1)])
    if not r[0] > 0:
        return math.nan
    return float(np.linalg.lstsq(np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)]), r[1:], rcond=None)[0][-1])


def dickey_fuller(x: np.ndarray, most: int | None = None) -> float:
    """Augmented Dickey-Fuller t-statistic with a constant; lags by the least AIC over a common sample."""
    most = int(np.ceil(12 * (len(x) / 100) ** 0.25)) if most is None else most
    most = min(most, len(x) // 2 - 3)
    d = np.diff(x)
    best = (math.inf, math.nan)
    for p in range(most + 1):
        y = d[most:]
        a = np.column_stack([x[most:-1], np.ones(len(y)), *[d[most - i : len(d) - i] for i in range(1, p + 1)]])
        b, *_ = np.linalg.lstsq(a, y, rcond=None)
        e = y - a @ b
        ssr = e @ e
        aic = len(y) * math.log(max(ssr, 1e-300) / len(y)) + 2 * a.shape[1]
        if aic < best[0]:
            cov = np.linalg.pinv(a.T @ a) * ssr / max(1, len(y) - a.shape[1])
            best = aic, float(b[0] / math.sqrt(max(cov[0, 0], 1e-300)))
    return best[1]


KERNELS = {"approximate": approximate, "sample": sample, "spectral": spectral, "conditional": conditional, "lempel_ziv": lempel_ziv, "hurst": hurst, "correlation_dimension": correlation_dimension, "pacf": partial_autocorrelation, "adf": dickey_fuller}


def over_windows(x: np.ndarray, n: int, f) -> np.ndarray:
    out = np.full(len(x), np.nan)
    for t in range(n - 1, len(x)):
        w = x[t - n + 1 : t + 1]
        if np.isfinite(w).all():
            out[t] = f(w)
    return out


def _spread(df: DataFrame, windows: dict[str, str], n: int) -> DataFrame:
    """df with the last n values of columns as arrays, null unless all n are there, its rows dealt out evenly: windows don't depend on each other, so a long series is no hot task."""
    w = last_rows(n)
    full = {name: F.when(F.count(x).over(w) == n, F.collect_list(F.col(x).cast("double")).over(w)) for name, x in windows.items()}
    return df.withColumns(full).repartition(*KEYS, "ts")


def with_complexity(df: DataFrame, x: str = "returns", n: int = 100, kernels: tuple[str, ...] | None = None) -> DataFrame:
    """KERNELS by name (all by default) over each last n values; null until there are n, and where a kernel is undefined."""
    kernels = tuple(KERNELS) if kernels is None else kernels

    @F.pandas_udf(", ".join(f"{k} double" for k in kernels))
    def measured(windows: pd.Series) -> pd.DataFrame:
        told = [[KERNELS[k](np.asarray(v, float)) for k in kernels] if v is not None else [math.nan] * len(kernels) for v in windows]
        return pd.DataFrame(told, columns=list(kernels), dtype=float)

    out = _spread(df, {"_w": x}, n).withColumn("_c", measured("_w"))
    return out.withColumns({k: finite(F.col("_c")[k]) for k in kernels}).drop("_w", "_c")


def with_transfer(df: DataFrame, x: str, y: str, n: int = 100, bins: int = 5, lag: int = 1, out: str = "transfer") -> DataFrame:
    """transfer() from x to y over each last n rows without a null in either; null until there are n."""

    @F.pandas_udf("double")
    def measured(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([transfer(np.asarray(v, float), np.asarray(w, float), bins, lag) if v is not None and w is not None else math.nan for v, w in zip(a, b)], dtype=float)

    spread = _spread(df, {"_wx": x, "_wy": y}, n)
    return spread.withColumn(out, finite(measured("_wx", "_wy"))).drop("_wx", "_wy")


def with_multiscale(df: DataFrame, x: str = "returns", n: int = 100, scales: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """Sample entropy of the series averaged over each scale, at every scale-th row and carried on from there."""

    def one(s: pd.DataFrame) -> dict[str, np.ndarray]:
        out = {}
        for k in scales:
            coarse = s[x].rolling(k).mean().iloc[k - 1 :: k]
            own = pd.Series(over_windows(coarse.to_numpy(float), max(8, n // k), sample), index=coarse.index)
            out[f"mse_{k}"] = own.reindex(s.index, method="ffill").to_numpy()
        return out

    return along(df, one, [f"mse_{k}" for k in scales])


def shapiro_wilk(x: np.ndarray) -> float:
    """The W statistic for 3 to 5000 values, with weights from expected normal order statistics and polynomial corrections of the outer ones."""
    n = len(x)
    if not 3 <= n <= 5000 or not x.std() > 0:
        return math.nan
    inverse = NormalDist().inv_cdf
    m = np.array([inverse((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, c = 1 / math.sqrt(n), m / math.sqrt(m @ m)
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u)  # fixed values
    a = c.copy()
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    elif n <= 5:
        a[1:-1] = m[1:-1] / math.sqrt((m @ m - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    else:
        next_ = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)  # fixed values
        a[2:-2] = m[2:-2] / math.sqrt((m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2))
        a[-1], a[0], a[-2], a[1] = last, -last, next_, -next_
    s = np.sort(x)
    return float(min(1.0, (a @ s) ** 2 / ((s - s.mean()) ** 2).sum()))


KERNELS["shapiro_wilk"] = shapiro_wilk
