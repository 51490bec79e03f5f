"""GARCH(1,1) by maximum likelihood for each series, and regimes by thresholds on its volatility; the switching form by slices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidegauge.functions.recursive import along, garch_path
from tidegauge.functions.windows import KEYS, last_rows, series

from . import regimes as G

FIELDS = ("mu", "omega", "alpha", "beta", "nu", "log_likelihood", "aic", "bic", "persistence", "ljung_box")


def simplex(f, x: np.ndarray, rounds: int = 400, step: float = 0.25) -> np.ndarray:
    """A minimum of f near x, by reflecting, stretching and shrinking a simplex."""
    points = [x, *[x + step * e for e in np.eye(len(x))]]
    points = sorted(((f(p), tuple(p)) for p in points))
    for _ in range(rounds):
        mid, (worst, last) = np.mean([p for _, p in points[:-1]], axis=0), points[-1]
        if points[-1][0] - points[0][0] < 1e-9:
            break
        at = lambda c: (lambda p: (f(p), tuple(p)))(mid + c * (mid - np.array(last)))
        new = at(1.0)
        if new[0] < points[0][0]:
            new = min(new, at(2.0))
        elif new[0] >= points[-2][0]:
            new = at(0.5) if new[0] < worst else at(-0.5)
        if new[0] < worst:
            points[-1] = new
        else:
            points = [points[0], *[(lambda p: (f(p), tuple(p)))((np.array(points[0][1]) + p) / 2) for _, p in points[1:]]]
        points.sort()
    return np.array(points[0][1])


def estimate(r: np.ndarray, distribution: str = "normal") -> dict[str, float]:
    """Parameters by maximum likelihood of returns (scaled to deviation 1 inside), normal or t."""
    scale = r.std() or 1.0
    z, t = r / scale, distribution == "t"
    if distribution not in ("normal", "t"):
        raise ValueError(f"unknown distribution {distribution!r}")

    def unpack(q: np.ndarray) -> tuple[float, float, float, float, float]:
        total = 0.9995 / (1 + math.exp(-q[2]))
        share = 1 / (1 + math.exp(-q[3]))
        return q[0], math.exp(q[1]), total * share, total * (1 - share), 2.05 + math.exp(q[4]) if t else math.inf

    def loss(q: np.ndarray) -> float:
        if not np.all(np.abs(q) < 30):
            return 1e12
        mu, omega, alpha, beta, nu = unpack(q)
        e = z - mu
        v = garch_path(e, omega, alpha, beta)
        if t:
            ll = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2)) - 0.5 * np.log(v) - (nu + 1) / 2 * np.log1p(e**2 / (v * (nu - 2)))
        else:
            ll = -0.5 * (math.log(2 * math.pi) + np.log(v) + e**2 / v)
        return float(-ll.sum())

    first = np.array([z.mean(), math.log(0.1), 2.5, -2.0, *([1.5] if t else [])])
    q = simplex(loss, first)
    mu, omega, alpha, beta, nu = unpack(q)
    ll, p, n = -loss(q) - len(r) * math.log(scale), 4 + t, len(r)
    e2 = (z - mu) ** 2 / garch_path(z - mu, omega, alpha, beta)
    c = e2 - e2.mean()
    rho = [(c[i:] @ c[:-i]) / max(c @ c, 1e-300) for i in range(1, min(11, n))]
    box = n * (n + 2) * sum(x * x / (n - i) for i, x in enumerate(rho, 1))
    return dict(zip(FIELDS, (mu * scale, omega * scale**2, alpha, beta, nu if t else math.nan, ll, 2 * p - 2 * ll, p * math.log(n) - 2 * ll, alpha + beta, box)))


def fitted(df: DataFrame, x: str = "returns", distribution: str = "normal", least: int = 30, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, n and FIELDS of each series with least returns or more."""
    schema = StructType([*[df.schema[c] for c in keys], StructField("n", LongType()), *[StructField(c, DoubleType()) for c in FIELDS]])

    def one(own: pd.DataFrame) -> pd.DataFrame:
        r = own.sort_values("ts")[x].dropna().to_numpy(float)
        if len(r) < least:
            return pd.DataFrame(columns=schema.names)
        return pd.DataFrame([{c: own[c].iloc[0] for c in keys} | {"n": len(r)} | estimate(r, distribution)])[schema.names]

    return df.select(*keys, "ts", x).groupBy(*keys).applyInPandas(one, schema)


def with_volatility(df: DataFrame, x: str = "returns", distribution: str = "normal", out: str = "garch_vol") -> DataFrame:
    """df with the conditional deviation by each series' own estimate."""

    def one(s: pd.DataFrame) -> dict[str, np.ndarray]:
        r, v = s[x].to_numpy(float), np.full(len(s), np.nan)
        known = np.isfinite(r)
        if known.sum() >= 30:
            m = estimate(r[known], distribution)
            v[known] = np.sqrt(garch_path(r[known] - m["mu"], m["omega"], m["alpha"], m["beta"]))
        return {out: v}

    return along(df, one, [out])


def forecast(parameters: DataFrame, last: DataFrame, horizon: int = 10) -> DataFrame:
    """keys, step, volatility: from last (keys, variance, residual), the expected path back to the long-run variance."""
    both = last.join(F.broadcast(parameters), list(KEYS)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    first = F.col("omega") + F.col("alpha") * F.pow("residual", 2) + F.col("beta") * F.col("variance")
    long = F.col("omega") / (1 - F.col("persistence"))
    return both.select(*KEYS, "step", F.sqrt(long + F.pow("persistence", F.col("step") - 1) * (first - long)).alias("volatility"))


def regimes(df: DataFrame, k: int = 3, x: str = "returns", method: str = "quantile", out: str = G.LABEL) -> DataFrame:
    """df with garch_vol, labels by how many thresholds it exceeds (equal quantiles, middles of k-means centres, or natural breaks) and {out}_p, most of it on the label and some on its neighbours."""
    df = with_volatility(df, x)
    if method == "quantile":
        return G.quantile_labels(df, "garch_vol", k, out).withColumn(f"{out}_p", G.neighbour_probabilities(out, k))

    def one(s: pd.DataFrame) -> dict[str, np.ndarray]:
        v = s["garch_vol"].to_numpy(float)
        known = np.isfinite(v)
        label = np.full(len(v), np.nan)
        if known.sum() >= k:
            label[known] = (v[known][:, None] > np.array(breaks(v[known], k, method))[None]).sum(axis=1)
        return {out: label}

    return along(df, one, [out]).withColumn(out, F.col(out).cast("int")).withColumn(f"{out}_p", G.neighbour_probabilities(out, k))


def breaks(v: np.ndarray, k: int, method: str) -> list[float]:
    """k - 1 thresholds in one dimension: kmeans (middles of centres) or jenks (least squares within classes, exact, over all values)."""
    if method == "kmeans":
        c = np.quantile(v, (np.arange(k) + 0.5) / k)
        for _ in range(100):
            edge = (c[1:] + c[:-1]) / 2
            label = np.searchsorted(edge, v)
            c = np.array([v[label == j].mean() if (label == j).any() else c[j] for j in range(k)])
        return list((c[1:] + c[:-1]) / 2)
    if method != "jenks":
        raise ValueError(f"unknown method {method!r}")
    s = np.sort(v)
    n, one, two = len(s), np.r_[0, np.cumsum(s - s.mean())], np.r_[0, np.cumsum((s - s.mean()) ** 2)]

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Squares within s[i:j] for each pair of places; infinite for none."""
        size = np.maximum(j - i, 1)
        return np.where(j > i, two[j] - two[i] - (one[j] - one[i]) ** 2 / size, math.inf)

    best, came = cost(np.zeros(n + 1, int), np.arange(n + 1)), []
    for _ in range(k - 1):
        # The best last cut never moves back as the end moves on, so that each level of a halving has few places to look at.
        new, cut = np.full(n + 1, math.inf), np.zeros(n + 1, int)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            at = np.arange(first, min(last, mid - 1) + 1)
            value = best[at] + cost(at, np.full(len(at), mid))
            k_ = int(value.argmin())
            new[mid], cut[mid] = value[k_], at[k_]
            todo += [(lo, mid - 1, first, int(at[k_])), (mid + 1, hi, int(at[k_]), last)]
        best, came = new, [*came, cut]
    at, out = n, []
    for c in reversed(came):
        at = int(c[at])
        out.append(float(s[max(at - 1, 0)]))
    return out[::-1]


def switching(df: DataFrame, x: str = "returns", k: int = 3, n: int = 20, out: str = G.LABEL) -> DataFrame:
    """Labels by which slice's level the rolling deviation is nearest to, smoothed by a median of five."""
    levels = G.slice_parameters(df, x, k).withColumn("level", F.sqrt("omega") / F.lit(math.sqrt(0.1)))
    df = df.withColumn("_sd", F.stddev(x).over(last_rows(n)))
    df = G.nearest_labels(df, "_sd", levels, "level", k, out="_raw")
    return df.withColumn(out, F.percentile("_raw", F.lit(0.5)).over(series().rowsBetween(-2, 2)).cast("int")).drop("_sd", "_raw")

