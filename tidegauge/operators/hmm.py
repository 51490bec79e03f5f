"""Gaussian hidden Markov and mixture models, fitted to each series by one grouped pandas function; parameters are rows.

A series' length is bounded by time (see functions.windows), so a fit holds one series, and series are spread over tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tidegauge.functions.windows import KEYS

COVARIANCES = ("full", "diag", "spherical", "tied")
_VECTOR, _MATRIX = ArrayType(DoubleType()), ArrayType(ArrayType(DoubleType()))
PARAMETERS = [("k", IntegerType()), ("n", LongType()), ("log_likelihood", DoubleType()), ("aic", DoubleType()), ("bic", DoubleType()), ("start", _VECTOR), ("transition", _MATRIX), ("means", _MATRIX), ("covariances", ArrayType(_MATRIX)), ("center", _VECTOR), ("scale", _VECTOR)]


def log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """n x k log densities."""
    out = []
    for m, c in zip(means, covs):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out.append(-0.5 * (z**2).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi))
    return np.column_stack(out)


def mahalanobis(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    return np.column_stack([np.sqrt((np.linalg.solve(np.linalg.cholesky(c), (x - m).T) ** 2).sum(axis=0)) for m, c in zip(means, covs)])


def _sum_exp(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def covariances(x: np.ndarray, weight: np.ndarray, means: np.ndarray, kind: str, floor: float = 1e-3) -> np.ndarray:
    d = x.shape[1]
    full = np.array([((x - m).T * w) @ (x - m) / max(w.sum(), 1e-10) for m, w in zip(means, weight.T)])
    if kind == "tied":
        full = np.repeat((full * (weight.sum(axis=0) / weight.sum())[:, None, None]).sum(axis=0)[None], len(means), axis=0)
    elif kind == "diag":
        full = full * np.eye(d)
    elif kind == "spherical":
        full = np.trace(full, axis1=1, axis2=2)[:, None, None] / d * np.eye(d)
    elif kind != "full":
        raise ValueError(f"unknown covariance {kind!r}")
    return full + floor * np.eye(d)


def n_parameters(k: int, d: int, kind: str, markov: bool) -> int:
    cov = {"full": k * d * (d + 1) // 2, "diag": k * d, "spherical": k, "tied": d * (d + 1) // 2}[kind]
    return k - 1 + (k * (k - 1) if markov else 0) + k * d + cov


def clusters(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 50) -> np.ndarray:
    """Labels of Lloyd's algorithm from well spread first centres."""
    centres = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centres)
    for _ in range(rounds):
        label = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return label


def _blocks(steps: np.ndarray, neutral: np.ndarray) -> np.ndarray:
    """n x k x k steps as about sqrt(n) blocks of as many, the last filled up with neutral steps: what is done to one block is done to all at once."""
    n, size = len(steps), max(1, math.isqrt(len(steps)))
    more = -n % size
    return np.concatenate([steps, np.repeat(neutral[None], more, axis=0)]).reshape(-1, size, *neutral.shape)


def forward_backward(log_b: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, posteriors (n x k) and expected transitions (k x k).

    Steps are matrices, and their products over blocks say how states before a block lead to those after it; with these
    known, all blocks are run through together.
    """
    n, k = log_b.shape
    peak = log_b.max(axis=1, keepdims=True)
    b = np.exp(log_b - peak)
    steps = trans[None] * b[:, None]
    steps[0] = start * b[0]  # from whatever came before
    m = _blocks(steps, np.eye(k))
    count, size = m.shape[:2]
    product = m[:, 0]
    for t in range(1, size):
        product = product @ m[:, t]
        product = product / np.maximum(product.max(axis=(1, 2), keepdims=True), 1e-300)
    before, after = np.empty((count, k)), np.empty((count, k))
    now, back = np.full(k, 1 / k), np.ones(k)
    for j in range(count):
        before[j] = now
        now = now @ product[j]
        now = now / max(now.sum(), 1e-300)
    for j in range(count - 1, -1, -1):
        after[j] = back
        back = product[j] @ back
        back = back / max(back.max(), 1e-300)
    ahead, behind, scale = np.empty((count, size, k)), np.empty((count, size, k)), np.empty((count, size))
    now, back = before, after
    for t in range(size):
        now = (now[:, None] @ m[:, t])[:, 0]
        scale[:, t] = np.maximum(now.sum(axis=1), 1e-300)
        now = now / scale[:, t, None]
        ahead[:, t] = now
    for t in range(size - 1, -1, -1):
        behind[:, t] = back
        back = (m[:, t] @ back[..., None])[..., 0]
        back = back / np.maximum(back.max(axis=1, keepdims=True), 1e-300)
    a, z = ahead.reshape(-1, k)[:n], behind.reshape(-1, k)[:n]
    post = a * z
    both = a[:-1, :, None] * steps[1:] * z[1:, None]
    expected = (both / np.maximum(both.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)
    return float(np.log(scale.reshape(-1)[:n]).sum() + peak.sum()), post / np.maximum(post.sum(axis=1, keepdims=True), 1e-300), expected


def viterbi(log_b: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, float]:
    """The likeliest path and its log probability: blocks in (max, +) arithmetic, then the best way through each between its known ends."""
    n, k = log_b.shape
    steps = np.log(np.maximum(trans, 1e-300))[None] + log_b[:, None]
    steps[0] = np.log(np.maximum(start, 1e-300)) + log_b[0]
    w = _blocks(steps, np.where(np.eye(k) > 0, 0.0, -math.inf))
    count, size = w.shape[:2]
    best = w[:, 0]
    for t in range(1, size):
        best = (best[:, :, :, None] + w[:, t][:, None]).max(axis=2)
    score, came = np.zeros(k), []
    for j in range(count):
        both = score[:, None] + best[j]
        came.append(both.argmax(axis=0))
        score = both.max(axis=0)
    ends = [int(score.argmax())]
    for c in reversed(came):
        ends.append(int(c[ends[-1]]))
    ends = np.array(ends[::-1])
    now = np.full((count, k), -math.inf)
    now[np.arange(count), ends[:-1]] = 0.0
    back = np.empty((count, size, k), np.int64)
    for t in range(size):
        both = now[:, :, None] + w[:, t]
        back[:, t] = both.argmax(axis=1)
        now = both.max(axis=1)
    path, at = np.empty((count, size), np.int64), ends[1:]
    for t in range(size - 1, -1, -1):
        path[:, t] = at
        at = back[np.arange(count), t, at]
    return path.reshape(-1)[:n], float(score.max())


def _by_quantiles(v: np.ndarray, k: int) -> np.ndarray:
    return np.digitize(v, np.quantile(v, np.arange(1, k) / k))


def _deviation(v: np.ndarray, n: int = 20) -> np.ndarray:
    """The deviation of the last n values, or of those there are."""
    return pd.Series(v).rolling(n, min_periods=1).std(ddof=0).to_numpy()


def fit(x: np.ndarray, k: int, kind: str = "full", starts: int = 5, rounds: int = 60, seed: int = 42, markov: bool = True, select: str = "score") -> dict:
    """The best of several starts, by clusters, quantiles and deviations in turn, by log likelihood (score), aic or bic: states in order of the mean of the first feature."""
    d = x.shape[1]
    center, spread = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = (x - center) / spread
    best = None
    for s in range(starts):
        rng = np.random.default_rng(seed + s)
        label = clusters(z, k, rng) if s % 3 == 0 else _by_quantiles(z[:, 0] if s % 3 == 1 else _deviation(z[:, 0]), k)
        post = np.eye(k)[label] * 0.9 + 0.1 / k
        trans, start, last = (np.full((k, k), 0.1 / k) + 0.9 * np.eye(k) if markov else None), np.full(k, 1.0 / k), -math.inf
        for _ in range(rounds):
            weight = post.sum(axis=0)
            means = post.T @ z / weight[:, None]
            covs = covariances(z, post, means, kind)
            log_b = log_density(z, means, covs)
            if markov:
                ll, post, moved = forward_backward(log_b, start, trans)
                start = post[0] / post[0].sum()
                trans = (moved + 1e-6) / (moved + 1e-6).sum(axis=1, keepdims=True)
            else:
                start = weight / weight.sum()
                joint = log_b + np.log(start)
                total = _sum_exp(joint, 1)
                ll, post = float(total.sum()), np.exp(joint - total[:, None])
            if abs(ll - last) < 1e-4 * max(1.0, abs(ll)):
                break
            last = ll
        p = n_parameters(k, d, kind, markov)
        order = np.argsort(means[:, 0], kind="stable")
        made = {"k": k, "n": len(x), "log_likelihood": ll, "aic": 2 * p - 2 * ll, "bic": p * math.log(len(x)) - 2 * ll, "start": start[order], "transition": trans[np.ix_(order, order)] if markov else np.repeat(start[order][None], k, axis=0), "means": means[order], "covariances": covs[order], "center": center, "scale": spread}
        better = {"score": lambda m: -m["log_likelihood"], "aic": lambda m: m["aic"], "bic": lambda m: m["bic"]}[select]
        if best is None or better(made) < better(best):
            best = made
    return best


def _lists(v):
    return v.tolist() if isinstance(v, np.ndarray) else v


def fitted(df: DataFrame, features: list[str], k: int = 3, kind: str = "full", starts: int = 5, markov: bool = True, ks: tuple[int, ...] = (), criterion: str = "bic", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys and PARAMETERS of each series; with ks, of the number of states that criterion finds best. Rows with a null are left out; a series with under 10 rows a state gives none."""
    schema = StructType([*[df.schema[c] for c in keys], *[StructField(n, t) for n, t in PARAMETERS]])

    def one(own: pd.DataFrame) -> pd.DataFrame:
        x = own.sort_values("ts")[features].dropna().to_numpy(float)
        tried = [fit(x, j, kind, starts, markov=markov) for j in (ks or (k,)) if len(x) >= 10 * j]
        if not tried:
            return pd.DataFrame(columns=schema.names)
        best = min(tried, key=lambda m: m[criterion])
        return pd.DataFrame([{c: own[c].iloc[0] for c in keys} | {n: _lists(v) for n, v in best.items()}])[schema.names]

    return df.select(*keys, "ts", *features).groupBy(*keys).applyInPandas(one, schema)


def predicted(df: DataFrame, parameters: DataFrame, features: list[str], markov: bool = True, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """df's rows without nulls, with regime (Viterbi path or likeliest component), p (posteriors) and log_density."""
    schema = StructType([*df.schema, StructField("regime", IntegerType()), StructField("p", _VECTOR), StructField("log_density", DoubleType())])

    def one(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        own = own.dropna(subset=features).sort_values("ts").reset_index(drop=True)
        if not len(own) or not len(model):
            return pd.DataFrame(columns=schema.names)
        m = model.iloc[0]
        array = lambda v: np.array([[list(r) if hasattr(r, "__len__") else r for r in a] if hasattr(a, "__len__") else a for a in v], float)
        z = (own[features].to_numpy(float) - array(m["center"])) / array(m["scale"])
        log_b = log_density(z, array(m["means"]), array(m["covariances"]))
        if markov:
            start, trans = array(m["start"]), array(m["transition"])
            path, _ = viterbi(log_b, start, trans)
            _, post, _ = forward_backward(log_b, start, trans)
        else:
            joint = log_b + np.log(array(m["start"]))
            post = np.exp(joint - _sum_exp(joint, 1)[:, None])
            path = post.argmax(axis=1)
        return own.assign(regime=path.astype("int32"), p=list(post), log_density=_sum_exp(log_b + np.log(np.maximum(array(m["start"]), 1e-300)), 1))[schema.names]

    return df.groupBy(*keys).cogroup(parameters.groupBy(*keys)).applyInPandas(one, schema)


def sampled(parameters: DataFrame, n: int = 100, seed: int = 42, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """n steps (keys, step, regime, x) drawn from each series' model."""
    schema = StructType([*[parameters.schema[c] for c in keys], StructField("step", IntegerType()), StructField("regime", IntegerType()), StructField("x", _VECTOR)])

    def one(model: pd.DataFrame) -> pd.DataFrame:
        m, rng = model.iloc[0], np.random.default_rng(seed)
        state, rows = rng.choice(m["k"], p=np.array(m["start"]) / sum(m["start"])), []
        for t in range(n):
            cov = np.array([list(r) for r in m["covariances"][state]])
            x = rng.multivariate_normal(np.array(m["means"][state], float), cov) * np.array(m["scale"]) + np.array(m["center"])
            rows.append((*[m[c] for c in keys], t, int(state), x.tolist()))
            p = np.array(m["transition"][state], float)
            state = rng.choice(m["k"], p=p / p.sum())
        return pd.DataFrame(rows, columns=schema.names)

    return parameters.groupBy(*keys).applyInPandas(one, schema)
