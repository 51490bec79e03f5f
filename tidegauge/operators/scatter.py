"""Scatter of components, Mahalanobis distances as expressions, and the search of ensemble weights over vote patterns."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import regimes as G
from .estimator import solved

COVARIANCES = ("full", "tied", "diag", "spherical")


def moments(df: DataFrame, features: list[str], label: str = G.LABEL) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """(rows, means, population covariances) of each component, by one aggregation; rows with a null have no part."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1)]
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(features)] + [F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs]
    out = {}
    for r in df.na.drop(subset=[label, *features]).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *aggs).collect():  # a row a component
        cov = np.zeros((len(features),) * 2)
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        out[r[label]] = (r.n, np.array([r[f"m{i}"] for i in range(len(features))]), cov)
    return out


def shaped(found: dict[int, tuple[int, np.ndarray, np.ndarray]], kind: str = "full") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance of each component: full, tied (the mean of all by rows), diag, or spherical (the mean variance)."""
    if kind not in COVARIANCES:
        raise ValueError(f"unknown covariance {kind!r}")
    n = sum(v[0] for v in found.values())
    tied = sum(v[0] * v[2] for v in found.values()) / max(n, 1)
    of = {"full": lambda c: c, "tied": lambda c: tied, "diag": lambda c: np.diag(np.diag(c)), "spherical": lambda c: np.eye(len(c)) * np.trace(c) / max(1, len(c))}[kind]
    return {k: (m, of(c)) for k, (_, m, c) in found.items()}


def with_mahalanobis(df: DataFrame, features: list[str], label: str = G.LABEL, kind: str = "full", out: str = "mahalanobis", ridge: float = 1e-12) -> DataFrame:
    """df with each row's distance from its own component, and from the nearest one ({out}_nearest); null where a feature or the label is. ridge, a share of the mean variance, is added to variances, so that components without spread have a distance."""
    x, found = F.array(*features), shaped(moments(df, features, label), kind)
    squares = {k: solved(x, m, c + np.eye(len(m)) * (ridge * np.trace(c) / len(m) + 1e-300))[0] for k, (m, c) in sorted(found.items())}
    known = reduce(lambda a, c: a & F.col(c).isNotNull(), features, F.lit(True))
    own = reduce(lambda e, k: F.when(F.col(label) == k, squares[k]).otherwise(e), squares, F.lit(None).cast("double"))
    near = F.least(*squares.values(), F.lit(None).cast("double")) if squares else F.lit(None).cast("double")
    return df.withColumns({out: F.when(known, F.sqrt(own)), f"{out}_nearest": F.when(known, F.sqrt(near))})


def outliers(df: DataFrame, share: float = 0.05, by: str = "mahalanobis_nearest") -> DataFrame:
    """df with outlier: whether the distance is beyond the quantile that leaves that share of rows."""
    cut = df.agg(F.percentile(by, F.lit(1 - share))).first()[0]
    return df.withColumn("outlier", F.coalesce(F.col(by) > F.lit(cut), F.lit(False)))


def simplex(members: int, steps: int) -> list[list[float]]:
    """All weights of members in steps of 1 / steps that sum to 1."""
    return [[v / steps for v in (*c, steps - sum(c))] for c in product(range(steps + 1), repeat=members - 1) if sum(c) <= steps]


def weight_scores(df: DataFrame, votes: str, target: str, k: int, steps: int = 10) -> DataFrame:
    """weights (array) and accuracy of every choice of weights for the members of an array of votes; the label is the class of greatest weight, of several the least.

    Choices meet distinct patterns of votes and target, of which there are k^(members + 1) at most, not rows.
    """
    patterns = df.where(F.col(target).isNotNull()).groupBy(votes, target).agg(F.count(F.lit(1)).alias("_n"))
    members = patterns.agg(F.max(F.size(votes))).first()[0]
    if members is None:
        raise ValueError("no row has a target")
    choices = F.array(*[F.array(*map(F.lit, w)) for w in simplex(members, steps)])
    each = patterns.withColumn("weights", F.explode(choices))
    total = lambda c: F.aggregate(F.zip_with(votes, "weights", lambda v, w: F.when(v == c, w).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, w: s + w)
    mass = F.array(*[F.round(total(c), 9) for c in range(k)])
    label = F.array_position(mass, F.array_max(mass)) - 1
    return each.groupBy("weights").agg((F.sum(F.when(label == F.col(target), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("accuracy"))


def best_weights(df: DataFrame, votes: str, target: str, k: int, steps: int = 10) -> list[float]:
    """The weights of greatest accuracy; of several those nearest to equal ones."""
    scores = weight_scores(df, votes, target, k, steps)
    spread = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w * w)
    return list(scores.orderBy(F.desc("accuracy"), F.round(spread, 9), "weights").first().weights)
