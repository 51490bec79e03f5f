"""Selection of features: by variance, correlation, scores against a target, forests, and votes of several selections."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.windows import corr, div


def variances(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, variance (population, nulls as 0); one pass."""
    row = F.array(*[F.struct(F.lit(c).alias("feature"), F.var_pop(F.coalesce(F.col(c), F.lit(0.0))).alias("variance")) for c in features])
    return df.agg(row.alias("a")).select(F.explode("a").alias("r")).select("r.*")


def by_variance(df: DataFrame, features: list[str], threshold: float = 0.01) -> list[str]:
    kept = {r.feature for r in variances(df, features).where(F.col("variance") > threshold).collect()}
    return [c for c in features if c in kept]


def top_variance(df: DataFrame, features: list[str], k: int) -> list[str]:
    return [r.feature for r in variances(df, features).orderBy(F.desc("variance"), "feature").limit(k).collect()]


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """a, b, corr for each pair, a before b; all in one pass."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), corr(a, b).alias("corr")) for a, b in pairs])
    return df.agg(row.alias("x")).select(F.explode("x").alias("r")).select("r.*")


def uncorrelated(df: DataFrame, features: list[str], threshold: float = 0.95) -> list[str]:
    """Features without those that correlate more than threshold with an earlier one."""
    gone = {r.b for r in correlations(df, features).where(F.abs("corr") > threshold).collect()}
    return [c for c in features if c not in gone]


def anova(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, score: the F statistic of the target's groups, from one grouped aggregation; null without spread inside groups."""
    per = df.where(F.col(target).isNotNull()).groupBy(target).agg(*[x for c in features for x in (F.count(c).alias(f"n_{c}"), F.sum(c).alias(f"s_{c}"), F.var_pop(c).alias(f"v_{c}"))])

    def score(c: str):
        n, s, v = F.col(f"n_{c}"), F.col(f"s_{c}"), F.col(f"v_{c}")
        total, groups = F.sum(n), F.count_if(n > 0)
        between = F.sum(F.when(n > 0, s * s / n)) - F.sum(s) * F.sum(s) / total
        return F.struct(F.lit(c).alias("feature"), div(between / (groups - 1), F.sum(n * v) / (total - groups)).alias("score"))

    return per.agg(F.array(*map(score, features)).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def regression_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, score: the F statistic of a straight line through feature and target."""

    def score(c: str):
        r2, n = F.pow(corr(c, target), 2), F.count(F.when(F.col(c).isNotNull() & F.col(target).isNotNull(), 1))
        return F.struct(F.lit(c).alias("feature"), div(r2 * (n - 2), 1 - r2).alias("score"))

    return df.agg(F.array(*map(score, features)).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """feature, score: mutual information (nats) of a label with equal bins of each feature."""
    edges = df.agg(*[x for c in features for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
    binned = df.crossJoin(F.broadcast(edges))
    number = lambda c: F.least(F.floor(F.coalesce(div(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0)) * bins), F.lit(bins - 1))
    long = binned.select(F.col(target).alias("t"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), number(c).alias("b")) for c in features])).alias("x")).select("t", "x.*")
    n = long.groupBy("feature", "b", "t").agg(F.count(F.lit(1)).alias("n"))
    nb, nt, total = (n.groupBy("feature", *by).agg(F.sum("n").alias(name)) for by, name in ((("b",), "nb"), (("t",), "nt"), ((), "total")))
    joined = n.join(F.broadcast(nb), ["feature", "b"]).join(F.broadcast(nt), ["feature", "t"]).join(F.broadcast(total), "feature")
    return joined.groupBy("feature").agg(F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("nb") * F.col("nt")))).alias("score"))


SCORES = {"f_classif": anova, "f_regression": regression_scores, "mutual_info": mutual_information}


def k_best(df: DataFrame, features: list[str], target: str, k: int = 10, score: str = "f_classif") -> list[str]:
    return [r.feature for r in SCORES[score](df, features, target).orderBy(F.desc_nulls_last("score"), "feature").limit(k).collect()]


def importances(df: DataFrame, features: list[str], target: str, trees: int = 100, seed: int = 42, classify: bool = True) -> dict[str, float]:
    """A forest's importances; nulls by the mean."""
    mean = df.agg(*[F.avg(c).alias(c) for c in features]).first().asDict()
    data = df.where(F.col(target).isNotNull()).na.fill({c: v for c, v in mean.items() if v is not None})
    data = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(data).select("_x", F.col(target).cast("double").alias("_y"))
    forest = (RandomForestClassifier if classify else RandomForestRegressor)(featuresCol="_x", labelCol="_y", numTrees=trees, seed=seed)
    return dict(zip(features, map(float, forest.fit(data).featureImportances.toArray())))


def by_importance(found: dict[str, float], top: int | None = None, threshold: float | None = None) -> list[str]:
    """The top ones, those of threshold or more, or those of the mean or more."""
    ordered = sorted(found, key=lambda c: (-found[c], c))
    if top is not None:
        return ordered[:top]
    least = sum(found.values()) / len(found) if threshold is None else threshold
    return [c for c in ordered if found[c] >= least]


def recursive_elimination(df: DataFrame, features: list[str], target: str, n: int = 10, step: int = 1, trees: int = 50) -> list[str]:
    """Drops the least important features, step at a time, until n are left."""
    left = list(features)
    while len(left) > n:
        found = importances(df, left, target, trees)
        gone = set(sorted(left, key=lambda c: (found[c], c))[: min(step, len(left) - n)])
        left = [c for c in left if c not in gone]
    return left


def voted(selections: list[list[str]], voting: str = "union") -> list[str]:
    """union, intersection, or majority (more than half) of selections, in order of first mention."""
    names = list(dict.fromkeys(c for s in selections for c in s))
    least = {"union": 1, "intersection": len(selections), "majority": len(selections) // 2 + 1}[voting]
    return [c for c in names if sum(c in s for s in selections) >= least]
