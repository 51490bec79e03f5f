"""Regimes by clustering and by classifiers of spark.ml, alone and in ensembles. All fits are distributed; what comes to the driver are models."""

from __future__ import annotations

import json
import math
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, LogisticRegressionModel, OneVsRest, OneVsRestModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.session import settled

from . import clean, metrics
from . import regimes as G

X, Y = "_x", "_y"
#: The share of rows, earliest first, that a calibrated machine's first fit learns from; it is calibrated by the rest.
CALIBRATE_FROM = 0.8


def assembled(df: DataFrame, features: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """df without rows that have a null, with the vector _x of features by mean and population deviation; and those."""
    df = df.na.drop(subset=features)
    fitted = clean.scaler(df, features)
    scaled = [((F.col(c) - F.lit(m)) / F.lit(s or 1.0)) for c, (m, s) in fitted.items()]
    return df.withColumn(X, array_to_vector(F.array(*scaled))), fitted


def clustered(df: DataFrame, features: list[str], k: int = 3, seed: int = 42, out: str = G.LABEL) -> DataFrame:
    """k-means labels in order of the centres' first feature."""
    data, _ = assembled(df, features)
    model = KMeans(k=k, seed=seed, featuresCol=X, predictionCol="_c").fit(data)
    return _in_order(model.transform(data), "_c", [float(c[0]) for c in model.clusterCenters()], out).drop(X)


def mixture(df: DataFrame, features: list[str], k: int = 3, seed: int = 42, out: str = G.LABEL, p: str = "p") -> DataFrame:
    """Gaussian mixture (full covariances): labels in order of the means' first feature, with their probabilities."""
    data, _ = assembled(df, features)
    model = GaussianMixture(k=k, seed=seed, featuresCol=X, predictionCol="_c", probabilityCol="_p").fit(data)
    first = [float(r.mean[0]) for r in model.gaussiansDF.collect()]
    order = [int(i) for i in np.argsort(first, kind="stable")]
    done = _in_order(model.transform(data).withColumn("_a", vector_to_array("_p")), "_c", first, out)
    return done.withColumn(p, G.reordered_probabilities("_a", order)).drop(X, "_a", "_p")


def _in_order(df: DataFrame, label: str, first: list[float], out: str) -> DataFrame:
    place = {int(c): i for i, c in enumerate(np.argsort(first, kind="stable"))}
    return df.withColumn(out, F.element_at(F.create_map(*[F.lit(v) for kv in place.items() for v in kv]), F.col(label))).drop(label)


def selected_mixture(df: DataFrame, features: list[str], ks: tuple[int, ...] = (2, 3, 4, 5), seed: int = 42) -> list[tuple[int, float, float]]:
    """(k, aic, bic) of each number of components."""
    data, _ = assembled(df, features)
    data = data.select(X).persist()
    n, d, out = data.count(), len(features), []
    for k in ks:
        ll = GaussianMixture(k=k, seed=seed, featuresCol=X).fit(data).summary.logLikelihood
        p = k - 1 + k * d + k * d * (d + 1) // 2
        out.append((k, 2 * p - 2 * ll, p * math.log(n) - 2 * ll))
    data.unpersist()
    return out


def fourier(n: int, d: int, gamma: float | None = None, seed: int = 42) -> Column:
    """An array of n cosines of random directions of _x: inner products of it are close to an RBF kernel's values."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, math.sqrt(2 * (gamma or 1 / d)), (n, d)), rng.uniform(0, 2 * math.pi, n)
    x = vector_to_array(X)
    term = lambda row, off: F.cos(reduce(lambda s, i: s + F.get(x, i) * F.lit(float(row[i])), range(d), F.lit(float(off)))) * math.sqrt(2 / n)
    return F.array(*[term(w[i], b[i]) for i in range(n)])


def classifier(name: str, seed: int = 42, **options):
    """random_forest, boosted, svm_linear, svm_rbf or logistic, over _x and _y."""
    both = {"featuresCol": X, "labelCol": Y}
    if name == "random_forest":
        return RandomForestClassifier(**both, seed=seed, **({"numTrees": 50} | options))
    if name == "boosted":
        return OneVsRest(classifier=GBTClassifier(**both, seed=seed, **({"maxIter": 10, "maxDepth": 3} | options)), parallelism=4, **both)
    if name in ("svm_linear", "svm_rbf"):
        return OneVsRest(classifier=LinearSVC(**both, **({"maxIter": 10, "regParam": 0.01} | options)), parallelism=4, **both)
    if name == "logistic":
        return LogisticRegression(**both, **options)
    raise ValueError(f"unknown classifier {name!r}")


CLASSIFIERS = ("random_forest", "boosted", "svm_linear", "svm_rbf", "logistic")


def model_errors(k: int = 3, seed: int | None = 42, covariance: str = "full", features: list[str] | None = None, rows: int | None = None) -> list[str]:
    """What is wrong with the parameters of a regime model: k is 2 to 10, the seed a whole number from 0 on, the covariance one of four, features are distinct names, rows at least ten a regime."""
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    tests = (
        (whole(k) and 2 <= k <= 10, "k must be a whole number from 2 to 10"),
        (seed is None or whole(seed) and seed >= 0, "seed must be a whole number from 0 on"),
        (covariance in ("full", "tied", "diag", "spherical"), "covariance must be full, tied, diag or spherical"),
        (features is None or len(features) == len(set(features)) > 0, "features must be distinct names"),
        (rows is None or not whole(k) or rows >= 10 * k, "there must be ten rows for each regime"),
    )
    return [told for sound, told in tests if not sound]


class Detector:
    """A classifier with its scaling: fit() and transform(), on k-means labels where no target is given.

    With calibrated, a logistic regression over the margins of a support vector machine gives it probabilities.
    """

    def __init__(self, name: str, features: list[str], k: int = 3, seed: int = 42, calibrated: bool = False, **options):
        self.name, self.features, self.k, self.seed, self.calibrated, self.options = name, features, k, seed, calibrated, options
        if wrong := model_errors(k, seed, features=features):
            raise ValueError("; ".join(wrong))

    def params(self) -> dict:
        return {"name": self.name, "features": list(self.features), "k": self.k, "seed": self.seed, "calibrated": self.calibrated} | self.options

    def copy(self, **changes) -> Detector:
        """An unfitted detector with the same parameters, but for changes."""
        return Detector(**(self.params() | changes))

    def _vector(self, df: DataFrame) -> DataFrame:
        scaled = [((F.col(c) - F.lit(m)) / F.lit(s or 1.0)) for c, (m, s) in self.scaler.items()]
        df = df.na.drop(subset=self.features).withColumn(X, array_to_vector(F.array(*scaled)))
        return df.withColumn(X, array_to_vector(fourier(100, len(self.features), seed=self.seed))) if self.name == "svm_rbf" else df

    def fit(self, df: DataFrame, target: str | None = None) -> Detector:
        df = df.na.drop(subset=self.features)
        if target is None:
            df, target = clustered(df, self.features, self.k, self.seed, "_target"), "_target"
        self.scaler = clean.scaler(df, self.features)
        data = self._vector(df).select(X, F.col(target).cast("double").alias(Y)).where(F.col(Y).isNotNull())
        self.model = classifier(self.name, self.seed, **self.options).fit(data)
        if self.calibrated and self.name.startswith("svm"):
            told = self._told(df, target, data)
            self.platt = LogisticRegression(featuresCol=X, labelCol=Y, regParam=0.01, maxIter=20).fit(told)
        return self

    def _told(self, df: DataFrame, target: str, data: DataFrame) -> DataFrame:
        """Margins to calibrate by: those that a machine which learned from the first CALIBRATE_FROM of time gives to the rest.

        Where rows have no ts, or either part lacks a class, those of the learned rows themselves.
        """
        if "ts" in df.columns:
            (cut,) = _cuts(df, [CALIBRATE_FROM])
            both = self._vector(df).select(X, F.col(target).cast("double").alias(Y), (_micros("ts") < cut).alias("early")).where(F.col(Y).isNotNull())
            all_, early, late = both.agg(F.count_distinct(Y), F.count_distinct(F.when(F.col("early"), F.col(Y))), F.count_distinct(F.when(~F.col("early"), F.col(Y)))).first()
            if all_ == early == late:
                first = classifier(self.name, self.seed, **self.options).fit(both.where("early").select(X, Y))
                return first.transform(both.where(~F.col("early"))).select(F.col("rawPrediction").alias(X), Y)
        return self.model.transform(data).select(F.col("rawPrediction").alias(X), Y)

    def transform(self, df: DataFrame, out: str = G.LABEL) -> DataFrame:
        """df's rows without nulls, with the label and, where the classifier tells them, {out}_p (probabilities) or {out}_margins (a class's margin each, of support vector machines)."""
        done = self.model.transform(self._vector(df)).withColumn(out, F.col("prediction").cast("int"))
        if "probability" in done.columns:
            done = done.withColumn(f"{out}_p", vector_to_array("probability"))
        elif self.name.startswith("svm"):
            done = done.withColumn(f"{out}_margins", vector_to_array("rawPrediction"))
            if self.calibrated:
                done = done.drop(X, "prediction").withColumnRenamed("rawPrediction", X)
                done = self.platt.transform(done).withColumn(f"{out}_p", vector_to_array("probability"))
        return done.drop(X, "prediction", "rawPrediction", "probability")

    def score(self, df: DataFrame, target: str) -> float:
        """Accuracy against a target."""
        return accuracy(self.transform(df, "_label"), "_label", target)

    def support(self, df: DataFrame, out: str = G.LABEL) -> DataFrame:
        """The rows that hold a support vector machine's planes: those with a class's margin within 1."""
        return self.transform(df, out).where(F.exists(f"{out}_margins", lambda v: F.abs(v) <= 1))

    def importances(self) -> dict[str, float]:
        models = getattr(self.model, "models", [self.model])
        if not hasattr(models[0], "featureImportances"):
            raise ValueError(f"{self.name} has no importances")
        total = np.mean([m.featureImportances.toArray() for m in models], axis=0)
        return dict(zip(self.features, (total / (total.sum() or 1.0)).tolist()))


def accuracy(df: DataFrame, label: str = G.LABEL, target: str = "target") -> float:
    data = df.select(F.col(label).cast("double").alias("prediction"), F.col(target).cast("double").alias("label"))
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(data)


def cross_validated(df: DataFrame, name: str, features: list[str], target: str, folds: int = 3, **options) -> list[float]:
    """Accuracy on each later part of time of a classifier that learned from all before; parts are equal in rows over all series."""
    df = df.na.drop(subset=[*features, target])
    edges = df.agg(F.percentile(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double"), F.array(*[F.lit(i / (folds + 1)) for i in range(1, folds + 1)]))).first()[0]
    at, out = F.unix_timestamp(F.col("ts").cast("timestamp")), []
    for i, e in enumerate(edges):
        test = df.where(at > e) if i + 1 == folds else df.where((at > e) & (at <= edges[i + 1]))
        out.append(accuracy(Detector(name, features, **options).fit(df.where(at <= e), target).transform(test, "_label"), "_label", target))
    return out


def fitted(df: DataFrame, members: list[Detector], target: str | None = None) -> list[Detector]:
    """members, each fitted to df: to the target column, or to clusters, which members of equal features, k and seed share: they are found and written down once."""
    made: dict[tuple, DataFrame] = {}
    for m in members:
        key = (tuple(m.features), m.k, m.seed)
        if target is None and key not in made:
            made[key] = settled(clustered(df.na.drop(subset=m.features), m.features, m.k, m.seed, "_target"), "clusters")
        m.fit(df, target) if target else m.fit(made[key], "_target")
    return members


def voted(df: DataFrame, members: list[Detector], strategy: str = "voting", weights: list[float] | None = None, out: str = G.LABEL) -> DataFrame:
    """df with members' labels as votes, the ensemble's label, and agreement, the modal share.

    voting (modal), weighted, consensus, or bayesian (mean of members' probabilities, one-hot where a member has none).
    Rows with a null in a member's features have no vote of it and are left out.
    """
    k = members[0].k
    for i, m in enumerate(members):
        df = m.transform(df, f"_m{i}")
    hot = lambda i: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (j == F.col(f"_m{i}")).cast("double"))
    df = df.withColumn("votes", F.array(*[f"_m{i}" for i in range(len(members))]))
    ps = []
    for i in range(len(members)):
        ps.append(f"_q{i}")
        df = df.withColumn(f"_q{i}", F.col(f"_m{i}_p") if f"_m{i}_p" in df.columns and strategy == "bayesian" else hot(i))
    df = df.withColumn("p", G.mean_probabilities(ps, weights if strategy == "weighted" else None))
    label = {"voting": G.modal("votes"), "consensus": G.consensus("votes"), "weighted": G.crisp("p"), "bayesian": G.crisp("p")}[strategy]
    df = df.withColumns({out: label.cast("int"), "agreement": G.modal_share("votes")})
    return df.drop(*ps, *[f"_m{i}{end}" for i in range(len(members)) for end in ("", "_p", "_margins")])


def weights_of(df: DataFrame, members: list[Detector], target: str, share: float = 0.2) -> list[float]:
    """A weight for each member, in all 1: its accuracy on the last share of time, having learned from the rest."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    edge = df.agg(F.percentile(at, F.lit(1 - share))).first()[0]
    scores = [m.copy().fit(df.where(at <= edge), target).score(df.where(at > edge), target) for m in members]
    return [s / (sum(scores) or 1.0) for s in scores] if any(scores) else [1 / len(members)] * len(members)


def contributions(df: DataFrame, votes: str = "votes", label: str = G.LABEL, weights: list[float] | None = None) -> DataFrame:
    """member (its place), weight, agrees: the share of rows whose label is the member's vote."""
    row = F.posexplode(F.transform(votes, lambda v: (v == F.col(label)).cast("double"))).alias("member", "same")
    per = df.select(label, votes).select(row).groupBy("member").agg(F.avg("same").alias("agrees"), F.count(F.lit(1)).alias("n_rows"))
    given = F.array(*map(F.lit, weights)) if weights else None
    equal = F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy())
    return per.withColumn("weight", F.get(given, F.col("member")) if weights else equal)


def diversity(df: DataFrame, votes: str = "votes") -> DataFrame:
    """One row: mean agreement, and the mean share of pairs of members that differ."""
    n = F.size(votes)
    same = F.aggregate(F.transform(votes, lambda a: F.size(F.filter(votes, lambda b: a == b))), F.lit(0), lambda s, v: s + v)
    return df.agg(F.avg(G.modal_share(votes)).alias("agreement"), F.avg(1 - (same - n) / (n * (n - 1))).alias("diversity"))


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _cuts(df: DataFrame, shares: list[float]) -> list[int]:
    """The times, in microseconds, before which these shares of rows lie."""
    return [int(v) for v in df.agg(F.percentile(_micros("ts"), F.array(*map(F.lit, shares)))).first()[0]]


def stacked(df: DataFrame, members: list[Detector], target: str, folds: int = 5, out: str = G.LABEL) -> DataFrame:
    """A logistic regression over members' labels, which learned from labels that members gave to stretches of time after those they had seen.

    Time is cut into folds + 1 parts of equally many rows; of each but the first, members learned from what lies before it.
    """
    cuts = [*_cuts(df, [(f + 1) / (folds + 1) for f in range(folds)]), None]
    unseen = None
    for start, end in zip(cuts, cuts[1:]):
        before, part = df.where(_micros("ts") < start), df.where(_micros("ts") >= start)
        part = part if end is None else part.where(_micros("ts") < end)
        for i, m in enumerate(members):
            part = m.copy().fit(before, target).transform(part, f"_m{i}")
        part = part.select(*[f"_m{i}" for i in range(len(members))], F.col(target).cast("double").alias(Y))
        unseen = part if unseen is None else unseen.unionByName(part)
    k = members[0].k
    hot = F.array(*[(F.col(f"_m{i}") == j).cast("double") for i in range(len(members)) for j in range(k)])
    meta = LogisticRegression(featuresCol=X, labelCol=Y, regParam=0.01).fit(unseen.withColumn(X, array_to_vector(hot)))
    for i, m in enumerate(members):
        df = m.fit(df, target).transform(df, f"_m{i}")
    done = meta.transform(df.withColumn(X, array_to_vector(hot)))
    return done.withColumn(out, F.col("prediction").cast("int")).drop(X, "prediction", "rawPrediction", "probability", *[f"_m{i}{end}" for i in range(len(members)) for end in ("", "_p", "_margins")])


def bagged(df: DataFrame, features: list[str], target: str, n: int = 5, name: str = "logistic", seed: int = 42, out: str = G.LABEL) -> DataFrame:
    """The vote of n classifiers, each of which learned from a draw with replacement."""
    members = [Detector(name, features, seed=seed + i).fit(df.sample(True, 1.0, seed + i), target) for i in range(n)]
    return voted(df, members, out=out)


def hierarchical(df: DataFrame, levels: list[list[Detector]], target: str, out: str = G.LABEL) -> DataFrame:
    """Each level's members see the features and the labels of the level before; the last level votes."""
    added: list[str] = []
    for i, level in enumerate(levels):
        for m in level:
            m.features = [*m.features, *[c for c in added if c not in m.features]]
            m.fit(df, target)
        if i + 1 == len(levels):
            return voted(df, level, out=out).drop(*added)
        for j, m in enumerate(level):
            df = m.transform(df, f"level{i}_{j}").drop(f"level{i}_{j}_p", f"level{i}_{j}_margins")
        added += [f"level{i}_{j}" for j in range(len(level))]
    raise ValueError("no levels")



def boosted_stumps(df: DataFrame, features: list[str], target: str, rounds: int = 10, depth: int = 1, out: str = G.LABEL) -> DataFrame:
    """Multi-class AdaBoost over shallow trees: rows that a round gets wrong weigh more in the next; rounds vote by their weight."""
    data, _ = assembled(df, features)
    k = int(df.agg(F.max(target)).first()[0]) + 1
    data = data.withColumns({Y: F.col(target).cast("double"), "_w": F.lit(1.0)})
    learned, trees = data.where(F.col(Y).isNotNull()).select(X, Y, "_w").persist(), []
    for i in range(rounds):
        tree = DecisionTreeClassifier(featuresCol=X, labelCol=Y, weightCol="_w", maxDepth=depth, seed=i, predictionCol="_c").fit(learned)
        seen = tree.transform(learned)
        error = seen.agg(F.sum(F.when(F.col("_c") != F.col(Y), F.col("_w")).otherwise(0.0)) / F.sum("_w")).first()[0]
        if error >= 1 - 1 / k:
            break
        alpha = math.log((1 - error) / max(error, 1e-10)) + math.log(k - 1)
        trees.append((alpha, tree))
        if error < 1e-10:
            break
        again = F.when(F.col("_c") != F.col(Y), F.col("_w") * math.exp(alpha)).otherwise(F.col("_w"))
        learned = seen.withColumn("_w", again / (error * math.exp(alpha) + 1 - error)).select(X, Y, "_w")
    votes = [F.lit(0.0)] * k
    for i, (alpha, tree) in enumerate(trees):
        data = tree.setPredictionCol(f"_t{i}").transform(data).drop("rawPrediction", "probability")
        votes = [v + F.when(F.col(f"_t{i}") == c, F.lit(alpha)).otherwise(0.0) for c, v in enumerate(votes)]
    p = F.array(*votes)
    return data.withColumn(out, (F.array_position(p, F.array_max(p)) - 1).cast("int")).drop(X, Y, "_w", *[f"_t{i}" for i in range(len(trees))])


def tuned(df: DataFrame, name: str, features: list[str], target: str, grid: dict[str, list], folds: int = 3) -> list[tuple[float, dict]]:
    """(mean accuracy, options) of each choice from grid, the best first; folds are later parts of time."""
    out = []
    for values in product(*grid.values()):
        options = dict(zip(grid, values))
        out.append((float(np.mean(cross_validated(df, name, features, target, folds, **options))), options))
    return sorted(out, key=lambda x: -x[0])


def save(detector: Detector, path: str) -> None:
    """The model under path/model by Spark's writer, what else the detector needs as a one-row table beside it."""
    detector.model.write().overwrite().save(f"{path}/model")
    told = {"name": detector.name, "features": detector.features, "k": detector.k, "seed": detector.seed, "scaler": detector.scaler, "class": type(detector.model).__name__, "calibrated": detector.calibrated, "options": detector.options, "platt": getattr(detector, "platt", None) is not None}
    if told["platt"]:
        detector.platt.write().overwrite().save(f"{path}/platt")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(told),)], "told string").coalesce(1).write.mode("overwrite").parquet(f"{path}/detector")


def load(spark: SparkSession, path: str) -> Detector:
    told = json.loads(spark.read.parquet(f"{path}/detector").first().told)
    out = Detector(told["name"], told["features"], told["k"], told["seed"], calibrated=told.get("calibrated", False), **told.get("options", {}))
    out.scaler = {c: tuple(v) for c, v in told["scaler"].items()}
    kinds = {c.__name__: c for c in (RandomForestClassificationModel, OneVsRestModel, LogisticRegressionModel)}
    out.model = kinds[told["class"]].load(f"{path}/model")
    if told.get("platt"):
        out.platt = LogisticRegressionModel.load(f"{path}/platt")
    return out


def best_k(df: DataFrame, features: list[str], ks: tuple[int, ...] = (2, 3, 4, 5), criterion: str = "bic", least_share: float = 0.0) -> int:
    """The number of regimes by aic or bic of a mixture, or by the Calinski-Harabasz index of k-means; choices whose smallest regime has under least_share of the rows are passed over if any other is left."""
    if criterion in ("aic", "bic"):
        scores = {k: {"aic": a, "bic": b}[criterion] for k, a, b in selected_mixture(df, features, ks)}
    else:
        scores = {k: -(metrics.cluster_quality(clustered(df, features, k), features).first().calinski_harabasz or 0.0) for k in ks}
    share = {k: 1.0 for k in ks}
    if least_share:
        for k in ks:
            n = [r[1] for r in clustered(df, features, k).groupBy(G.LABEL).count().collect()]
            share[k] = min(n) / sum(n) if len(n) == k else 0.0
    left = [k for k in ks if share[k] >= least_share] or list(ks)
    return min(left, key=scores.__getitem__)


def isolation_scores(df: DataFrame, features: list[str], trees: int = 100, sample: int = 256, seed: int = 42, out: str = "isolation") -> DataFrame:
    """How easily random cuts set a row apart, near 1 for outliers. Trees learn from `sample` rows each, drawn by a hash over all rows; all rows are scored."""
    data = df.na.drop(subset=features)
    drawn = data.select(*features).orderBy(F.xxhash64(*features, F.lit(seed))).limit(trees * sample // 4).toPandas().to_numpy(float)  # at most that many rows
    rng = np.random.default_rng(seed)

    def grow(x: np.ndarray, depth: int):
        if depth == 0 or len(x) < 2:
            return len(x)
        j = rng.integers(x.shape[1])
        low, high = x[:, j].min(), x[:, j].max()
        if low == high:
            return len(x)
        cut = rng.uniform(low, high)
        return int(j), float(cut), grow(x[x[:, j] < cut], depth - 1), grow(x[x[:, j] >= cut], depth - 1)

    size = min(sample, len(drawn))
    forest = [grow(drawn[rng.choice(len(drawn), size, replace=False)], math.ceil(math.log2(max(2, size)))) for _ in range(trees)]
    usual = lambda n: 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def depths(node, x: np.ndarray, at: np.ndarray, depth: int, into: np.ndarray) -> None:
        if isinstance(node, int):
            into[at] += depth + usual(node)
            return
        left = x[at, node[0]] < node[1]
        depths(node[2], x, at[left], depth + 1, into)
        depths(node[3], x, at[~left], depth + 1, into)

    def scored(*columns: pd.Series) -> pd.Series:
        x, total = np.column_stack([c.to_numpy(float) for c in columns]), np.zeros(len(columns[0]))
        for tree in forest:
            depths(tree, x, np.arange(len(x)), 0, total)
        return pd.Series(2 ** (-total / trees / usual(size)))

    return data.withColumn(out, F.pandas_udf(scored, "double", F.PandasUDFType.SCALAR)(*features))
