"""Boosting, kernels and detectors as estimators: against plain versions, through pipelines, copies, files and folds."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from tidegauge.operators import boosting as B
from tidegauge.operators import kernels as K
from tidegauge.operators.estimator import RegimeDetector, RegimeDetectorModel, solved

NAMES = ["a", "b", "c"]


def frame(n=400, seed=1):
    rng = np.random.default_rng(seed)
    y = (np.arange(n) // 20) % 3
    x = rng.normal(0, 1.0, (n, 3)) + np.array([[0, 0, 0], [2.5, 0, 1], [0, 2.5, -1]])[y]
    return pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=n, freq="h"), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(frame()).repartition(3).persist()


@pytest.fixture(scope="module")
def vectors(df):
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).withColumnRenamed("y", "label").persist()


def grown_plainly(x, y, edges, rounds, rate, depth, k=3, l2=1.0, least=1.0):
    """Margins by the same rule, over numpy arrays."""
    bins = np.column_stack([1 + (x[:, [f]] > np.array(e)).sum(1) for f, e in enumerate(edges)])
    m = np.zeros((len(x), k))
    for _ in range(rounds):
        p = np.exp(m) / np.exp(m).sum(1, keepdims=True)
        step = np.zeros_like(m)
        for c in range(k):
            g, h = p[:, c] - (y == c), p[:, c] * (1 - p[:, c])

            def grow(rows, left):
                G, H = g[rows].sum(), h[rows].sum()
                best = (1e-9, None)
                for f in range(x.shape[1]) if left else ():
                    for b in range(bins[:, f].max() + 1):
                        lo = rows[bins[rows, f] <= b]
                        gl, hl = g[lo].sum(), h[lo].sum()
                        if hl >= least and H - hl >= least:
                            gain = round(0.5 * (gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2)), 9)
                            best = max(best, (gain, (-f, -b)), key=lambda v: (v[0], v[1] or (-9e9, 0)))
                if best[1] is None:
                    step[rows, c] = -rate * G / (H + l2)
                    return
                f, b = -best[1][0], -best[1][1]
                grow(rows[bins[rows, f] <= b], left - 1)
                grow(rows[bins[rows, f] > b], left - 1)

            grow(np.arange(len(x)), depth)
        m += step
    return m


def test_boosting_equals_plain_version(vectors):
    model = B.HistogramBoosting(maxIter=4, maxDepth=3, stepSize=0.3, bins=8).fit(vectors)
    got = model.transform(vectors).orderBy("ts").select(*NAMES, "label", vector_to_array("rawPrediction").alias("m"), vector_to_array("probability").alias("p"), "prediction").toPandas()
    want = grown_plainly(got[NAMES].to_numpy(), got.label.to_numpy(), model.told["edges"], 4, 0.3, 3)
    m = np.array(got.m.tolist())
    assert np.allclose(m, want, atol=1e-9)
    assert np.allclose(np.array(got.p.tolist()), np.exp(m) / np.exp(m).sum(1, keepdims=True)) and (got.prediction == m.argmax(1)).all()
    assert (got.prediction == got.label).mean() > 0.85
    for kind in ("weight", "gain", "cover"):
        assert sum(model.importances(kind).values()) == pytest.approx(1)
    assert all(v is None or 0 <= v < 3 for _, _, _, v, *_ in model.tree_rows())


def test_boosting_stops_early_and_is_saved(spark, vectors, tmp_path):
    est = B.HistogramBoosting(maxIter=40, maxDepth=4, stepSize=1.0, leastHessian=0.1, heldOut=0.25, patience=3)
    model = est.fit(vectors)
    losses = model.losses
    assert len(losses) < 40 and model.rounds == int(np.argmin(losses)) + 1 == len(losses) - 3
    # The held-out stretch is the last quarter of time; its loss is that of the kept rounds.
    held = model.transform(vectors).orderBy("ts").select("label", vector_to_array("probability").alias("p")).toPandas()[300:]
    assert -np.mean([math.log(p[y]) for p, y in zip(held.p, held.label)]) == pytest.approx(min(losses), abs=0.02)
    path = str(tmp_path / "boost")
    model.write().overwrite().save(path)
    again = B.HistogramBoostingModel.load(path)
    assert again.told == model.told and again.transform(vectors).exceptAll(model.transform(vectors)).count() == 0


def test_boosting_odd_rows(spark):
    rows = [(float("nan") if i % 7 == 0 else float(i % 5), None if i % 11 == 0 else 1.0, i % 2 if i % 13 else None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, label int, ts int").withColumn("features", array_to_vector(F.array(F.coalesce("a", F.lit(float("nan"))), F.coalesce("b", F.lit(float("nan"))))))
    model = B.HistogramBoosting(maxIter=12, maxDepth=2, stepSize=0.5, subsample=0.7, columns=0.5, leastHessian=0.1).fit(df)
    out = model.transform(df)
    assert out.count() == 200 and out.where("prediction IS NULL").count() == 0
    with pytest.raises(ValueError, match="label"):
        B.HistogramBoosting().fit(df.where("label IS NULL"))
    one = B.HistogramBoosting(maxIter=3).fit(df.where("label = 0"))
    assert {r.prediction for r in one.transform(df).select("prediction").distinct().collect()} == {0.0}


@pytest.mark.parametrize("kind", K.KERNELS)
def test_kernel_features_and_exact_margins(spark, vectors, kind):
    est = K.NystromKernel(kind=kind, landmarks=40, gamma=0.3, coef0=0.5)
    model = est.fit(vectors)
    out = model.values(model.transform(vectors)).select("features", "label", vector_to_array("kernel").alias("phi"), "kernel_values").toPandas()
    x, at = np.array([v.toArray() for v in out.features]), model.points
    inner = x @ at.T
    want = {"linear": inner, "rbf": np.exp(-0.3 * ((x[:, None] - at) ** 2).sum(2)), "poly": (0.3 * inner + 0.5) ** 3, "sigmoid": np.tanh(0.3 * inner + 0.5)}[kind]
    assert np.allclose(np.array(out.kernel_values.tolist()), want)
    if kind != "sigmoid":  # which isn't a product of features
        same = [int(np.abs(x - p).sum(1).argmin()) for p in at]
        phi = np.array(out.phi.tolist())
        assert np.allclose(phi @ phi[same].T, want, atol=1e-5)
    machine = OneVsRest(classifier=LinearSVC(featuresCol="kernel", maxIter=10, regParam=0.01), featuresCol="kernel").fit(model.transform(vectors))
    held = K.support_vectors(vectors, model, [m.coefficients.toArray() for m in machine.models]).toPandas()
    assert set(held["class"]) == {0, 1, 2} and len(held) <= 120
    got = machine.transform(model.transform(vectors)).select("features", vector_to_array("rawPrediction").alias("r"), "label", "prediction").toPandas()
    x = np.array([v.toArray() for v in got.features])
    for c, own in held.groupby("class"):
        margin = K.kernel(x, np.array(own.vector.tolist()), kind, 0.3, 3, 0.5) @ own.weight.to_numpy() + machine.models[c].intercept
        assert np.allclose(margin, [r[c] for r in got.r], atol=1e-4)
    assert (got.label == got.prediction).mean() > (0.75 if kind != "sigmoid" else 0.5)


def test_landmarks_are_distinct_and_bounded(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 500 + [(float(i), 1.0) for i in range(20)], "a double, b double")
    df = df.withColumn("features", array_to_vector(F.array("a", "b")))
    assert len(K.NystromKernel(landmarks=10).fit(df).points) == 10 and len(K.NystromKernel(landmarks=100).fit(df).points) == 21


@pytest.mark.parametrize("kind", ["kmeans", "gmm", "random_forest", "boosting", "svm_rbf", "svm_poly", "logistic"])
def test_detectors_are_saved_and_read_alike(spark, df, tmp_path, kind):
    est = RegimeDetector(kind=kind, features=NAMES, calibrated=kind == "svm_rbf", labelCol="" if kind in ("kmeans", "gmm", "logistic") else "y", seed=3)
    est.write().overwrite().save(str(tmp_path / "est"))
    est = RegimeDetector.load(str(tmp_path / "est"))
    assert est.getOrDefault("kind") == kind and est.copy({est.k: 4}).getOrDefault("k") == 4 and est.getOrDefault("k") == 3
    model = est.fit(df)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = RegimeDetectorModel.load(str(tmp_path / "model"))
    assert {p.name: v for p, v in again.extractParamMap().items()} == {p.name: v for p, v in model.extractParamMap().items()}
    a, b = (m.transform(df).orderBy("ts").toPandas() for m in (model, again))
    assert a.columns.tolist() == b.columns.tolist() and (a.regime == b.regime).all() and a.regime.nunique() == 3
    if kind == "svm_poly":
        assert "p" not in a and "margins" in a
    if "p" in a:
        assert np.allclose(np.array(a.p.tolist()), np.array(b.p.tolist())) and np.allclose(np.array(a.p.tolist()).sum(1), 1)
    if kind not in ("kmeans", "gmm", "logistic"):
        assert model.score(df) == pytest.approx((a.regime == a.y).mean()) and model.score(df) > 0.6
    if kind in ("random_forest", "boosting"):
        assert set(model.importances()) == set(NAMES)
    if kind.startswith("svm"):
        assert model.support(df).count() > 10
    if kind == "kmeans":
        means = a.groupby("regime").a.mean()
        assert means.is_monotonic_increasing


def test_mixture_score_and_mahalanobis(df):
    model = RegimeDetector(kind="gmm", features=NAMES).fit(df)
    inner = model.inner.stages[-1]
    assert model.score(df) == pytest.approx(inner.summary.logLikelihood / df.count(), rel=0.05)
    x = df.select(*NAMES).toPandas().to_numpy()
    mean, cov = x.mean(0), np.cov(x.T)
    got = df.select(*NAMES, solved(F.array(*NAMES), mean, cov)[0].alias("d")).toPandas()
    off = got[NAMES].to_numpy() - mean
    assert np.allclose(got.d, np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))


def test_pipeline_and_cross_validator(spark, df, tmp_path):
    data = df.withColumn("label", F.col("y").cast("double"))
    est = RegimeDetector(kind="boosting", features=NAMES, labelCol="label", options=json.dumps({"maxIter": 2}))
    pipe = Pipeline(stages=[est]).fit(data)
    pipe.write().overwrite().save(str(tmp_path / "pipe"))
    same = PipelineModel.load(str(tmp_path / "pipe")).transform(data).exceptAll(pipe.transform(data)).count()
    assert same == 0
    grid = ParamGridBuilder().addGrid(est.options, [json.dumps({"maxIter": 1, "maxDepth": 1}), json.dumps({"maxIter": 3})]).build()
    judge = MulticlassClassificationEvaluator(predictionCol="as_double", labelCol="label", metricName="accuracy")
    from pyspark.ml.feature import SQLTransformer

    both = Pipeline(stages=[est, SQLTransformer(statement="SELECT *, CAST(regime AS DOUBLE) AS as_double FROM __THIS__")])
    found = CrossValidator(estimator=both, estimatorParamMaps=grid, evaluator=judge, numFolds=2, seed=1).fit(data)
    assert len(found.avgMetrics) == 2 and found.avgMetrics[1] >= found.avgMetrics[0]


def test_calibration_by_a_later_stretch(spark):
    """Labels that are chance in the later part of time: a calibrator that saw its own training rows would be sure of them."""
    rng = np.random.default_rng(0)
    early = frame(400, 2)
    late = frame(100, 3).assign(ts=lambda d: d.ts + pd.Timedelta("60d"), y=rng.integers(0, 3, 100))
    data = spark.createDataFrame(pd.concat([early, late]))
    model = RegimeDetector(kind="svm_linear", features=NAMES, labelCol="y", calibrated=True).fit(data)
    p = np.array(model.transform(data).toPandas().p.tolist())
    assert p.max(1).mean() < 0.6


def test_wrong_parameters(df):
    for bad in ({"kind": "oracle"}, {"features": []}, {"features": ["a", "a"]}, {"k": 1}):
        with pytest.raises(ValueError):
            RegimeDetector(**({"features": NAMES} | bad)).fit(df)
