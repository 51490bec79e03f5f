"""Regime detectors as an estimator of spark.ml: parameters, copies, saving and reading, pipelines and cross-validation as of any other.

    model = RegimeDetector(kind="boosting", features=["returns", "vol"], k=3).fit(bars)
    model.write().overwrite().save(path); RegimeDetectorModel.load(path)

A detector scales its features, makes its target by k-means where labelCol is unset, learns, and, with calibrated, gives
margins probabilities: by a logistic regression over margins of a machine that had learned from the earlier part of time only,
for rows of the later part. Rows with a null in a feature have no label and are left out of what it returns. Columns named
prediction, probability or rawPrediction, or with a leading underscore, are spark.ml's own here.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, LogisticRegressionModel, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import HistogramBoosting
from .kernels import NystromKernel, support_vectors

KINDS = ("kmeans", "gmm", "random_forest", "boosted", "boosting", "logistic", "svm_linear", "svm_rbf", "svm_poly", "svm_sigmoid")
RAW, X, PHI = "rawPrediction", "_x", "_phi"


class _Detector(HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed):
    kind = Param(Params._dummy(), "kind", " or ".join(KINDS), TypeConverters.toString)
    features = Param(Params._dummy(), "features", "columns that labels hang on", TypeConverters.toListString)
    k = Param(Params._dummy(), "k", "number of regimes", TypeConverters.toInt)
    calibrated = Param(Params._dummy(), "calibrated", "whether margins are given probabilities", TypeConverters.toBoolean)
    orderCol = Param(Params._dummy(), "orderCol", "column of time", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "parameters of the classifier or kernel within, as JSON", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(kind="random_forest", features=[], k=3, calibrated=False, orderCol="ts", options="{}", seed=42, labelCol="", predictionCol="regime", probabilityCol="p")


class RegimeDetector(Estimator, _Detector, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, kind="random_forest", features=None, k=3, labelCol="", predictionCol="regime", probabilityCol="p", calibrated=False, orderCol="ts", options="{}", seed=42):
        super().__init__()
        self._defaults()
        self._set(**{c: v for c, v in self._input_kwargs.items() if v is not None})

    @keyword_only
    def setParams(self, *, kind=None, features=None, k=None, labelCol=None, predictionCol=None, probabilityCol=None, calibrated=None, orderCol=None, options=None, seed=None):  # noqa: N802
        return self._set(**{c: v for c, v in self._input_kwargs.items() if v is not None})

    def _classifier(self, label: str):
        of, seed = self.getOrDefault, self.getSeed()
        kind, own = of(self.kind), json.loads(of(self.options))
        both = {"featuresCol": X, "labelCol": label}
        if kind == "random_forest":
            return [RandomForestClassifier(**both, seed=seed, **({"numTrees": 50} | own))]
        if kind == "boosted":
            return [OneVsRest(classifier=GBTClassifier(**both, seed=seed, **({"maxIter": 10, "maxDepth": 3} | own)), parallelism=4, **both)]
        if kind == "boosting":
            return [HistogramBoosting(**both, seed=seed, orderCol=of(self.orderCol), **({"maxIter": 10, "maxDepth": 3, "stepSize": 0.3} | own))]
        if kind == "logistic":
            return [LogisticRegression(**both, **own)]
        if kind.startswith("svm_"):
            machine = {c: own.pop(c) for c in ("regParam", "maxIter") if c in own}
            last = lambda x: OneVsRest(classifier=LinearSVC(featuresCol=x, labelCol=label, **({"maxIter": 10, "regParam": 0.01} | machine)), featuresCol=x, labelCol=label, parallelism=4)
            return [last(X)] if kind == "svm_linear" else [NystromKernel(inputCol=X, outputCol=PHI, kind=kind[4:], seed=seed, **own), last(PHI)]
        raise ValueError(f"unknown kind {kind!r}")

    def _fit(self, df: DataFrame) -> RegimeDetectorModel:
        of, label = self.getOrDefault, self.getLabelCol()
        names, kind = of(self.features), of(self.kind)
        if not names or len(set(names)) != len(names) or kind not in KINDS or not 2 <= of(self.k) <= 50:
            raise ValueError(f"features must be distinct names, kind one of {KINDS}, k from 2 to 50")
        assemble = VectorAssembler(inputCols=names, outputCol="_v", handleInvalid="skip")
        scale = StandardScaler(inputCol="_v", outputCol=X, withMean=True).fit(assemble.transform(df))
        keep = [of(self.orderCol)] if of(self.orderCol) in df.columns else []
        rows = scale.transform(assemble.transform(df))
        place = list(range(of(self.k)))
        if kind in ("kmeans", "gmm") or not label:
            kmeans = KMeans(k=of(self.k), seed=self.getSeed(), featuresCol=X, predictionCol="_c") if kind != "gmm" else GaussianMixture(k=of(self.k), seed=self.getSeed(), featuresCol=X, predictionCol="_c", probabilityCol="_q")
            made = kmeans.fit(rows)
            first = [float(c[0]) for c in made.clusterCenters()] if kind != "gmm" else [float(r.mean[0]) for r in made.gaussiansDF.collect()]
            place = [int(i) for i in np.argsort(np.argsort(first, kind="stable"), kind="stable")]
            if kind in ("kmeans", "gmm"):
                return self._done(PipelineModel([assemble, scale, made]), None, place)
            rows = made.transform(rows).withColumn("_y", F.get(F.array(*map(F.lit, place)), F.col("_c")).cast("double"))
        else:
            rows = rows.withColumn("_y", F.col(label).cast("double")).where("_y IS NOT NULL")
        data = rows.select(X, "_y", *keep).persist()
        try:
            stages = self._through(data)
            platt = None
            if of(self.calibrated) and kind.startswith("svm_"):
                at = F.unix_micros(F.col(of(self.orderCol)).cast("timestamp"))
                edge = data.agg(F.percentile_approx(at, F.lit(0.8), 10_000)).first()[0]
                told = PipelineModel(self._through(data.where(at <= edge))).transform(data.where(at > edge))
                platt = LogisticRegression(featuresCol=RAW, labelCol="_y", predictionCol="_py", probabilityCol="_pp", rawPredictionCol="_pr", regParam=0.01, maxIter=20).fit(told.select(RAW, "_y"))
        finally:
            data.unpersist()
        return self._done(PipelineModel([assemble, scale, *stages]), platt, place)

    def _through(self, data: DataFrame) -> list:
        """Fitted stages, each over what the one before made."""
        out = []
        for stage in self._classifier("_y"):
            out.append(stage.fit(data))
            data = out[-1].transform(data)
        return out

    def _done(self, inner: PipelineModel, platt, place: list[int]) -> RegimeDetectorModel:
        return self._copyValues(RegimeDetectorModel(inner, platt, place))


class _Writer(MLWriter):
    def __init__(self, model: RegimeDetectorModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"place": m.place, "platt": m.platt is not None})
        m.inner.write().overwrite().save(f"{path}/inner")
        if m.platt is not None:
            m.platt.write().overwrite().save(f"{path}/platt")


class _Reader(MLReader):
    def load(self, path: str) -> RegimeDetectorModel:
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        platt = LogisticRegressionModel.load(f"{path}/platt") if told["platt"] else None
        out = RegimeDetectorModel(PipelineModel.load(f"{path}/inner"), platt, told["place"])
        out._resetUid(told["uid"])
        DefaultParamsReader.getAndSetParams(out, told)
        return out


class RegimeDetectorModel(Model, _Detector, MLWritable, MLReadable):
    """A fitted detector: transform() adds predictionCol (a whole number) and, where it tells them, probabilityCol and margins."""

    def __init__(self, inner: PipelineModel | None = None, platt=None, place: list[int] | None = None):
        super().__init__()
        self._defaults()
        self.inner, self.platt, self.place = inner, platt, place or []

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader()

    def copy(self, extra=None) -> RegimeDetectorModel:
        out = super().copy(extra)
        out.inner, out.platt, out.place = self.inner, self.platt, self.place
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        of = self.getOrDefault
        y, p, kind = self.getPredictionCol(), self.getProbabilityCol(), of(self.kind)
        names = df.columns
        done = self.inner.transform(df)
        if kind in ("kmeans", "gmm"):
            done = done.withColumn(y, F.get(F.array(*map(F.lit, self.place)), F.col("_c")))
            if kind == "gmm":
                q = vector_to_array("_q")
                done = done.withColumn(p, F.array(*[F.get(q, F.lit(self.place.index(i))) for i in range(len(self.place))]))
        else:
            done = done.withColumn(y, F.col("prediction").cast("int"))
            if self.platt is not None:
                done = self.platt.transform(done).withColumn(p, vector_to_array("_pp"))
            elif "probability" in done.columns:
                done = done.withColumn(p, vector_to_array("probability"))
            if kind.startswith("svm_"):
                done = done.withColumn("margins", vector_to_array(RAW))
        return done.select(*names, *[c for c in (y, p, "margins") if c in done.columns and c not in names])

    @property
    def classifier(self):
        return self.inner.stages[-1]

    def importances(self) -> dict[str, float]:
        """The share of each feature in what trees cut by."""
        m, names = self.classifier, self.getOrDefault(self.features)
        if hasattr(m, "importances"):
            return dict(zip(names, m.importances().values()))
        models = getattr(m, "models", [m])
        if not hasattr(models[0], "featureImportances"):
            raise ValueError(f"{self.getOrDefault(self.kind)} has no importances")
        total = np.mean([x.featureImportances.toArray() for x in models], axis=0)
        return dict(zip(names, (total / (total.sum() or 1.0)).tolist()))

    def support(self, df: DataFrame) -> DataFrame:
        """class, landmark, vector (of scaled features) and weight of a kernel machine's support vectors."""
        return support_vectors(df, self.inner.stages[-2], [m.coefficients.toArray() for m in self.classifier.models])

    def score(self, df: DataFrame) -> float:
        """Of a mixture, the mean log likelihood of df's rows (of scaled features); of others the accuracy against labelCol."""
        if self.getOrDefault(self.kind) == "gmm":
            m = self.inner.stages[-1]
            rows = self.inner.transform(df).select(vector_to_array(X).alias("x"))
            dens = [_gaussian(F.col("x"), r.mean.toArray(), r.cov.toArray()) + F.lit(float(np.log(w))) for w, r in zip(m.weights, m.gaussiansDF.collect())]
            top = F.greatest(*dens) if len(dens) > 1 else dens[0]
            return rows.agg(F.avg(top + F.ln(sum((F.exp(d - top) for d in dens), F.lit(0.0))))).first()[0]
        done = self.transform(df).where(F.col(self.getLabelCol()).isNotNull())
        return done.agg(F.avg((F.col(self.getPredictionCol()) == F.col(self.getLabelCol())).cast("double"))).first()[0]


def _gaussian(x, mean: np.ndarray, cov: np.ndarray):
    """The log density of an array column, by Cholesky's factor written out as column expressions."""
    squares, log_det = solved(x, mean, cov)
    return -0.5 * (squares + F.lit(float(len(mean) * np.log(2 * np.pi) + log_det)))


def solved(x, mean: np.ndarray, cov: np.ndarray):
    """The squared Mahalanobis distance of an array column as an expression, and the log determinant of cov."""
    low = np.linalg.cholesky(cov)
    back = np.linalg.inv(low)
    off = [F.get(x, F.lit(i)) - F.lit(float(m)) for i, m in enumerate(mean)]
    z = [sum((off[j] * F.lit(float(back[i, j])) for j in range(i + 1)), F.lit(0.0)) for i in range(len(off))]
    return sum((v * v for v in z), F.lit(0.0)), float(2 * np.log(np.diag(low)).sum())
