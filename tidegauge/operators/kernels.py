"""Kernel machines by Nystrom's method: a kernel's features over landmarks, as an estimator of spark.ml, and support vectors.

Landmarks are a bounded sample of the distinct vectors, those with the least hashes, so that every vector can be one and copies
count once. With K the kernel between landmarks and K = U E U', a row's features are k(x, landmarks) U E^(-1/2) over
directions with E > 0 (the sigmoid kernel has others, which are left out): their inner products are the kernel's values where
one of the two is a landmark, and close to them elsewhere. A linear machine over these features is a kernel machine whose
support vectors are the landmarks, with weights U E^(-1/2) w.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KERNELS = ("linear", "rbf", "poly", "sigmoid")


def kernel(a: np.ndarray, b: np.ndarray, kind: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 0.0) -> np.ndarray:
    """The kernel's values between rows of a and of b."""
    if kind == "rbf":
        return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))
    inner = a @ b.T
    if kind == "linear":
        return inner
    if kind == "poly":
        return (gamma * inner + coef0) ** degree
    if kind == "sigmoid":
        return np.tanh(gamma * inner + coef0)
    raise ValueError(f"unknown kernel {kind!r}")


class _Kernel(HasInputCol, HasOutputCol):
    kind = Param(Params._dummy(), "kind", "linear, rbf, poly or sigmoid", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "scale of products or distances; 0 for one over the number of entries", TypeConverters.toFloat)
    degree = Param(Params._dummy(), "degree", "power of the polynomial", TypeConverters.toInt)
    coef0 = Param(Params._dummy(), "coef0", "added to products", TypeConverters.toFloat)

    def _values(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        of = self.getOrDefault
        return kernel(a, b, of(self.kind), of(self.gamma) or 1 / max(1, b.shape[1]), of(self.degree), of(self.coef0))


class NystromKernel(Estimator, _Kernel, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    landmarks = Param(Params._dummy(), "landmarks", "the bound of the sample", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="kernel", kind="rbf", gamma=0.0, degree=3, coef0=0.0, landmarks=64, seed=42):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="kernel", kind="rbf", gamma=0.0, degree=3, coef0=0.0, landmarks=64, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> NystromKernelModel:
        if self.getOrDefault(self.kind) not in KERNELS:
            raise ValueError(f"unknown kernel {self.getOrDefault(self.kind)!r}")
        x = df.select(vector_to_array(self.getInputCol()).alias("x")).where("x IS NOT NULL").distinct()
        drawn = x.orderBy(F.xxhash64("x", F.lit(self.getSeed())), "x").limit(self.getOrDefault(self.landmarks)).collect()
        if not drawn:
            raise ValueError("no row to take landmarks from")
        at = np.array([r.x for r in drawn])
        e, u = np.linalg.eigh(self._values(at, at))
        on = e > max(e.max(), 0) * len(at) * np.finfo(float).eps * 4
        state = {"landmarks": at.tolist(), "map": (u[:, on] / np.sqrt(e[on])).tolist()}
        return self._copyValues(NystromKernelModel(state=json.dumps(state)))


class NystromKernelModel(Model, _Kernel, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "landmarks and the map from kernel values to features, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state="{}"):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="kernel", kind="rbf", gamma=0.0, degree=3, coef0=0.0)
        self._set(**self._input_kwargs)

    @property
    def points(self) -> np.ndarray:
        return np.array(json.loads(self.getOrDefault(self.state))["landmarks"])

    @property
    def map(self) -> np.ndarray:
        return np.array(json.loads(self.getOrDefault(self.state))["map"]).reshape(len(self.points), -1)

    def _over(self, df: DataFrame, right: np.ndarray):
        at, values = self.points, self._values

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(values(np.array(list(x), float), at) @ right))

        return mapped(vector_to_array(self.getInputCol()))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), array_to_vector(self._over(df, self.map)))

    def values(self, df: DataFrame, out: str = "kernel_values") -> DataFrame:
        """df with the kernel's values between each row and all landmarks."""
        return df.withColumn(out, self._over(df, np.eye(len(self.points))))


def support_vectors(df: DataFrame, model: NystromKernelModel, coefficients: list[np.ndarray], least: float = 1e-6) -> DataFrame:
    """class, landmark, vector and weight of the landmarks that hold up each class's plane: margin(x) = sum of weight * k(x, vector) + intercept. Weights under `least` of a class's largest are none."""
    rows, at = [], model.points
    for c, w in enumerate(coefficients):
        beta = model.map @ np.asarray(w)
        rows += [(c, i, at[i].tolist(), float(b)) for i, b in enumerate(beta) if abs(b) > least * max(np.abs(beta).max(), 1e-300)]
    return df.sparkSession.createDataFrame(rows, "class int, landmark int, vector array<double>, weight double")
