"""Benchmarks of models over data sets: a grid of fits as resumable jobs, their results a table, and reports over it.

A cell of the grid is a data set, a model and a seed. Its key is a hash of the data set's rows, the model's parameters and the
seed; the store holds a row for each key that is done, so that a run which was stopped goes on where it was, and one whose
data or parameters changed does that part anew. Cells run concurrently, each as a job group by its key (which can be
cancelled) in a scheduler pool of its own. A cell that fails is a row with its error; failed cells are tried again next time.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from itertools import combinations

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import validation
from . import regimes as G

RESULTS = "key string, dataset string, model string, seed int, params string, measure string, value double, error string"


def fingerprint(df: DataFrame) -> str:
    """A hash of a table's rows, whatever their order."""
    one = F.xxhash64(*[F.col(c) for c in df.columns])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("x"), F.sum(F.pmod(one, F.lit(1 << 31))).alias("s")).first()
    return hashlib.sha256(json.dumps([df.columns, r.n, r.x, r.s]).encode()).hexdigest()[:16]


def params_of(estimator: Estimator) -> str:
    return json.dumps({p.name: str(v) for p, v in estimator.extractParamMap().items()}, sort_keys=True)


class Benchmark:
    """datasets: tables by name; those that are empty are passed over. models: estimators by name. measures: a function of (told, model) that gives numbers by name, beside the times of fitting and predicting."""

    def __init__(self, spark: SparkSession, path: str, datasets: dict[str, DataFrame], models: dict[str, Estimator], measures: Callable[[DataFrame, object], dict[str, float]], seeds: tuple[int, ...] = (0,), times: bool = True):
        self.spark, self.path, self.models, self.measures, self.seeds, self.times = spark, path, models, measures, seeds, times
        self.datasets = {k: d for k, d in datasets.items() if not d.isEmpty()}

    def cells(self) -> list[tuple[str, str, str, int]]:
        """(key, dataset, model, seed) of the grid."""
        of = {k: fingerprint(d) for k, d in self.datasets.items()}
        key = lambda d, m, s: hashlib.sha256(json.dumps([of[d], d, m, type(self.models[m]).__name__, params_of(self.models[m]), s]).encode()).hexdigest()[:16]
        return [(key(d, m, s), d, m, s) for d in self.datasets for m in self.models for s in self.seeds]

    def results(self) -> DataFrame:
        """The rows of all that is in the store, the last attempt of each key."""
        try:
            return self.spark.read.schema(RESULTS).option("recursiveFileLookup", True).parquet(self.path)
        except Exception as e:  # no folder yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], RESULTS)

    def done(self) -> set[str]:
        """Keys without an error: as many as the grid has cells at most."""
        keys = [c[0] for c in self.cells()]
        return {r.key for r in self.results().where(F.col("error").isNull() & F.col("key").isin(keys)).select("key").distinct().collect()}

    def run(self, parallelism: int = 4) -> int:
        """Does what isn't done; how many cells that were."""
        done = self.done()
        left = [c for c in self.cells() if c[0] not in done]
        if left:
            some = next(iter(self.datasets.values()))
            validation.at_once(some, [(f"bench-{c[0]}", lambda c=c: self._cell(*c)) for c in left], parallelism)
        return len(left)

    def _cell(self, key: str, dataset: str, model: str, seed: int) -> None:
        sc, estimator, data = self.spark.sparkContext, self.models[model], self.datasets[dataset]
        sc.setJobGroup(key, f"{model} on {dataset}, seed {seed}", True)
        found, error = {}, None
        try:
            if estimator.hasParam("seed"):
                estimator = estimator.copy({estimator.getParam("seed"): seed})
            began = time.monotonic()
            fitted = estimator.fit(data)
            between = time.monotonic()
            told = fitted.transform(data)
            found = self.measures(told, fitted)
            if self.times:
                found |= {"fit_seconds": between - began, "predict_seconds": time.monotonic() - between}
        except Exception as e:
            error = f"{type(e).__name__}: {str(e).splitlines()[0][:300] if str(e) else ''}"
        rows = [(key, dataset, model, seed, params_of(estimator), m, float(v) if v is not None else None, None) for m, v in found.items()] if error is None else [(key, dataset, model, seed, params_of(estimator), None, None, error)]
        # A folder a cell: writers into one folder at once would sweep away each other's unfinished files.
        self.spark.createDataFrame(rows, RESULTS).coalesce(1).write.mode("append").parquet(f"{self.path}/{key}")

    def table(self) -> DataFrame:
        """dataset, model, seed, measure, value of this grid's cells that are done."""
        keys = [c[0] for c in self.cells()]
        return self.results().where(F.col("error").isNull() & F.col("key").isin(keys)).select("dataset", "model", "seed", "measure", "value").distinct()

    def failures(self) -> DataFrame:
        """dataset, model, seed, error of this grid's cells that failed and weren't done since."""
        keys = [c[0] for c in self.cells()]
        ok = self.results().where("error IS NULL").select("key").distinct()
        return self.results().where(F.col("error").isNotNull() & F.col("key").isin(keys)).join(ok, "key", "left_anti").select("dataset", "model", "seed", "error").distinct()


def measured(label: str = G.LABEL, target: str | None = None, p: str | None = None) -> Callable[[DataFrame, object], dict[str, float]]:
    """Measures of a labelling by one aggregation: see validation.scores()."""

    def of(told: DataFrame, model) -> dict[str, float]:
        has = p if p in told.columns else None
        row = validation.scores(told.withColumn("fold", F.lit(0)), label, target, has).drop("fold").first()
        return {c: v for c, v in row.asDict().items()}

    return of


def mean_scores(table: DataFrame, measure: str) -> DataFrame:
    """dataset, model, score (mean over seeds) and spread (population deviation): what reports.ranked() and best_per_dataset() take."""
    return table.where(F.col("measure") == measure).groupBy("dataset", "model").agg(F.avg("value").alias("score"), F.stddev_pop("value").alias("spread"))


def counts_of_regimes(make: Callable[[int], Estimator], ks: tuple[int, ...]) -> dict[str, Estimator]:
    """Models of a study of numbers of regimes."""
    return {f"k={k}": make(k) for k in ks}


def combined(names: list[str], sizes: tuple[int, ...] = (2, 3), strategies: tuple[str, ...] = ("voting", "weighted", "bayesian")) -> list[tuple[str, tuple[str, ...], str]]:
    """(name, members, strategy) of all ensembles of so many members."""
    return [(f"{s}({'+'.join(c)})", c, s) for n in sizes for c in combinations(names, n) for s in strategies]


def table_rows(lines: DataFrame, text: str = "value") -> DataFrame:
    """cells (array) of each row of Markdown tables among lines of text; headings' rules are left out."""
    inner = F.regexp_extract(F.trim(text), r"^\|(.*)\|$", 1)
    rows = lines.where(F.trim(text).startswith("|") & F.trim(text).endswith("|") & ~F.trim(text).rlike(r"^[|\s:-]+$"))
    return rows.select(F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"))
