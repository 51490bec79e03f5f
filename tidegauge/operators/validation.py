"""Cross-validation of any estimator by any strategy of splitting: folds are a table that rows join by range, fits are concurrent jobs, and measures of all folds one result.

    rows = by_series(df, lambda n: splits.walk_forward_ranges(n))
    scores(cross_predicted(rows, estimator), "regime", "target")

A strategy is a function from a table to its rows with fold and role (train or test), a row once for each fold and role that
it has. Each fold's estimator is fitted in a thread of its own, in a scheduler pool of its own, over the fold's training rows;
predictions of all folds are one table, and all measures come from one aggregation over it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.windows import KEYS

from . import regimes as G
from . import splits

Strategy = Callable[[DataFrame], DataFrame]


def by_series(df: DataFrame, ranges: Callable[[int], list[tuple[int, str, int, int]]], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows of each series by fold and role, by the ranges that a strategy gives for its number of rows. Ranges are a table that series meet by their keys."""
    rows = splits.numbered(df)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(*[getattr(r, k) for k in keys], *one) for r in b.itertuples() for one in ranges(int(r.n))]
            yield pd.DataFrame(out, columns=[*keys, "fold", "role", "lo", "hi"])

    table = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).mapInPandas(made, f"{schema}, fold int, role string, lo long, hi long")
    a, b = rows.alias("a"), table.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.join(b, same & F.col("row_no").between(F.col("lo"), F.col("hi"))).select("a.*", "fold", "role")


def strategy(name: str, **options) -> Strategy:
    """time_series, walk_forward, purged (over each series), or regime_aware (over one series)."""
    ranges = {"time_series": splits.time_series_ranges, "walk_forward": splits.walk_forward_ranges, "purged": splits.purged_ranges}
    if name == "regime_aware":
        return lambda df: splits.regime_aware(df, **options)
    if name not in ranges:
        raise ValueError(f"unknown strategy {name!r}")
    return lambda df: by_series(df, lambda n: ranges[name](n, **options))


def at_once(df: DataFrame, jobs: list[tuple[str, Callable]], parallelism: int) -> list:
    """What the jobs give, each run in a thread and a scheduler pool by its name, that many at a time."""
    sc = df.sparkSession.sparkContext

    def run(name: str, job: Callable):
        sc.setLocalProperty("spark.scheduler.pool", name)
        try:
            return job()
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(parallelism) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(df.sparkSession)(run), *j) for j in jobs]]


def cross_predicted(rows: DataFrame, estimator: Estimator, parallelism: int = 4) -> DataFrame:
    """Test rows of all folds, with what each fold's model says of them. Folds without rows to learn from or to test are left out."""
    parts = rows.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b")).collect()  # a row a fold
    folds = sorted(r.fold for r in parts if r.a and r.b)
    if not folds:
        raise ValueError("no fold has rows to learn from and to test")
    of = lambda k, role: rows.where((F.col("fold") == k) & (F.col("role") == role)).drop("role")
    models = at_once(rows, [(f"fold-{k}", lambda k=k: estimator.fit(of(k, "train"))) for k in folds], parallelism)
    return reduce(DataFrame.unionByName, [m.transform(of(k, "test")) for k, m in zip(folds, models)])


def scores(told: DataFrame, label: str = G.LABEL, target: str | None = None, p: str | None = None, by: str = "fold") -> DataFrame:
    """A row a fold: n_rows, labels, persistence, entropy of labels, and with a target accuracy, purity and the adjusted Rand index, with probabilities confidence."""
    keys = [k for k in KEYS if k in told.columns]
    steps = told.withColumn("_next", F.lead(label).over(Window.partitionBy(by, *keys).orderBy("ts")))
    pair = [label] + ([target] if target else [])
    cells = steps.groupBy(by, *pair).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_next") == F.col(label)).alias("same"), F.count("_next").alias("steps"),
        *([F.sum(F.array_max(p)).alias("sure")] if p else []),
    )
    two = lambda n: n * (n - 1) / 2.0
    per = cells.groupBy(by, label).agg(F.sum("n").alias("n"), F.max("n").alias("top"), *[F.sum(c).alias(c) for c in ("same", "steps", *(["sure"] if p else []))], F.sum(two(F.col("n"))).alias("both"), *([F.sum(F.when(F.col(label) == F.col(target), F.col("n")).otherwise(0)).alias("hit")] if target else []))
    n, share = F.sum("n").over(Window.partitionBy(by)), F.col("n") / F.col("_all")
    per = per.withColumn("_all", n)
    out = per.groupBy(by).agg(
        F.first("_all").alias("n_rows"), F.count(F.lit(1)).alias("labels"), (F.sum("same") / F.nullif(F.sum("steps"), F.lit(0))).alias("persistence"), (-F.sum(share * F.ln(share))).alias("entropy"),
        *([(F.sum("hit") / F.first("_all")).alias("accuracy"), (F.sum("top") / F.first("_all")).alias("purity"), F.sum("both").alias("_both"), F.sum(two(F.col("n"))).alias("_rows")] if target else []),
        *([(F.sum("sure") / F.first("_all")).alias("confidence")] if p else []),
    )
    if target:
        columns = cells.groupBy(by, target).agg(F.sum("n").alias("n")).groupBy(by).agg(F.sum(two(F.col("n"))).alias("_columns"))
        chance = F.col("_rows") * F.col("_columns") / F.nullif(two(F.col("n_rows")), F.lit(0.0))
        most = (F.col("_rows") + F.col("_columns")) / 2
        rand = F.when(most == chance, 1.0).otherwise((F.col("_both") - chance) / (most - chance))
        out = out.join(columns, by).withColumn("adjusted_rand", rand).drop("_both", "_rows", "_columns")
    return out


def cross_validated(df: DataFrame, estimator: Estimator, split: Strategy, target: str | None = None, label: str = G.LABEL, p: str | None = None, parallelism: int = 4) -> DataFrame:
    """scores() of an estimator over the folds of a strategy."""
    return scores(cross_predicted(split(df), estimator, parallelism), label, target, p)


class _Rule(HasInputCol, HasPredictionCol):
    k = Param(Params._dummy(), "k", "number of regimes", TypeConverters.toInt)


class QuantileRule(Estimator, _Rule, DefaultParamsReadable, DefaultParamsWritable):
    """Regimes 0 to k - 1 by the equal quantiles that a column had where it was fitted: the plainest rule that learns."""

    @keyword_only
    def __init__(self, *, inputCol="vol", predictionCol=G.LABEL, k=3):
        super().__init__()
        self._setDefault(inputCol="vol", predictionCol=G.LABEL, k=3)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> QuantileRuleModel:
        k = self.getOrDefault(self.k)
        cuts = df.agg(F.percentile(self.getInputCol(), F.array(*[F.lit(i / k) for i in range(1, k)]))).first()[0]
        return self._copyValues(QuantileRuleModel(cuts=json.dumps(cuts or [])))


class QuantileRuleModel(Model, _Rule, DefaultParamsReadable, DefaultParamsWritable):
    cuts = Param(Params._dummy(), "cuts", "the quantiles, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, cuts="[]"):
        super().__init__()
        self._setDefault(inputCol="vol", predictionCol=G.LABEL, k=3)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        x = F.col(self.getInputCol())
        above = reduce(lambda a, c: a + (x > F.lit(c)).cast("int"), json.loads(self.getOrDefault(self.cuts)), F.lit(0))
        return df.withColumn(self.getPredictionCol(), above.cast("int"))
