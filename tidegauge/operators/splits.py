"""Folds over a series: the ranges of row numbers of each fold are a small table, and rows join it by range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.windows import series

from .regimes import LABEL, with_runs

RANGES = "fold int, role string, lo long, hi long"


def numbered(df: DataFrame) -> DataFrame:
    """df with row_no, from 0 on in each series."""
    return df.withColumn("row_no", (F.row_number().over(series()) - 1).cast("long"))


def time_series_ranges(n: int, folds: int = 5, test_share: float | None = None, gap: int = 0, window: int | None = None) -> list[tuple[int, str, int, int]]:
    """(fold, role, first row, last row): test parts follow each other up to the end; training is all before, or the last `window` rows, less the gap; 10 rows at least."""
    size = int(n * test_share) if test_share else n // (folds + 1)
    out = []
    for k in range(folds):
        start = n - (folds - k) * size
        end = start - gap - 1
        first = 0 if window is None else max(0, end - window + 1)
        if size > 0 and end - first + 1 >= 10:
            out += [(k, "train", first, end), (k, "test", start, start + size - 1)]
    return out


def walk_forward_ranges(n: int, train: int = 252, test: int = 63, step: int = 21, anchored: bool = False) -> list[tuple[int, str, int, int]]:
    out, k, at = [], 0, 0
    while at + train + test < n:
        out += [(k, "train", 0 if anchored else at, at + train - 1), (k, "test", at + train, at + train + test - 1)]
        k, at = k + 1, at + step
    return out


def purged_ranges(n: int, folds: int = 5, purge: int = 10, embargo: int = 0) -> list[tuple[int, str, int, int]]:
    """Contiguous test parts; training is what is further than purge rows from the part; embargo trims the end of the test part."""
    out, at = [], 0
    for k in range(folds):
        size = n // folds + (k < n % folds)
        lo, hi = at, at + size - 1
        if lo - purge > 0:
            out.append((k, "train", 0, lo - purge - 1))
        if hi + purge < n - 1:
            out.append((k, "train", hi + purge + 1, n - 1))
        if hi - embargo >= lo:
            out.append((k, "test", lo, hi - embargo))
        at += size
    return out


def assigned(df: DataFrame, ranges: list[tuple[int, str, int, int]]) -> DataFrame:
    """A row of df (with row_no) for each fold and role that it has; ranges are a few rows a fold and are broadcast."""
    spark: SparkSession = df.sparkSession
    table = spark.createDataFrame(ranges, RANGES)
    return df.join(F.broadcast(table), F.col("row_no").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def regime_aware(df: DataFrame, folds: int = 5, least: int = 2, label: str = LABEL) -> DataFrame:
    """Rows of a single series by fold and role: whole runs of equal labels are dealt to folds in order, a fold's runs are its test part.

    A fold is left out if a label has fewer than `least` rows in its training part.
    """
    df = with_runs(numbered(df), label)
    fold = F.pmod(F.col("run"), F.lit(folds)).cast("int")
    every = df.withColumn("_own", fold).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("role", F.when(F.col("_own") == F.col("fold"), "test").otherwise("train"))
    few = every.groupBy("fold", label).agg(F.count_if(F.col("role") == "train").alias("n")).where(F.col("n") < least).select("fold").distinct()
    return every.join(F.broadcast(few), "fold", "left_anti").drop("_own", "run")
