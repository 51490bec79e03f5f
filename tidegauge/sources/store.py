"""A bar store: Parquet by symbol, timeframe and month, so that reading a series or a stretch of it reads only its files, and a late bar rewrites a month."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import shared_folder

from .bars import PRICES, SCHEMA, last_write, resampled


PARTS = ["symbol", "timeframe", "month"]


def _month(ts: Column) -> Column:
    """202401 for January 2024; 0 where there is no time."""
    return F.coalesce(100 * F.year(ts) + F.month(ts), F.lit(0)).cast("int")


class BarStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _files(self) -> DataFrame:
        return self.spark.read.schema(f"{SCHEMA}, month int").parquet(self.path)

    def read(self, symbol: str | None = None, timeframe: str | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """Bars, of one symbol or timeframe and from since to before until where given; none from a store that isn't there."""
        out = self._files() if self.exists() else self.spark.createDataFrame([], f"{SCHEMA}, month int")
        for name, value in (("symbol", symbol), ("timeframe", timeframe)):
            out = out.where(F.col(name) == value) if value is not None else out
        if since is not None:
            out = out.where((F.col("month") >= 100 * since.year + since.month) & (F.col("ts") >= F.lit(since.isoformat()).cast("timestamp_ntz")))
        if until is not None:
            out = out.where((F.col("month") <= 100 * until.year + until.month) & (F.col("ts") < F.lit(until.isoformat()).cast("timestamp_ntz")))
        return out.select("symbol", "timeframe", "ts", *PRICES, "volume")

    def write(self, bars: DataFrame, order: str | None = None) -> int:
        """Adds bars, a bar in place of one with its symbol, timeframe and ts; rewrites only the months of series that bars has. Returns the bars offered.

        Of bars of one time in `bars` that with the largest value of the column order stays.
        """
        more = [order] if order else []
        new = bars.select("symbol", "timeframe", "ts", *PRICES, "volume", *more).withColumn("month", _month(F.col("ts")))
        n, first, last = new.agg(F.count(F.lit(1)), F.min("month"), F.max("month")).first()
        if not n:
            return 0
        # The months' bounds prune folders before the join finds out which of them are touched.
        old = self._files().where(F.col("month").between(first, last)) if self.exists() else new.drop(*more).limit(0)
        old = old.join(new.select(PARTS).distinct(), PARTS, "left_semi")
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        # Of equal bars in one write the one with the largest values stays, whatever the order of its files.
        order = F.struct("_new", *PRICES, "volume") if order is None else F.struct("_new", F.col(order))
        merged = last_write(both.withColumn("_order", order), F.col("_order")).drop("_order", "_new", *more)
        # Read in full, into files that a lost executor can't take along, before the months' own files are replaced.
        shared_folder(self.spark)
        merged = merged.checkpoint()
        merged.repartition(*PARTS).sortWithinPartitions(*PARTS, "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(self.path)
        return n

    def aggregated(self, symbol: str, base: str, target: str) -> DataFrame:
        return resampled(self.read(symbol, base), target)

    def last_ts(self, symbol: str, timeframe: str) -> datetime | None:
        return self.read(symbol, timeframe).agg(F.max("ts")).first()[0]

    def series(self) -> DataFrame:
        """symbol, timeframe, bars, first and last time."""
        return self.read().groupBy("symbol", "timeframe").agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
