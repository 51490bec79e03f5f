"""Bars in delimited or Parquet files: with a header of usual names, or without one, and time in one column or in two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import standardized


def bar_files(spark: SparkSession, path: str | list[str], symbol: str | None = None, timeframe: str | None = None, *, kind: str = "csv", separator: str = ",", columns: list[str] | None = None, since: str | None = None, until: str | None = None, last: int | None = None) -> DataFrame:
    """Bars of the files at path, of a symbol and timeframe unless the files have columns so named.

    columns names the fields of files without a header; of fields "day" and "time" the time is put together. Bars from since
    to until, the last so many of each series if asked. Of equal times the last by file and line stays. Fields that aren't
    numbers are null; a file without any bar gives none.
    """
    if kind == "parquet":
        raw = spark.read.parquet(*([path] if isinstance(path, str) else path))
    elif kind == "csv":
        reader = spark.read.option("sep", separator)
        if columns:
            reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
        else:
            reader = reader.option("header", True)
        raw = reader.csv(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    low = {c.lower(): c for c in raw.columns}
    if {"day", "time"} <= set(low):
        raw = raw.withColumn("ts", F.concat_ws(" ", F.regexp_replace(F.col(low["day"]), r"[./]", "-"), F.col(low["time"]))).drop(low["day"], low["time"])
    bars = standardized(raw, symbol, timeframe).where("ts IS NOT NULL")
    if since is not None:
        bars = bars.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        bars = bars.where(F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    if last is not None:
        from .payloads import last_of

        bars = last_of(bars, last)
    return bars
