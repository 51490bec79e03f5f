"""Joins in time: rows with named periods that may overlap, and bars of several widths, each known only from its end on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.sources import bars as B
from tidegauge.sources.service import SECONDS


def in_periods(rows: DataFrame, periods: DataFrame, ts: str = "ts", start: str = "start", stop: str = "stop", bucket: str = "30 days") -> DataFrame:
    """rows joined with the periods that hold their ts (both ends included), a row for each such period.

    Periods are cut at the edges of buckets of time, and rows meet the pieces in their own bucket: an equality that Spark
    shuffles or broadcasts as it sees fit, with neither a cross join nor a bound on periods. A bucket of about a period's
    length keeps pieces few. Rows without ts, and periods without an end or that end before they start, meet nothing; columns
    of both must have names of their own.
    """
    seconds = _seconds(bucket)
    of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    pieces = periods.where(F.col(start) <= F.col(stop)).withColumn("_bucket", F.explode(F.sequence(of(start), of(stop))))
    met = rows.withColumn("_bucket", of(ts)).join(pieces, "_bucket")
    return met.where(F.col(ts).between(F.col(start), F.col(stop))).drop("_bucket")


def _seconds(width: str) -> int:
    n, unit = width.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit.rstrip("s")]


def with_wider(bars: DataFrame, timeframe: str, wider: list[str], columns: tuple[str, ...] = ("close", "volume")) -> DataFrame:
    """bars of a timeframe with columns of the last bar of each wider timeframe that had ended when the bar itself ended, as {column}_{timeframe}, and its start as ts_{timeframe}; null before the first.

    Bars of all widths pass once through one sort by the time they are known from, so that nothing of a bar that is still open
    is used. A series is one sort of a task, as in any window.
    """
    until = lambda width: F.col("ts") + F.make_dt_interval(secs=F.lit(float(SECONDS[width])))
    base = bars.where(F.col("timeframe") == timeframe)
    names = {w: [f"{c}_{w}" for c in ("ts", *columns)] for w in wider}
    null = {c: F.lit(None).cast(base.schema["ts" if c.startswith("ts_") else c.rsplit("_", 1)[0]].dataType) for cs in names.values() for c in cs}
    parts = [base.withColumns({"_at": until(timeframe), "_own": F.lit(1)} | null)]
    for w in wider:
        wide = B.resampled(base, w)
        mine = {f"{c}_{w}": F.col(c) for c in columns} | {f"ts_{w}": F.col("ts")}
        parts.append(wide.withColumns({"_at": until(w), "_own": F.lit(0), "timeframe": F.lit(timeframe)} | null | mine))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    upto = Window.partitionBy("symbol").orderBy("_at", "_own").rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.last(c, ignorenulls=True).over(upto) for cs in names.values() for c in cs}
    return every.withColumns(filled).where("_own = 1").drop("_at", "_own")
