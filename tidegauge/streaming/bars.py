"""Structured Streaming: bars from ticks, sliding and session windows, duplicates, and a monitor of regimes with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.sources.bars import WIDTHS


def _ticks(ticks: DataFrame, symbol: str, ts: str, price: str, late: str) -> DataFrame:
    """symbol, ts as a timestamp with the watermark, price and volume."""
    return ticks.select(F.col(symbol).alias("symbol"), F.col(ts).cast("timestamp").alias("ts"), F.col(price).cast("double").alias("price")).where("price > 0").withWatermark("ts", late)


def _bar(w: Column, timeframe: str, df: DataFrame) -> DataFrame:
    out = df.groupBy("symbol", w.alias("w")).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return out.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def bars(ticks: DataFrame, timeframe: str = "H1", *, symbol: str, ts: str, price: str, late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks; a bar closes when the watermark passes its end, and ticks that are later than that are dropped. State is a row an open bar."""
    return _bar(F.window("ts", WIDTHS[timeframe]), timeframe, _ticks(ticks, symbol, ts, price, late))


def sliding(ticks: DataFrame, width: str = "4 hours", step: str = "1 hour", *, symbol: str, ts: str, price: str, late: str = "10 minutes") -> DataFrame:
    return _bar(F.window("ts", width, step), width, _ticks(ticks, symbol, ts, price, late))


def sessions(ticks: DataFrame, gap: str = "30 minutes", *, symbol: str, ts: str, price: str, late: str = "10 minutes") -> DataFrame:
    """Runs of ticks with no pause of gap: symbol, start, stop, ticks."""
    out = _ticks(ticks, symbol, ts, price, late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("ticks"))
    return out.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "ticks")


def distinct(bars_: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of bars that repeat within the watermark."""
    return bars_.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "timeframe", "ts"])


def into_store(bars_: DataFrame, store, checkpoint: str, **trigger):
    """A query that writes each batch's bars into a BarStore; a batch that runs again writes the same."""
    return bars_.writeStream.foreachBatch(lambda df, _: store.write(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")))).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def volatility_label(closes: np.ndarray, low: float, high: float) -> int:
    """0, 1 or 2 by the deviation of the returns of closes."""
    if len(closes) < 3:
        return 0
    r = np.diff(closes) / closes[:-1]
    sd = r.std(ddof=1)
    return int(sd > low) + int(sd > high)


ALERTS = "symbol string, ts timestamp, before int, after int"
STATE = "ts array<timestamp>, close array<double>, label int"


def monitor(bars_: DataFrame, label: Callable[[np.ndarray], int], n: int = 100) -> DataFrame:
    """An alert whenever the label of a symbol's last n closes changes. State: the last n closes and the label, a symbol."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, closes, now = ([], [], -1) if not state.exists else (list(state.get[0]), list(state.get[1]), state.get[2])
        rows = pd.concat(list(batches)).sort_values("ts")
        alerts = []
        for ts, close in zip(rows["ts"], rows["close"]):
            if held and ts <= held[-1]:
                continue
            held, closes = [*held, ts][-n:], [*closes, float(close)][-n:]
            new = label(np.array(closes))
            if now >= 0 and new != now:
                alerts.append((key[0], ts, now, new))
            now = new
        state.update((held, closes, now))
        yield pd.DataFrame(alerts, columns=["symbol", "ts", "before", "after"])

    return bars_.groupBy("symbol").applyInPandasWithState(step, ALERTS, STATE, "append", GroupStateTimeout.NoTimeout)


def to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and returns what it has written; in complete mode the last state only."""
    spark = df.sparkSession
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    else:
        query = df.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)
