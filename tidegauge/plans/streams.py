"""Queries: streams over the events table, run to their end; the results equal those of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import scratch
from tidegauge.sources import bars as B
from tidegauge.sources.store import BarStore
from tidegauge.streaming import bars as S
from tidegauge.streaming import monitor as M

from .features import _ema
from .sql import EVENTS, RETURNS, SERIES, roll, with_

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TICKS = {"symbol": "event_type", "ts": "ts", "price": "value"}


def query(sql: str | None = None):
    def named(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return named


def events(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _run(df: DataFrame, mode: str = "complete") -> DataFrame:
    spark = df.sparkSession
    return S.to_end(df, scratch(spark, "stream"), scratch(spark, "stream-state"), mode)


@query(with_(EVENTS) + "SELECT * FROM bars")
def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    return _run(S.bars(events(spark, d), **TICKS)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("WITH w AS (SELECT event_type AS symbol, value, ts, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 3 HOUR, time_bucket(INTERVAL 1 HOUR, ts), INTERVAL 1 HOUR)) AS s FROM events WHERE value > 0) SELECT symbol, s AS ts, arg_min(value, w.ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, w.ts) AS close, count(*)::DOUBLE AS volume FROM w GROUP BY symbol, s")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _run(S.sliding(events(spark, d), **TICKS)).withColumn("ts", F.col("ts").cast("timestamp_ntz")).drop("timeframe")


@query("WITH g AS (SELECT event_type AS symbol, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM events WHERE value > 0 WINDOW w AS (PARTITION BY event_type ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY ts) AS s FROM g) SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, count(*) AS ticks FROM s GROUP BY symbol, s")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    df = _run(S.sessions(events(spark, d), "2 hours", **TICKS))
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


@query(with_(EVENTS) + "SELECT * FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events WHERE value > 0) - INTERVAL 10 MINUTE")
def stream_bars_closed(spark: SparkSession, d: str) -> DataFrame:
    """In append mode: the bars whose end the watermark has passed, each once."""
    return _run(S.bars(events(spark, d), **TICKS), "append").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _twice(spark: SparkSession, d: str) -> DataFrame:
    """A stream of the hourly bars, each of them two times."""
    path = scratch(spark, "bars")
    bars = B.events_1h(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    bars.unionByName(bars).write.parquet(path)
    return spark.readStream.schema(bars.schema).parquet(path)


@query(with_(EVENTS) + "SELECT * FROM bars")
def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Bars that repeat within the watermark come once."""
    return _run(S.distinct(_twice(spark, d), "3650 days"), "append").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(with_(EVENTS) + "SELECT * FROM bars")
def stream_into_store(spark: SparkSession, d: str) -> DataFrame:
    """Batches upserted into a bar store, from which all series are read."""
    store = BarStore(spark, scratch(spark, "store"))
    S.into_store(_twice(spark, d), store, scratch(spark, "stream-state"), availableNow=True).awaitTermination()
    return store.read().select("symbol", "timeframe", "ts", "open", "high", "low", "close", "volume")


@query()
def stream_monitor(spark: SparkSession, d: str) -> DataFrame:
    bars = spark.read.parquet(f"{d}/events.parquet")
    path = scratch(spark, "bars")
    S._bar(F.window("ts", "1 hour"), "H1", bars.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price")).where("price > 0")).repartition("symbol").sortWithinPartitions("ts").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return _run(S.monitor(stream, lambda c: S.volatility_label(c, 1.0, 3.0), 20), "append")


_MONITOR = (
    EVENTS,
    RETURNS,
    f"a AS (SELECT *, {roll('stddev_samp({})', 'returns', 20)} AS vol, {_ema('close', 12)} AS fast, {_ema('close', 26)} AS slow, CASE WHEN returns IS NOT NULL THEN sqrt(list_reduce(list_prepend(1e-4, coalesce(list(returns) FILTER (returns IS NOT NULL) OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])), lambda v, x: 1e-5 + 0.1 * x * x + 0.85 * v)) END AS garch_vol FROM r)",
    "g AS (SELECT *, CASE WHEN vol IS NULL THEN 0 ELSE (vol > 1)::INT + (vol > 3)::INT END AS regime, CASE WHEN vol IS NULL THEN 0 ELSE least(abs(vol - 1), abs(vol - 3) / 3, 1) END AS confidence FROM a)",
    f"m AS (SELECT *, lag(regime) OVER ({SERIES}) AS before FROM g)",
    "k AS (SELECT * FROM m WHERE ts <= (SELECT max(ts) FROM bars) - INTERVAL 10 MINUTE)",
)


def _monitored(spark: SparkSession, d: str) -> DataFrame:
    """What the monitor says of the hourly bars as a stream, of those that the watermark has passed."""
    path = scratch(spark, "bars")
    B.events_1h(spark, d).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close").write.parquet(path)
    stream = M.own_session(spark).readStream.schema("symbol string, ts timestamp, close double").parquet(path)
    S.to_end(M.monitor(stream, M.by_cuts("vol", (1.0, 3.0)), silent="3650 days"), out := scratch(spark, "stream"), scratch(spark, "stream-state"))
    return spark.read.schema(M.OUT).parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(with_(*_MONITOR) + "SELECT symbol, ts, round(returns, 6) AS returns, round(vol, 6) AS vol, round(fast, 6) AS fast, round(slow, 6) AS slow, round(fast - slow, 6) + 0.0 AS macd, round(garch_vol, 6) AS garch_vol, regime, round(confidence, 6) AS confidence FROM k")
def monitor_features(spark: SparkSession, d: str) -> DataFrame:
    rows = _monitored(spark, d)
    return rows.select("symbol", "ts", *[(F.round(c, 6) + 0.0).alias(c) for c in M.FEATURES], "regime", F.round("confidence", 6).alias("confidence"))


@query(with_(*_MONITOR) + "SELECT symbol, ts, before, regime AS after, round(confidence, 6) AS confidence FROM k WHERE before <> regime")
def monitor_alerts(spark: SparkSession, d: str) -> DataFrame:
    return M.alerts(_monitored(spark, d)).withColumn("confidence", F.round("confidence", 6))
