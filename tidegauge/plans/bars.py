"""Queries: bars, resampling, checks, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.operators import clean
from tidegauge.sources import bars as B

from .sql import EVENTS, LINES, RETURNS, SERIES, with_

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def named(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return named


@query(with_(EVENTS) + "SELECT * FROM bars")
def bars_event_1h(spark: SparkSession, d: str) -> DataFrame:
    return B.events_1h(spark, d)


@query(with_(LINES) + "SELECT * FROM bars")
def bars_line_1d(spark: SparkSession, d: str) -> DataFrame:
    return B.lines_1d(spark, d)


@query(with_(EVENTS) + "SELECT symbol, 'H4' AS timeframe, time_bucket(INTERVAL 4 HOUR, ts) AS ts, arg_min(open, b.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.ts) AS close, sum(volume) AS volume FROM bars b GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, ts)")
def bars_resampled_4h(spark: SparkSession, d: str) -> DataFrame:
    return B.resampled(B.events_1h(spark, d), "H4")


@query(with_(LINES) + "SELECT symbol, 'W' AS timeframe, date_trunc('week', ts)::TIMESTAMP AS ts, arg_min(open, b.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.ts) AS close, sum(volume) AS volume FROM bars b GROUP BY symbol, date_trunc('week', ts)")
def bars_resampled_week(spark: SparkSession, d: str) -> DataFrame:
    return B.resampled(B.lines_1d(spark, d), "W")


@query(with_(EVENTS) + "SELECT symbol, timeframe, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY ALL")
def series_catalog(spark: SparkSession, d: str) -> DataFrame:
    return B.events_1h(spark, d).groupBy("symbol", "timeframe").agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_BROKEN = "b AS (SELECT symbol, timeframe, ts, CASE WHEN hour(ts) = 5 THEN -open ELSE open END AS open, CASE WHEN hour(ts) = 7 THEN NULL ELSE high END AS high, low, CASE WHEN hour(ts) = 9 THEN 2 * high + 1 ELSE close END AS close, volume FROM bars)"


def _broken(bars: DataFrame) -> DataFrame:
    h = F.hour("ts")
    return bars.withColumns({"close": F.when(h == 9, 2 * F.col("high") + 1).otherwise(F.col("close")), "open": F.when(h == 5, -F.col("open")).otherwise(F.col("open")), "high": F.when(h == 7, None).otherwise(F.col("high"))})


_COUNTS = {"missing": "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL", "not_positive": "open <= 0 OR high <= 0 OR low <= 0 OR close <= 0", "high_too_low": "high < greatest(open, close, low)", "low_too_high": "low > least(open, close, high)", "negative_volume": "volume < 0", "no_time": "ts IS NULL"}


@query(with_(EVENTS, _BROKEN) + "SELECT count(*) AS bars, " + ", ".join(f"count(*) FILTER (WHERE {x}) AS {n}" for n, x in _COUNTS.items()) + " FROM b")
def bar_violation_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.violation_counts(_broken(B.events_1h(spark, d)))


@query(with_(EVENTS, _BROKEN) + " UNION ALL ".join(f"SELECT symbol, ts, '{n}' AS rule FROM b WHERE {x}" for n, x in _COUNTS.items()))
def bar_violations(spark: SparkSession, d: str) -> DataFrame:
    return B.violations(_broken(B.events_1h(spark, d))).select("symbol", "ts", "rule")


@query(with_(EVENTS) + "SELECT * FROM (SELECT symbol, timeframe, ts, open, high, low, close, volume FROM bars WHERE hour(ts) >= 6 UNION ALL SELECT symbol, timeframe, ts, open + 1, high + 1, low + 1, close + 1, volume FROM bars WHERE hour(ts) < 6)")
def bar_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Bars before six o'clock are offered again with other prices; the last write holds."""
    bars = B.events_1h(spark, d)
    again = bars.where(F.hour("ts") < 6).withColumns({c: F.col(c) + 1 for c in B.PRICES})
    return B.last_write(bars.withColumn("_o", F.lit(0)).unionByName(again.withColumn("_o", F.lit(1))), F.col("_o")).drop("_o")


@query(with_(EVENTS) + f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) AS n FROM bars) WHERE n <= 100")
def bars_latest(spark: SparkSession, d: str) -> DataFrame:
    return B.latest(B.events_1h(spark, d), 100)


@query(with_(EVENTS) + "SELECT * EXCLUDE (m) FROM (SELECT *, max(ts) OVER (PARTITION BY symbol, timeframe) AS m FROM bars) WHERE ts >= m - INTERVAL 7 DAYS")
def bars_recent(spark: SparkSession, d: str) -> DataFrame:
    return B.recent(B.events_1h(spark, d), 7)


@query(with_(LINES) + "SELECT symbol, timeframe, ts, open, high, low, close, volume FROM bars WHERE symbol IN ('A', 'R') AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'")
def bars_fetch_multiple(spark: SparkSession, d: str) -> DataFrame:
    return B.lines_1d(spark, d).where(F.col("symbol").isin("A", "R") & F.col("ts").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz")))


# Missing values.

_HOLES = "h AS (SELECT symbol, timeframe, ts, CASE WHEN hour(ts) % 5 = 0 THEN NULL ELSE close END AS x, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts) AS i FROM bars)"


def _holes(spark: SparkSession, d: str) -> DataFrame:
    return B.events_1h(spark, d).select("symbol", "timeframe", "ts", F.when(F.hour("ts") % 5 == 0, None).otherwise(F.col("close")).alias("x"))


_FFILL, _BFILL = f"last_value(x IGNORE NULLS) OVER ({SERIES} ROWS UNBOUNDED PRECEDING)", f"first_value(x IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(with_(EVENTS, _HOLES) + f"SELECT symbol, ts, {_FFILL} AS forward, {_BFILL} AS backward, coalesce(x, 0) AS zero, round(coalesce(x, avg(x) OVER (PARTITION BY symbol, timeframe)), 6) AS mean, coalesce(x, quantile_cont(x, 0.5) OVER (PARTITION BY symbol, timeframe)) AS median FROM h")
def impute_fills(spark: SparkSession, d: str) -> DataFrame:
    df = _holes(spark, d)
    out = df.withColumns({"forward": clean.forward("x"), "backward": clean.backward("x"), "zero": F.coalesce("x", F.lit(0.0)), "mean": F.round(clean.by_series("x", "mean"), 6), "median": clean.by_series("x", "median")})
    return out.select("symbol", "ts", "forward", "backward", "zero", "mean", "median")


@query(with_(EVENTS, _HOLES, f"p AS (SELECT *, {_FFILL} AS a, {_BFILL} AS b, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) AS ia, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM h)") + "SELECT symbol, ts, round(coalesce(CASE WHEN x IS NOT NULL THEN x WHEN a IS NOT NULL AND b IS NOT NULL THEN a + (b - a) * (i - ia) / (ib - ia) END, a, b), 6) AS x FROM p")
def impute_interpolate(spark: SparkSession, d: str) -> DataFrame:
    return clean.interpolated(_holes(spark, d), ["x"]).select("symbol", "ts", F.round("x", 6).alias("x"))


@query(with_(EVENTS, _HOLES) + "SELECT symbol, ts, x FROM h WHERE x IS NOT NULL")
def impute_drop(spark: SparkSession, d: str) -> DataFrame:
    return clean.handle_missing(_holes(spark, d), ["x"], "drop").select("symbol", "ts", "x")


# Scaling and outliers.

_GLOBAL = "PARTITION BY symbol, timeframe"
_SCALES = {"zscore": f"(close - avg(close) OVER g) / nullif(stddev_samp(close) OVER g, 0)", "standard": "(close - avg(close) OVER g) / nullif(stddev_pop(close) OVER g, 0)", "minmax": "(close - min(close) OVER g) / nullif(max(close) OVER g - min(close) OVER g, 0)", "robust": "(close - quantile_cont(close, 0.5) OVER g) / nullif(quantile_cont(close, 0.75) OVER g - quantile_cont(close, 0.25) OVER g, 0)"}


@query(with_(EVENTS) + "SELECT symbol, ts, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in _SCALES.items()) + f" FROM bars WINDOW g AS ({_GLOBAL})")
def scale_global(spark: SparkSession, d: str) -> DataFrame:
    df = B.events_1h(spark, d)
    out = df
    for m in _SCALES:
        out = clean.scaled(out, ["close"], m, by=W.KEYS, suffix=f"_{m}")
    return out.select("symbol", "ts", *[F.round(f"close_{m}", 6).alias(m) for m in _SCALES])


@query(with_(EVENTS, f"m AS (SELECT symbol, timeframe, quantile_cont(close, 0.5) AS med FROM bars GROUP BY ALL), mad AS (SELECT symbol, timeframe, quantile_cont(abs(close - med), 0.5) AS mad FROM bars JOIN m USING (symbol, timeframe) GROUP BY ALL)") + "SELECT symbol, ts, round((close - med) / nullif(1.4826 * mad, 0), 6) AS mad_scaled FROM bars JOIN m USING (symbol, timeframe) JOIN mad USING (symbol, timeframe)")
def scale_mad(spark: SparkSession, d: str) -> DataFrame:
    return clean.mad_scaled(B.events_1h(spark, d), "close", by=W.KEYS).select("symbol", "ts", F.round("close_mad", 6).alias("mad_scaled"))


_OUT = {"iqr": "close BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)", "zscore": "abs(close - mu) <= 3 * sd"}


@query(with_(EVENTS, "p AS (SELECT symbol, timeframe, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.75) AS q3, quantile_cont(close, 0.01) AS lo, quantile_cont(close, 0.99) AS hi, avg(close) AS mu, stddev_samp(close) AS sd FROM bars GROUP BY ALL)") + "SELECT symbol, ts, " + ", ".join(f"CASE WHEN {x} THEN close END AS {n}" for n, x in _OUT.items()) + ", round(greatest(least(close, hi), lo), 6) AS clipped FROM bars JOIN p USING (symbol, timeframe)")
def outliers(spark: SparkSession, d: str) -> DataFrame:
    df = B.events_1h(spark, d)
    out = clean.without_outliers(df.withColumn("iqr", F.col("close")), ["iqr"], "iqr", by=W.KEYS)
    out = clean.without_outliers(out.withColumn("zscore", F.col("close")), ["zscore"], "zscore", by=W.KEYS)
    out = clean.clipped(out.withColumn("clipped", F.col("close")), ["clipped"], by=W.KEYS)
    return out.select("symbol", "ts", "iqr", "zscore", F.round("clipped", 6).alias("clipped"))


@query(with_(EVENTS, RETURNS) + "SELECT count(*) AS n_rows, count(*) FILTER (WHERE returns IS NULL) AS missing, count(*) FILTER (WHERE isinf(returns)) AS infinite, stddev_samp(returns) = 0 AS is_constant, count(DISTINCT returns) AS n_distinct FROM r")
def feature_validation(spark: SparkSession, d: str) -> DataFrame:
    from tidegauge.functions import features as X

    told = clean.feature_report(X.with_returns(B.events_1h(spark, d)), ["returns"])
    return told.select("n_rows", "missing", "infinite", "is_constant", "n_distinct")


# The standard relational operators beside bars: joins by time, by range, semi and anti.


@query(with_(EVENTS, "e AS (SELECT event_id, event_type AS symbol, ts AS at, value FROM events WHERE value > 0)") + "SELECT event_id, b.ts AS bar_ts, b.close AS close FROM e ASOF LEFT JOIN bars b ON e.symbol = b.symbol AND e.at >= b.ts")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the last bar that began before it: a union in order of time, and the last bar seen."""
    ticks = spark.read.parquet(f"{d}/events.parquet").where("value > 0").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("at"))
    return clean.as_of(ticks, B.events_1h(spark, d).select("symbol", "ts", "close"), "symbol", "at", "ts").select("event_id", F.col("ts").alias("bar_ts"), "close")


@query("SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) GROUP BY ALL")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    big = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return spark.read.parquet(f"{d}/orders.parquet").join(big, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) GROUP BY ALL")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("c_custkey"))
    return spark.read.parquet(f"{d}/customer.parquet").join(orders, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))


@query(with_(EVENTS) + "SELECT coalesce(symbol, '(all)') AS symbol, coalesce(hour(ts), -1) AS hour, count(*) AS bars, round(sum(volume), 6) AS volume FROM bars GROUP BY GROUPING SETS ((symbol, hour(ts)), (symbol), ())")
def volume_rollup(spark: SparkSession, d: str) -> DataFrame:
    df = B.events_1h(spark, d).withColumn("hour", F.hour("ts"))
    out = df.rollup("symbol", "hour").agg(F.count(F.lit(1)).alias("bars"), F.round(F.sum("volume"), 6).alias("volume"))
    return out.select(F.coalesce("symbol", F.lit("(all)")).alias("symbol"), F.coalesce("hour", F.lit(-1)).cast("long").alias("hour"), "bars", "volume")

