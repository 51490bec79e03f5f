"""Queries: payloads made of bars and parsed again, bars by a service over the tables, the store, codes of services."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta

import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import scratch, settled
from tidegauge.sources import bars as B
from tidegauge.sources import payloads as P
from tidegauge.sources import service
from tidegauge.sources.store import BarStore
from tidegauge.streaming import bars as S

from .labels import EVENT_TYPES
from .sql import EVENTS, with_

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def named(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return named


def _daily(spark: SparkSession, d: str) -> DataFrame:
    """Bars with their day: a payload has a day's."""
    return B.events_1h(spark, d).withColumn("day", F.to_date("ts"))


def _text(c: str):
    return F.col(c).cast("string")


@query(with_(EVENTS) + "SELECT * FROM bars")
def payload_klines(spark: SparkSession, d: str) -> DataFrame:
    ms = (F.unix_timestamp(F.col("ts").cast("timestamp")) * 1000).cast("string")
    row = F.array(ms, *map(_text, B.PRICES), _text("volume"), F.lit("0"))
    return P.klines(_daily(spark, d).groupBy("symbol", "timeframe", "day").agg(F.to_json(F.collect_list(row)).alias("payload")))


@query(with_(EVENTS) + "SELECT * FROM bars")
def payload_ohlc(spark: SparkSession, d: str) -> DataFrame:
    row = F.array(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"), *map(_text, B.PRICES), F.lit("0"), _text("volume"), F.lit("1"))
    made = _daily(spark, d).groupBy("symbol", "timeframe", "day").agg(F.collect_list(row).alias("rows"))
    body = F.concat(F.lit('{"error":[],"result":{"'), F.upper("symbol"), F.lit('":'), F.to_json("rows"), F.lit(',"last":1}}'))
    return P.ohlc_by_pair(made.withColumn("payload", body))


@query(with_(EVENTS) + "SELECT * FROM bars WHERE hour(ts) <> 3")
def payload_candles(spark: SparkSession, d: str) -> DataFrame:
    """Candles of three o'clock are marked incomplete."""
    mid = F.struct(_text("open").alias("o"), _text("high").alias("h"), _text("low").alias("l"), _text("close").alias("c"))
    one = F.struct((F.hour("ts") != 3).alias("complete"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.col("volume"), mid.alias("mid"))
    return P.candles(_daily(spark, d).groupBy("symbol", "timeframe", "day").agg(F.to_json(F.struct(F.collect_list(one).alias("candles"))).alias("payload")))


@query(with_(EVENTS) + "SELECT * FROM bars")
def payload_series(spark: SparkSession, d: str) -> DataFrame:
    names = ("1. open", "2. high", "3. low", "4. close", "5. volume")
    one = F.create_map(*[x for n, c in zip(names, (*B.PRICES, "volume")) for x in (F.lit(n), _text(c))])
    made = _daily(spark, d).groupBy("symbol", "timeframe", "day").agg(F.map_from_entries(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), one))).alias("m"))
    return P.keyed_series(made.withColumn("payload", F.to_json(F.create_map(F.lit("Time Series (60min)"), F.col("m")))))


@query(with_(EVENTS) + "SELECT symbol, timeframe, ts, open, high, low, CASE WHEN hour(ts) = 0 THEN close + 1 ELSE close END AS close, volume FROM bars WHERE symbol = 'view'")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two writes into a store, the second with other closes at midnight; one series read back."""
    store, bars = BarStore(spark, scratch(spark, "store")), B.events_1h(spark, d)
    store.write(bars)
    store.write(bars.where(F.hour("ts") == 0).withColumn("close", F.col("close") + 1))
    return store.read("view", "H1")


#: Pairs of invented currencies by the tables' nations, in three spellings, with well-known ones among them.
_NAMES = "CASE n_nationkey % 5 WHEN 0 THEN 'BTC' WHEN 1 THEN 'eth' WHEN 2 THEN 'sol' ELSE upper(substr(n_name, 1, 3)) END || CASE n_nationkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '_' ELSE '-' END || CASE WHEN n_regionkey < 3 THEN 'USD' ELSE 'GBP' END"


@query(f"WITH a AS (SELECT n_nationkey, {_NAMES} AS symbol FROM nation), b AS (SELECT *, upper(symbol) AS u, regexp_replace(upper(symbol), '[_/-]', '', 'g') AS p FROM a) SELECT n_nationkey, symbol, replace(p, 'USD', 'USDT') AS klines, CASE WHEN starts_with(p, 'BTC') THEN 'XBTUSD' WHEN starts_with(p, 'ETH') THEN 'ETHUSD' WHEN starts_with(p, 'SOL') THEN 'SOLUSD' ELSE u END AS ohlc FROM b")
def symbol_codes(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.expr(_NAMES).alias("symbol"))
    return asked.select("n_nationkey", "symbol", P.symbol_code("klines", F.col("symbol")).alias("klines"), P.symbol_code("ohlc", F.col("symbol")).alias("ohlc"))


@query(with_(EVENTS, "g AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY symbol)") + "SELECT symbol, i::BIGINT AS page, a + INTERVAL 6000 MINUTE * i + CASE WHEN i > 0 THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END AS start, least(a + INTERVAL 6000 MINUTE * (i + 1), b) AS stop FROM g, (SELECT unnest(range(0, 100)) AS i) WHERE a + INTERVAL 6000 MINUTE * i <= b")
def time_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a hundred hours over the time of each series."""
    ends = B.events_1h(spark, d).groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    made = ends.select("symbol", F.posexplode(P.pages(F.col("a"), F.col("b"), 3600, 100)).alias("page", "p"))
    return made.select("symbol", F.col("page").cast("long").alias("page"), "p.start", "p.stop")


_FRAMES = "CASE s_suppkey % 4 WHEN 0 THEN 'M5' WHEN 1 THEN 'H4' WHEN 2 THEN '1d' ELSE 'S5' END"


@query(f"WITH a AS (SELECT s_suppkey, {_FRAMES} AS timeframe FROM supplier) SELECT a.*, klines, ohlc, candles FROM a JOIN (VALUES ('M5', '5m', '5', 'M5'), ('H4', '4h', '240', 'H4'), ('1d', '1d', '1440', 'D'), ('S5', 'S5', 'S5', 'S5')) AS t(timeframe, klines, ohlc, candles) USING (timeframe)")
def timeframe_codes(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.expr(_FRAMES).alias("timeframe"))
    return asked.select("s_suppkey", "timeframe", *[P.timeframe_code(k, F.col("timeframe")).alias(k) for k in ("klines", "ohlc", "candles")])


# A service over the tables: bars that Spark wrote, handed out a page a call in the form of each kind.


def rows_of(base: str, symbol: str, start: datetime, stop: datetime) -> list[tuple]:
    fs, path = pyarrow.fs.FileSystem.from_uri(base)
    at = pc.field("ts")
    got = ds.dataset(path, filesystem=fs, format="parquet").to_table(filter=(pc.field("symbol") == symbol) & (at >= start) & (at <= stop)).sort_by("ts")
    return list(zip(*[got[c].to_pylist() for c in ("ts", *B.PRICES, "volume")]))


def served(kind: str, symbol: str, timeframe: str, start: datetime, stop: datetime, base: str):
    """What a service of that kind answers."""
    rows = rows_of(base, symbol, start, stop)
    if kind == "rows":
        return rows
    seconds = lambda t: int(t.replace(tzinfo=UTC).timestamp())
    if kind == "klines":
        return json.dumps([[seconds(t) * 1000, *map(repr, v), seconds(t) * 1000 + 3_599_999, "0", 1, "0", "0", "0"] for t, *v in rows])
    if kind == "ohlc":
        return json.dumps({"error": [], "result": {symbol.upper(): [[seconds(t), *map(repr, v[:4]), "0", repr(v[4]), 1] for t, *v in rows], "last": 1}})
    if kind == "candles":
        return json.dumps({"candles": [{"complete": True, "time": t.strftime("%Y-%m-%dT%H:%M:%SZ"), "volume": v[4], "mid": dict(zip("ohlc", map(repr, v[:4])))} for t, *v in rows]})
    names = ("1. open", "2. high", "3. low", "4. close", "5. volume")
    return json.dumps({"Time Series (60min)": {t.strftime("%Y-%m-%d %H:%M:%S"): dict(zip(names, map(repr, v))) for t, *v in rows}})


def _base(spark: SparkSession, bars: DataFrame) -> tuple[str, datetime, datetime]:
    path = scratch(spark, "service")
    bars.write.parquet(path)
    return path, *spark.read.schema(bars.schema).parquet(path).agg(F.min("ts"), F.max("ts")).first()


for _kind in ("klines", "ohlc", "candles", "series"):

    def _fetched(spark: SparkSession, d: str, kind=_kind) -> DataFrame:
        path, first, last = _base(spark, B.events_1h(spark, d))
        return service.fetched(spark, kind, list(EVENT_TYPES), "H1", first.isoformat(), last.isoformat(), f"{__name__}.served", base=path, page="200")

    QUERIES[f"service_{_kind}"] = _fetched
    ORACLE[f"service_{_kind}"] = with_(EVENTS) + "SELECT * FROM bars"


@query(with_(EVENTS, "e AS (SELECT min(ts) + INTERVAL 100 HOUR AS a, min(ts) + INTERVAL 350 HOUR AS b FROM bars)") + "SELECT bars.*, 6 AS calls FROM bars, e WHERE symbol IN ('click', 'view') AND ts >= a AND ts < b AND close > 20")
def service_pushed(spark: SparkSession, d: str) -> DataFrame:
    """Two of the series between two times: six calls of a hundred hours each are made, not those of all series; closes are left to Spark."""
    path, first, last = _base(spark, B.events_1h(spark, d))
    spark.dataSource.register(service.BarsSource)
    setting = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        bars = spark.read.format("bars").options(kind="rows", symbols=",".join(EVENT_TYPES), timeframe="H1", start=first.isoformat(), end=last.isoformat(), fetcher=f"{__name__}.served", base=path, page="100", pushdown="true").load()
        a, b = first + timedelta(hours=100), first + timedelta(hours=350)
        asked = bars.where(F.col("symbol").isin("click", "view") & (F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)) & (F.col("close") > 20))
        calls = asked.rdd.getNumPartitions()
        return settled(asked, "pushed").withColumn("calls", F.lit(calls))
    finally:
        spark.conf.set(setting, before)


def now(base: str) -> datetime:
    """The service's clock: the hour after its last bar."""
    fs, path = pyarrow.fs.FileSystem.from_uri(base)
    last = pc.max(ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=["ts"])["ts"]).as_py()
    return last + timedelta(hours=1)


@query(with_(EVENTS) + "SELECT * FROM bars")
def service_stream(spark: SparkSession, d: str) -> DataFrame:
    """The service followed in two goes, the first of which saw half of the time and two bars before it without their last volume; a store takes in what comes again."""
    bars = B.events_1h(spark, d)
    first, last = bars.agg(F.min("ts"), F.max("ts")).first()
    half = first + (last - first) / 2
    path, _, _ = _base(spark, bars.where(F.col("ts") < F.lit(half)).withColumn("volume", F.when(F.col("ts") >= F.lit(half - timedelta(hours=2)), 0.0).otherwise(F.col("volume"))))
    store, state = BarStore(spark, scratch(spark, "store")), scratch(spark, "stream-state")
    spark.dataSource.register(service.BarsSource)
    for again in (False, True):
        if again:
            bars.write.mode("overwrite").parquet(path)
        stream = spark.readStream.format("bars").options(kind="rows", symbols=",".join(EVENT_TYPES), timeframe="H1", start=first.isoformat(), fetcher=f"{__name__}.served", clock=f"{__name__}.now", base=path, page="500", again="3").load()
        S.into_store(stream, store, state, availableNow=True).awaitTermination()
    return store.read().select("symbol", "timeframe", "ts", *B.PRICES, "volume")
