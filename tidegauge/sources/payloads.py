"""Bars from the payloads of market data services: JSON strings in a column, parsed by DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bars import PRICES, latest

_NAMES = (*PRICES, "volume")


def _typed(df: DataFrame) -> DataFrame:
    return df.select("symbol", "timeframe", F.col("ts").cast("timestamp_ntz").alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in _NAMES])


def klines(df: DataFrame, payload: str = "payload") -> DataFrame:
    """symbol, timeframe and a payload of rows [open time in ms, open, high, low, close, volume, ...]."""
    rows = df.select("symbol", "timeframe", F.explode(F.from_json(payload, "array<array<string>>")).alias("r"))
    return _typed(rows.select("symbol", "timeframe", F.timestamp_millis(F.get("r", 0).cast("long")).alias("ts"), *[F.get("r", i).alias(c) for i, c in enumerate(_NAMES, 1)]))


def ohlc_by_pair(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A payload {"error": [..], "result": {pair: rows, "last": ..}}, rows [time in s, open, high, low, close, vwap, volume, count]; the first pair's."""
    result = F.from_json(F.get_json_object(payload, "$.result"), "map<string,string>")
    first = F.element_at(F.map_values(F.map_filter(result, lambda k, v: k != "last")), 1)
    rows = df.select("symbol", "timeframe", F.explode(F.from_json(first, "array<array<string>>")).alias("r"))
    at = dict(zip(_NAMES, (1, 2, 3, 4, 6)))
    return _typed(rows.select("symbol", "timeframe", F.timestamp_seconds(F.get("r", 0).cast("long")).alias("ts"), *[F.get("r", i).alias(c) for c, i in at.items()]))


def candles(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A payload {"candles": [{complete, time, volume, mid: {o, h, l, c}}]}; incomplete candles and those without mid are left out."""
    kind = "struct<candles: array<struct<complete: boolean, time: string, volume: double, mid: struct<o: string, h: string, l: string, c: string>>>>"
    rows = df.select("symbol", "timeframe", F.explode(F.from_json(payload, kind)["candles"]).alias("r")).where("r.complete AND r.mid IS NOT NULL")
    return _typed(rows.select("symbol", "timeframe", F.try_to_timestamp("r.time").alias("ts"), F.col("r.mid.o").alias("open"), F.col("r.mid.h").alias("high"), F.col("r.mid.l").alias("low"), F.col("r.mid.c").alias("close"), F.col("r.volume").alias("volume")))


def keyed_series(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A payload with a key like "Time Series (..)" of {time: {"1. open": .., .., "5. volume" or "6. volume"}}; a message of an error or a limit raises."""
    top = F.from_json(payload, "map<string,string>")
    told = F.coalesce(F.try_element_at(top, F.lit("Error Message")), F.try_element_at(top, F.lit("Note")), F.try_element_at(top, F.lit("Information")))
    body = F.element_at(F.map_values(F.map_filter(top, lambda k, v: k.contains("Time Series"))), 1)
    checked = F.when(told.isNotNull(), F.raise_error(told)).otherwise(body)
    rows = df.select("symbol", "timeframe", F.explode(F.from_json(checked, "map<string,map<string,string>>")).alias("ts", "r"))
    field = lambda name: F.get(F.map_values(F.map_filter("r", lambda k, v: k.endswith(name) & ~k.contains("adjusted"))), 0)
    return _typed(rows.select("symbol", "timeframe", F.try_to_timestamp("ts").alias("ts"), *[field(c).alias(c) for c in _NAMES]))


PARSERS = {"klines": klines, "ohlc": ohlc_by_pair, "candles": candles, "series": keyed_series}


#: Minutes of the timeframes that services share, by our code.
MINUTES = {"M1": 1, "M5": 5, "M15": 15, "M30": 30, "H1": 60, "H4": 240, "D": 1440, "W": 10080}
#: The short form of each: 1m, 1h, 1d.
SHORT = {k: f"{k[1:] or 1}{k[0].lower()}" for k in MINUTES}
# The granularities of the candle service, other names for some, and the names that the series service takes.
GRANULARITIES = ("S5", "S10", "S15", "S30", "M1", "M2", "M4", "M5", "M10", "M15", "M30", "H1", "H2", "H3", "H4", "H6", "H8", "H12", "D", "W", "M")
GRANULARITY_NAMES = {"1min": "M1", "5min": "M5", "15min": "M15", "30min": "M30", "1h": "H1", "4h": "H4", "1d": "D", "1w": "W", "1m": "M"}
SERIES_NAMES = {
    "1min": "1min", "5min": "5min", "15min": "15min", "30min": "30min", "60min": "60min", "1h": "1h", "1hour": "1h", "hour": "1h", "h": "1h",
    "1d": "1d", "1day": "1d", "day": "1d", "d": "1d", "daily": "1d", "1w": "1w", "1week": "1w", "week": "1w", "w": "1w", "weekly": "1w",
    "1m": "1m", "1month": "1m", "month": "1m", "m": "1m", "monthly": "1m",
}
TIMEFRAMES = {
    "klines": SHORT | {v: v for v in SHORT.values()},
    "ohlc": {name: str(m) for k, m in MINUTES.items() for name in (k, SHORT[k])},
    "candles": {g: g for g in GRANULARITIES} | GRANULARITY_NAMES,
    "series": SERIES_NAMES,
}


def timeframe_code(kind: str, timeframe: Column) -> Column:
    """A service's code for a timeframe; unknown ones pass through, or raise for the series service, which takes no others."""
    asked = F.lower(timeframe) if kind == "series" else timeframe
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in TIMEFRAMES[kind].items() for x in kv]), asked)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown timeframe "), timeframe)).cast("string") if kind == "series" else timeframe)


# What the OHLC service calls the pairs of these currencies.
PAIRS = {"BTC": "XBTUSD", "ETH": "ETHUSD", "XRP": "XRPUSD", "SOL": "SOLUSD"}


def symbol_code(kind: str, symbol: Column) -> Column:
    """A symbol as a service writes it."""
    upper = F.upper(symbol)
    plain = F.regexp_replace(upper, "[_/-]", "")
    if kind == "klines":
        return F.when(plain.contains("USD") & ~plain.endswith("USDT"), F.replace(plain, F.lit("USD"), F.lit("USDT"))).otherwise(plain)
    if kind == "ohlc":
        out = upper
        for currency, pair in PAIRS.items():
            out = F.when(plain.startswith(currency), pair).otherwise(out)
        return out
    return symbol


def traded(df: DataFrame, payload: str = "payload") -> DataFrame:
    """symbol: the ones of a payload {"symbols": [{symbol, status}]} that are traded, in order."""
    rows = df.select(F.explode(F.from_json(payload, "struct<symbols: array<struct<symbol: string, status: string>>>")["symbols"]).alias("r"))
    return rows.where("r.status = 'TRADING'").select("r.symbol").distinct().orderBy("symbol")


def pair_names(df: DataFrame, payload: str = "payload") -> DataFrame:
    """symbol: the keys of a payload {"result": {pair: ..}}, in order."""
    keys = F.map_keys(F.from_json(F.get_json_object(payload, "$.result"), "map<string,string>"))
    return df.select(F.explode(keys).alias("symbol")).distinct().orderBy("symbol")


def pages(start: Column, stop: Column, seconds: int, most: int = 5000) -> Column:
    """Pages (start, stop) of at most `most` bars of that many seconds; a page starts a second after the one before stops."""
    width = F.make_dt_interval(secs=F.lit(float(seconds * most)))
    begins = F.sequence(start, stop, width)
    return F.transform(begins, lambda b, i: F.struct(F.when(i > 0, b + F.expr("INTERVAL 1 SECOND")).otherwise(b).alias("start"), F.least(b + width, stop).alias("stop")))


def last_of(bars: DataFrame, limit: int | None) -> DataFrame:
    return bars if limit is None else latest(bars, limit)
