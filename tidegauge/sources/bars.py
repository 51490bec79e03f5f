"""Price bars: the schema, bars from ticks, larger bars from smaller ones, tidying and checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
SCHEMA = "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
#: Timeframe codes and the width of their buckets; weeks and months start with the calendar's.
WIDTHS = {"M1": "1 minute", "M5": "5 minutes", "M15": "15 minutes", "M30": "30 minutes", "H1": "1 hour", "H4": "4 hours", "D": "1 day"}
CALENDAR = {"W": "week", "M": "month"}
#: Other names of bar columns.
ALIASES = {"open": ("Open", "OPEN", "o", "O"), "high": ("High", "HIGH", "h", "H"), "low": ("Low", "LOW", "l", "L"), "close": ("Close", "CLOSE", "c", "C"), "volume": ("Volume", "VOLUME", "v", "V", "Vol", "vol")}
TIME_NAMES = ("ts", "timestamp", "datetime", "date", "time")


def bucket(ts: str, timeframe: str) -> Column:
    """The start of the bucket that a time falls into."""
    if timeframe in CALENDAR:
        return F.date_trunc(CALENDAR[timeframe], F.col(ts)).cast("timestamp_ntz")
    if timeframe not in WIDTHS:
        raise ValueError(f"unknown timeframe {timeframe!r}")
    return F.window(ts, WIDTHS[timeframe])["start"].cast("timestamp_ntz")


def from_ticks(ticks: DataFrame, timeframe: str, *, symbol: str, ts: str, price: str, volume: Column, order: Column | None = None) -> DataFrame:
    """Bars of ticks; order tells first from last where ts doesn't. Ticks are summed up before they are shuffled, so a hot symbol is no hot task."""
    at = F.col(ts) if order is None else order
    p = F.col(price).cast("double")
    return (
        ticks.where(p > 0)
        .groupBy(F.col(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), bucket(ts, timeframe).alias("ts"))
        .agg(F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"), volume.cast("double").alias("volume"))
    )


def resampled(bars: DataFrame, timeframe: str) -> DataFrame:
    """Larger bars: first open, highest high, lowest low, last close, all volume; buckets without a bar don't appear."""
    return (
        bars.groupBy("symbol", bucket("ts", timeframe).alias("_ts"))
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("_ts").alias("ts"), *PRICES, "volume")
    )


def standardized(raw: DataFrame, symbol: str | None = None, timeframe: str | None = None, order: Column | None = None) -> DataFrame:
    """Bars by any of the usual column names: volume 0 where absent, numbers that don't parse null, of equal times that with the largest order.

    Where no order is given, that is the order of reading, which is defined within a file only; equal orders go by the bar's own values.
    """
    names = {c: k for k, own in ALIASES.items() for c in (k, *own) if c in raw.columns}
    missing = [p for p in PRICES if p not in names.values()]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    time = next((c for c in raw.columns if c.lower() in TIME_NAMES), None)
    if time is None:
        raise ValueError("no column with a time")
    first = {k: c for c, k in reversed(names.items())}
    out = raw.select(
        (F.lit(symbol) if symbol is not None else F.col("symbol")).alias("symbol"),
        (F.lit(timeframe) if timeframe is not None else F.col("timeframe")).alias("timeframe"),
        F.try_to_timestamp(F.col(time).cast("string")).cast("timestamp_ntz").alias("ts") if dict(raw.dtypes)[time] == "string" else F.col(time).cast("timestamp_ntz").alias("ts"),
        *[F.col(first[p]).try_cast("double").alias(p) for p in PRICES],
        (F.col(first["volume"]).try_cast("double") if "volume" in first else F.lit(0.0)).alias("volume"),
        (F.monotonically_increasing_id() if order is None else order).alias("_read"),
    )
    return last_write(out, F.struct("_read", *PRICES, "volume")).drop("_read")


def last_write(bars: DataFrame, order: Column) -> DataFrame:
    """Of the bars of a symbol, timeframe and ts the one with the largest order; one max_by a key, partly aggregated before the shuffle."""
    rest = [c for c in bars.columns if c not in ("symbol", "timeframe", "ts")]
    kept = bars.groupBy("symbol", "timeframe", "ts").agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return kept.select("symbol", "timeframe", "ts", "_row.*")


#: The rules of a sound bar, by name; a bar breaks one if its expression is true.
RULES = {
    "no_time": "ts IS NULL",
    "missing": "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR isnan(open) OR isnan(high) OR isnan(low) OR isnan(close)",
    "not_positive": "open <= 0 OR high <= 0 OR low <= 0 OR close <= 0",
    "high_too_low": "high < greatest(open, close, low)",
    "low_too_high": "low > least(open, close, high)",
    "negative_volume": "volume < 0",
}


def violations(bars: DataFrame) -> DataFrame:
    """A row (bars' columns and rule) for each rule that a bar breaks."""
    broken = F.filter(F.array(*[F.when(F.expr(r), F.lit(n)) for n, r in RULES.items()]), lambda x: x.isNotNull())
    return bars.withColumn("rule", F.explode(broken))


def violation_counts(bars: DataFrame) -> DataFrame:
    """One row: bars, and how many break each rule."""
    return bars.agg(F.count(F.lit(1)).alias("bars"), *[F.count_if(F.expr(r)).alias(n) for n, r in RULES.items()])


def validate(bars: DataFrame) -> DataFrame:
    """bars, or ValueError with the first rule that any breaks, or if there is none."""
    for c in ("ts", *PRICES):
        if c not in bars.columns:
            raise ValueError(f"no column {c}")
    told = violation_counts(bars if "volume" in bars.columns else bars.withColumn("volume", F.lit(0.0))).first()
    if not told["bars"]:
        raise ValueError("no bars")
    for rule in RULES:
        if told[rule]:
            raise ValueError(f"{told[rule]} bars: {rule}")
    return bars


def fetch_checked(symbol: str, timeframe: str, start=None, end=None, limit: int | None = None) -> None:
    """ValueError for parameters that no source can answer."""
    if not symbol or not timeframe:
        raise ValueError("symbol and timeframe are needed")
    if start is not None and end is not None and start > end:
        raise ValueError("start is after end")
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")


def latest(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each series."""
    w = Window.partitionBy("symbol", "timeframe").orderBy(F.desc("ts"))
    return bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def recent(bars: DataFrame, days: int) -> DataFrame:
    """Bars within days of the last bar of their series."""
    newest = F.max("ts").over(Window.partitionBy("symbol", "timeframe"))
    return bars.withColumn("_last", newest).where(F.col("ts") >= F.col("_last") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("_last")


def events_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events' values by event type; times are unique there."""
    return from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), "H1", symbol="event_type", ts="ts", price="value", volume=F.count(F.lit(1)))


def events_all_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of all events' values as one series."""
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("all", F.lit("(all)"))
    return from_ticks(ticks, "H1", symbol="all", ts="ts", price="value", volume=F.count(F.lit(1)))


def lines_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line prices by return flag; lines of a day are told apart by all their keys."""
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return from_ticks(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "D", symbol="l_returnflag", ts="l_shipdate", price="l_extendedprice", volume=F.sum("l_quantity"), order=order)
