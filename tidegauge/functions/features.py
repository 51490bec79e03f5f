"""Returns, momentum, rolling statistics, volatility and technical indicators as columns added to bars."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import col, corr, correlation, div, kurtosis, last_rows, quantile, roll, root, series, skewness, so_far

YEAR = 252
ANNUAL = math.sqrt(YEAR)


def _log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(col(x), n).over(series())


def returns(x: str | Column = "close", method: str = "simple", periods: int = 1) -> Column:
    if method not in ("simple", "log"):
        raise ValueError(f"unknown method {method!r}")
    ratio = div(col(x), lag(x, periods))
    return ratio - 1 if method == "simple" else _log(ratio)


def with_returns(df: DataFrame, x: str = "close", method: str = "simple", periods: int = 1, out: str = "returns") -> DataFrame:
    return df.withColumn(out, returns(x, method, periods))


def volatility(x: str = "returns", n: int = 20, annualize: bool = False, days: int = YEAR) -> Column:
    return roll(F.stddev, x, n) * (math.sqrt(days) if annualize else 1.0)


def momentum(x: str = "close", short: int = 10, long: int = 30) -> Column:
    return div(roll(F.avg, x, short) - roll(F.avg, x, long), roll(F.avg, x, long))


def with_lags(df: DataFrame, n: int, columns: list[str] | None = None) -> DataFrame:
    columns = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({f"{c}_lag{k}": lag(c, k) for c in columns for k in range(1, n + 1)})


ROLLING = {"mean": F.avg, "std": F.stddev, "var": F.variance, "min": F.min, "max": F.max, "sum": F.sum}


def rolling(x: str, n: int, operation: str, min_periods: int | None = None, q: float = 0.5) -> Column:
    """mean, std, var, min, max, sum, median, quantile, skew or kurt of the last n rows."""
    if operation in ROLLING:
        return roll(ROLLING[operation], x, n, min_periods)
    if operation in ("median", "quantile"):
        return roll(lambda c: F.percentile(c, F.lit(q if operation == "quantile" else 0.5)), x, n, min_periods)
    if operation in ("skew", "kurt"):
        return (skewness if operation == "skew" else kurtosis)(x, n)
    raise ValueError(f"unknown operation {operation!r}")


def rolling_statistics(df: DataFrame, x: str = "close", n: int = 20) -> DataFrame:
    return df.withColumns({f"{name}_{n}": rolling(x, n, op) for name, op in (("mean", "mean"), ("std", "std"), ("min", "min"), ("max", "max"), ("median", "median"), ("skewness", "skew"), ("kurtosis", "kurt"))})


def rolling_zscore(x: str = "close", n: int = 20) -> Column:
    return div(col(x) - roll(F.avg, x, n), roll(F.stddev, x, n))


def rolling_minmax(x: str, n: int) -> Column:
    low = roll(F.min, x, n)
    return div(col(x) - low, roll(F.max, x, n) - low)


def with_rolling_robust(df: DataFrame, x: str, n: int, out: str = "robust") -> DataFrame:
    """(x - median) / (1.4826 * MAD), deviations taken from each row's own rolling median."""
    df = df.withColumn("_median", quantile(x, 0.5, n)).withColumn("_off", F.abs(F.col(x) - F.col("_median")))
    return df.withColumn(out, div(F.col(x) - F.col("_median"), 1.4826 * quantile("_off", 0.5, n))).drop("_median", "_off")


def information_ratio(x: str, benchmark: str, n: int = YEAR) -> Column:
    excess = F.col(x) - F.col(benchmark)
    return div(roll(F.avg, excess, n), roll(F.stddev, excess, n)) * ANNUAL


def autocorrelation(df: DataFrame, x: str = "returns", n: int = 20, k: int = 1, out: str = "autocorr") -> DataFrame:
    """Correlation of the last n values with those k before; nulls count as 0; from row n + k - 1 of a series on."""
    df = df.withColumns({"_x": F.coalesce(F.col(x), F.lit(0.0)), "_row": F.row_number().over(series())}).withColumn("_y", lag("_x", k))
    w = last_rows(n)
    return df.withColumn(out, F.when(F.col("_row") >= n + k, corr("_x", "_y", w))).drop("_x", "_y", "_row")


def cross_correlation(df: DataFrame, x: str, y: str, n: int = 20, k: int = 0, out: str = "cross_corr") -> DataFrame:
    """Correlation of x with y of k rows before; a negative k looks ahead."""
    df = df.withColumn("_y", lag(y, k) if k >= 0 else F.lead(y, -k).over(series()))
    return df.withColumn(out, correlation(x, "_y", n)).drop("_y")


def jarque_bera(x: str = "returns", n: int = 20) -> Column:
    """n/6 (S^2 + K^2/4) with population moments of at least 3 values, in full windows."""
    x, w = col(x), last_rows(n)
    m = F.count(x).over(w)
    ready = (F.count(F.lit(1)).over(w) == n) & (m >= 3) & (F.var_pop(x).over(w) > 0)
    return F.when(ready, m / 6 * (F.pow(F.skewness(x).over(w), 2) + F.pow(F.kurtosis(x).over(w), 2) / 4))


# Volatility estimators, annualised.


def parkinson(n: int = 20) -> Column:
    return root(roll(F.avg, F.pow(_log(div(col("high"), col("low"))), 2), n) / (4 * math.log(2))) * ANNUAL


def garman_klass(n: int = 20) -> Column:
    """With close to previous close, whose first value counts as 0; null where the estimate is negative."""
    close = F.coalesce(_log(div(col("close"), lag("close"))), F.lit(0.0))
    term = 0.5 * F.pow(_log(div(col("high"), col("low"))), 2) - (2 * math.log(2) - 1) * F.pow(close, 2)
    return term


def rogers_satchell_term() -> Column:
    h, l, o, c = map(col, ("high", "low", "open", "close"))
    return _log(div(h, c)) * _log(div(h, o)) + _log(div(l, c)) * _log(div(l, o))


def with_volatility(df: DataFrame, n: int = 20) -> DataFrame:
    """parkinson, garman_klass, rogers_satchell, yang_zhang, close_to_close and vol_of_vol (of the latter)."""
    o, c = col("open"), col("close")
    overnight = F.coalesce(_log(div(o, lag("close"))), F.lit(0.0))
    df = df.withColumns({"_gk": garman_klass(n), "_rs": rogers_satchell_term(), "_on": F.pow(overnight, 2), "_oc": F.pow(_log(div(c, o)), 2), "_lr": returns("close", "log")})
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    df = df.withColumns({
        f"parkinson_{n}": parkinson(n),
        f"garman_klass_{n}": root(roll(F.avg, "_gk", n)) * ANNUAL,
        f"rogers_satchell_{n}": root(roll(F.avg, "_rs", n)) * ANNUAL,
        f"yang_zhang_{n}": root(roll(F.avg, "_on", n) + k * roll(F.avg, "_oc", n) + (1 - k) * roll(F.avg, "_rs", n)) * ANNUAL,
        f"close_to_close_{n}": roll(F.stddev, "_lr", n) * ANNUAL,
    })
    return with_vol_of_vol(df, f"close_to_close_{n}", n).drop("_gk", "_rs", "_on", "_oc", "_lr")


def with_vol_of_vol(df: DataFrame, x: str, n: int = 20, out: str | None = None) -> DataFrame:
    """Rolling deviation of the relative changes of x, annualised."""
    df = df.withColumn("_pct", returns(x))
    return df.withColumn(out or f"vol_of_vol_{n}", roll(F.stddev, "_pct", n) * ANNUAL).drop("_pct")


def realized_volatility(df: DataFrame, x: str = "returns") -> DataFrame:
    """symbol, day, realized_vol: root of a day's squared returns, annualised; days between without rows have 0."""
    daily = df.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum(F.pow(F.col(x), 2)).alias("s"))
    days = daily.groupBy("symbol").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return days.join(daily, ["symbol", "day"], "left").select("symbol", "day", (F.sqrt(F.coalesce("s", F.lit(0.0))) * ANNUAL).alias("realized_vol"))


# Technical indicators.


def with_rsi(df: DataFrame, x: str = "close", n: int = 14, out: str = "rsi") -> DataFrame:
    """By plain rolling means; the first change counts as none; null while there were no losses."""
    d = F.coalesce(F.col(x) - lag(x), F.lit(0.0))
    df = df.withColumns({"_g": F.greatest(d, F.lit(0.0)), "_l": F.greatest(-d, F.lit(0.0))})
    return df.withColumn(out, 100 - 100 / (1 + div(roll(F.avg, "_g", n), roll(F.avg, "_l", n)))).drop("_g", "_l")


def with_atr(df: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    before = lag("close")
    df = df.withColumn("_tr", F.greatest(col("high") - col("low"), F.abs(col("high") - before), F.abs(col("low") - before)))
    return df.withColumn(out, roll(F.avg, "_tr", n)).drop("_tr")


def with_bollinger(df: DataFrame, x: str = "close", n: int = 20, k: float = 2.0) -> DataFrame:
    middle, off = roll(F.avg, x, n), k * roll(F.stddev, x, n)
    return df.withColumns({"bb_middle": middle, "bb_upper": middle + off, "bb_lower": middle - off, "bb_position": div(F.col(x) - (middle - off), 2 * off)})


def with_stochastic(df: DataFrame, n: int = 14, smooth_k: int = 3, smooth_d: int = 3) -> DataFrame:
    low, high = roll(F.min, "low", n), roll(F.max, "high", n)
    df = df.withColumn("_k", 100 * div(col("close") - low, high - low))
    df = df.withColumn("stoch_k", roll(F.avg, "_k", smooth_k)).drop("_k")
    return df.withColumn("stoch_d", roll(F.avg, "stoch_k", smooth_d))


def williams_r(n: int = 14) -> Column:
    high = roll(F.max, "high", n)
    return -100 * div(high - col("close"), high - roll(F.min, "low", n))


def typical() -> Column:
    return (col("high") + col("low") + col("close")) / 3


def with_cci(df: DataFrame, n: int = 20, out: str = "cci") -> DataFrame:
    w = last_rows(n)
    df = df.withColumn("_tp", typical()).withColumns({"_ma": roll(F.avg, "_tp", n), "_all": F.collect_list("_tp").over(w)})
    off = F.aggregate("_all", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("_ma"))) / n
    return df.withColumn(out, div(F.col("_tp") - F.col("_ma"), 0.015 * off)).drop("_tp", "_ma", "_all")


def with_obv(df: DataFrame, out: str = "obv") -> DataFrame:
    before = lag("close")
    df = df.withColumn("_v", F.when(col("close") > before, col("volume")).when(col("close") < before, -col("volume")).otherwise(F.lit(0.0)))
    return df.withColumn(out, F.sum("_v").over(so_far())).drop("_v")


def vwap(n: int | None = None) -> Column:
    w = last_rows(n) if n else so_far()
    ready = F.count(F.lit(1)).over(w) >= (n or 1)
    return F.when(ready, div(F.sum(typical() * col("volume")).over(w), F.sum("volume").over(w)))


def with_money_flow(df: DataFrame, n: int = 14, out: str = "mfi") -> DataFrame:
    """100 where there was inflow only, null where there was neither; the first row has no flow."""
    df = df.withColumn("_tp", typical()).withColumn("_before", lag("_tp"))
    flow = F.col("_tp") * F.col("volume")
    df = df.withColumns({"_in": F.when(F.col("_tp") > F.col("_before"), flow).otherwise(F.lit(0.0)), "_out": F.when(F.col("_tp") < F.col("_before"), flow).otherwise(F.lit(0.0))})
    came, went = roll(F.sum, "_in", n), roll(F.sum, "_out", n)
    return df.withColumn(out, F.when((went == 0) & (came > 0), F.lit(100.0)).otherwise(100 - 100 / (1 + div(came, went)))).drop("_tp", "_before", "_in", "_out")


def with_adx(df: DataFrame, n: int = 14) -> DataFrame:
    """plus_di, minus_di and adx, with plain rolling means."""
    up, down = col("high") - lag("high"), lag("low") - col("low")
    df = df.withColumns({"_p": F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0)), "_m": F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0))})
    df = with_atr(df, n, "_atr")
    df = df.withColumns({"plus_di": 100 * div(roll(F.avg, "_p", n), F.col("_atr")), "minus_di": 100 * div(roll(F.avg, "_m", n), F.col("_atr"))})
    df = df.withColumn("_dx", 100 * div(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    return df.withColumn("adx", roll(F.avg, "_dx", n)).drop("_p", "_m", "_atr", "_dx")


def with_ichimoku(df: DataFrame, conversion: int = 9, base: int = 26, span_b: int = 52, shift: int = 26) -> DataFrame:
    """The lagging span looks ahead by shift rows."""
    mid = lambda n: (roll(F.max, "high", n) + roll(F.min, "low", n)) / 2
    df = df.withColumns({"ichi_conversion": mid(conversion), "ichi_base": mid(base), "_b": mid(span_b), "ichi_lagging": F.lead("close", shift).over(series())})
    return df.withColumns({"ichi_span_a": lag((col("ichi_conversion") + col("ichi_base")) / 2, shift), "ichi_span_b": lag("_b", shift)}).drop("_b")


def price_position(n: int = 20) -> Column:
    """Where close stands between the lowest low and the highest high of n rows."""
    low = roll(F.min, "low", n)
    return div(col("close") - low, roll(F.max, "high", n) - low)


def combined(*frames: DataFrame, keys: tuple[str, ...] = ("symbol", "timeframe", "ts")) -> DataFrame:
    """Feature frames side by side, outer by symbol, timeframe and ts."""
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), frames)


def benchmark_features(bars: DataFrame, n: int | None = None) -> DataFrame:
    """The feature set of the model comparisons; by default the window hangs on the bar size, as the median distance of bars.

    Rows with any null are left out.
    """
    if n is None:
        gap = bars.withColumn("_gap", F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(lag("ts").cast("timestamp"))).agg(F.percentile("_gap", F.lit(0.5))).first()[0]
        n = {900.0: 30, 1800.0: 40, 3600.0: 28}.get(gap, 20)
    df = with_volatility(with_returns(bars), n)
    df = with_rsi(df).withColumns({"rolling_vol": volatility("returns", n), f"mean_{n}": roll(F.avg, "close", n), "volume_ratio": F.coalesce(div(col("volume"), F.avg("volume").over(last_rows(n)) + 1e-10), F.lit(1.0)), "momentum": momentum()})
    return df.drop(f"vol_of_vol_{n}").na.drop()
