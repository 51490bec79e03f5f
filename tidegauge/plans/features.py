"""Queries: returns, rolling statistics, volatility, technical indicators, entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import entropy as E
from tidegauge.functions import features as X
from tidegauge.functions import recursive as R
from tidegauge.functions import windows as W
from tidegauge.sources import bars as B

from . import engine
from .sql import EVENTS, LINES, RETURNS, SERIES, frame, roll, with_

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def named(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return named


def out(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.select("symbol", "ts", *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in columns])


def sql_of(columns: dict[str, str], source: str = "bars", tail: str = "", digits: int = 6) -> str:
    return "SELECT symbol, ts, " + ", ".join(f"round({x}, {digits}) + 0.0 AS {n}" for n, x in columns.items()) + f" FROM {source} {tail}"


_S = f"WINDOW s AS ({SERIES})"
_LAG = "lag(close) OVER s"
_ANNUAL = "sqrt(252)"


@query(with_(EVENTS) + sql_of({"simple": f"close / nullif({_LAG}, 0) - 1", "log": f"ln(close / nullif({_LAG}, 0))", "simple5": "close / nullif(lag(close, 5) OVER s, 0) - 1", "momentum": f"({roll('avg({})', 'close', 10)} - {roll('avg({})', 'close', 30)}) / nullif({roll('avg({})', 'close', 30)}, 0)"}, tail=_S))
def returns(spark: SparkSession, d: str) -> DataFrame:
    df = B.events_1h(spark, d).withColumns({"simple": X.returns(), "log": X.returns(method="log"), "simple5": X.returns(periods=5), "momentum": X.momentum()})
    return out(df, ["simple", "log", "simple5", "momentum"])


@query(with_(EVENTS) + sql_of({f"close_lag{k}": f"lag(close, {k}) OVER s" for k in (1, 2, 3)}, tail=_S))
def lagged_features(spark: SparkSession, d: str) -> DataFrame:
    return out(X.with_lags(B.events_1h(spark, d), 3, ["close"]), ["close_lag1", "close_lag2", "close_lag3"])


_MOMENTS = {"skew_20": f"CASE WHEN count(close) OVER {frame(20)} = 20 AND var_pop(close) OVER {frame(20)} > 0 THEN skewness(close) OVER {frame(20)} END", "kurt_20": f"CASE WHEN count(close) OVER {frame(20)} = 20 AND var_pop(close) OVER {frame(20)} > 0 THEN kurtosis(close) OVER {frame(20)} END"}
_ROLLING = {f"{n}_20": roll(f + "({})", "close", 20) for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("var", "var_samp"), ("min", "min"), ("max", "max"), ("sum", "sum"))} | {"median_20": roll("quantile_cont({}, 0.5)", "close", 20), "q25_20": roll("quantile_cont({}, 0.25)", "close", 20)} | _MOMENTS


@query(with_(EVENTS) + sql_of(_ROLLING, digits=8))
def rolling_features(spark: SparkSession, d: str) -> DataFrame:
    ops = {"mean": "mean", "std": "std", "var": "var", "min": "min", "max": "max", "sum": "sum", "median": "median", "skew": "skew", "kurt": "kurt"}
    df = B.events_1h(spark, d).withColumns({f"{n}_20": X.rolling("close", 20, op) for n, op in ops.items()} | {"q25_20": X.rolling("close", 20, "quantile", q=0.25)})
    return out(df, list(_ROLLING), 8)


@query(with_(EVENTS, f"m AS (SELECT *, {roll('quantile_cont({}, 0.5)', 'close', 20)} AS med FROM bars)", "o AS (SELECT *, abs(close - med) AS off FROM m)") + sql_of({"zscore": f"(close - {roll('avg({})', 'close', 20)}) / nullif({roll('stddev_samp({})', 'close', 20)}, 0)", "minmax": f"(close - {roll('min({})', 'close', 20)}) / nullif({roll('max({})', 'close', 20)} - {roll('min({})', 'close', 20)}, 0)", "robust": f"(close - med) / nullif(1.4826 * {roll('quantile_cont({}, 0.5)', 'off', 20)}, 0)"}, "o"))
def rolling_scales(spark: SparkSession, d: str) -> DataFrame:
    df = B.events_1h(spark, d).withColumns({"zscore": X.rolling_zscore(), "minmax": X.rolling_minmax("close", 20)})
    return out(X.with_rolling_robust(df, "close", 20), ["zscore", "minmax", "robust"])


_BOTH = f"count(CASE WHEN returns IS NOT NULL AND dv IS NOT NULL THEN 1 END) OVER {frame(20)} = 20 AND var_pop(returns) OVER {frame(20)} > 0 AND var_pop(dv) OVER {frame(20)} > 0"


@query(with_(EVENTS, RETURNS, f"v AS (SELECT *, volume / nullif(lag(volume) OVER s, 0) - 1 AS dv FROM r {_S})") + sql_of({"corr": f"CASE WHEN {_BOTH} THEN corr(returns, dv) OVER {frame(20)} END", "ir": f"{roll('avg({})', '(returns - dv)', 50)} / nullif({roll('stddev_samp({})', '(returns - dv)', 50)}, 0) * {_ANNUAL}"}, "v"))
def rolling_pairs(spark: SparkSession, d: str) -> DataFrame:
    df = X.with_returns(B.events_1h(spark, d)).withColumn("dv", X.returns("volume"))
    return out(df.withColumns({"corr": W.correlation("returns", "dv", 20), "ir": X.information_ratio("returns", "dv", 50)}), ["corr", "ir"])


@query(with_(EVENTS, RETURNS, f"z AS (SELECT *, coalesce(returns, 0) AS x, row_number() OVER s AS i FROM r {_S})", f"y AS (SELECT *, lag(x) OVER s AS y FROM z {_S})") + sql_of({"autocorr": f"CASE WHEN i >= 21 AND var_pop(x) OVER {frame(20)} > 0 AND var_pop(y) OVER {frame(20)} > 0 THEN corr(x, y) OVER {frame(20)} END"}, "y"))
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return out(X.autocorrelation(X.with_returns(B.events_1h(spark, d))), ["autocorr"])


@query(with_(EVENTS, RETURNS, f"w AS (SELECT symbol, ts, list_filter(list(returns) OVER {frame(20)}, lambda x: x IS NOT NULL) AS l, count(*) OVER {frame(20)} AS n FROM r)", "c AS (SELECT symbol, ts, n, len(l) AS m, list_transform(l, lambda x: x - list_avg(l)) AS l FROM w)", "k AS (SELECT *, list_sum(list_transform(l, lambda x: x * x)) / m AS v, list_sum(list_transform(l, lambda x: x * x * x)) / m AS t, list_sum(list_transform(l, lambda x: x * x * x * x)) / m AS f FROM c)") + "SELECT symbol, ts, round(CASE WHEN n = 20 AND m >= 3 AND v > 0 THEN m / 6 * (pow(t / pow(v, 1.5), 2) + pow(f / (v * v) - 3, 2) / 4) END, 6) AS jarque_bera FROM k")
def jarque_bera(spark: SparkSession, d: str) -> DataFrame:
    return out(X.with_returns(B.events_1h(spark, d)).withColumn("jarque_bera", X.jarque_bera()), ["jarque_bera"])


_K = 0.34 / (1.34 + 21 / 19)
_TERMS = f"""t AS (SELECT *, pow(ln(high / low), 2) AS hl, 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(coalesce(ln(close / {_LAG}), 0), 2) AS gk, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs,
  pow(coalesce(ln(open / {_LAG}), 0), 2) AS night, pow(ln(close / open), 2) AS oc, ln(close / {_LAG}) AS lr FROM bars {_S})"""


def _root(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN sqrt({x}) END"


_VOLS = {
    "parkinson_20": f"sqrt({roll('avg({})', 'hl', 20)} / (4 * ln(2))) * {_ANNUAL}",
    "garman_klass_20": f"({_root(roll('avg({})', 'gk', 20))}) * {_ANNUAL}",
    "rogers_satchell_20": f"({_root(roll('avg({})', 'rs', 20))}) * {_ANNUAL}",
    "yang_zhang_20": f"({_root(f'({roll("avg({})", "night", 20)} + {_K!r} * {roll("avg({})", "oc", 20)} + (1 - {_K!r}) * {roll("avg({})", "rs", 20)})')}) * {_ANNUAL}",
    "close_to_close_20": f"{roll('stddev_samp({})', 'lr', 20)} * {_ANNUAL}",
}
for _name, _bars, _load in (("event", EVENTS, B.events_1h), ("line", LINES, B.lines_1d)):

    def _volatility(spark: SparkSession, d: str, load=_load) -> DataFrame:
        return out(X.with_volatility(load(spark, d)), list(_VOLS))

    QUERIES[f"volatility_{_name}"] = _volatility
    ORACLE[f"volatility_{_name}"] = with_(_bars, _TERMS) + sql_of(_VOLS, "t")


@query(with_(EVENTS, f"t AS (SELECT *, ln(close / {_LAG}) AS lr FROM bars {_S})", f"c AS (SELECT *, {roll('stddev_samp({})', 'lr', 20)} * {_ANNUAL} AS c FROM t)", f"p AS (SELECT *, c / nullif(lag(c) OVER s, 0) - 1 AS p FROM c {_S})") + sql_of({"vol_of_vol_20": f"{roll('stddev_samp({})', 'p', 20)} * {_ANNUAL}"}, "p"))
def vol_of_vol(spark: SparkSession, d: str) -> DataFrame:
    return out(X.with_volatility(B.events_1h(spark, d)), ["vol_of_vol_20"])


@query(with_(EVENTS, RETURNS, "d AS (SELECT symbol, ts::DATE AS day, sum(returns * returns) AS s FROM r GROUP BY ALL)", "c AS (SELECT symbol, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY symbol)") + f"SELECT symbol, day::TIMESTAMP AS day, round(sqrt(coalesce(s, 0)) * {_ANNUAL}, 6) AS realized_vol FROM c LEFT JOIN d USING (symbol, day)")
def realized_volatility(spark: SparkSession, d: str) -> DataFrame:
    df = X.realized_volatility(X.with_returns(B.events_1h(spark, d)))
    return df.select("symbol", F.col("day").cast("timestamp_ntz").alias("day"), F.round("realized_vol", 6).alias("realized_vol"))


_D = f"d AS (SELECT *, coalesce(close - {_LAG}, 0) AS d FROM bars {_S}), g AS (SELECT *, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM d)"
_TR = f"t AS (SELECT *, greatest(high - low, abs(high - {_LAG}), abs(low - {_LAG})) AS tr FROM bars {_S})"


@query(with_(EVENTS, _D) + sql_of({"rsi": f"100 - 100 / (1 + {roll('avg({})', 'g', 14)} / nullif({roll('avg({})', 'l', 14)}, 0))"}, "g"))
def rsi(spark: SparkSession, d: str) -> DataFrame:
    return out(X.with_rsi(B.events_1h(spark, d)), ["rsi"])


@query(with_(EVENTS, _TR) + sql_of({"atr": roll("avg({})", "tr", 14)}, "t"))
def atr(spark: SparkSession, d: str) -> DataFrame:
    return out(X.with_atr(B.events_1h(spark, d)), ["atr"])


_M, _SD = roll("avg({})", "close", 20), roll("stddev_samp({})", "close", 20)


@query(with_(EVENTS) + sql_of({"bb_middle": _M, "bb_upper": f"{_M} + 2 * {_SD}", "bb_lower": f"{_M} - 2 * {_SD}", "bb_position": f"(close - ({_M} - 2 * {_SD})) / nullif(4 * {_SD}, 0)"}))
def bollinger(spark: SparkSession, d: str) -> DataFrame:
    return out(X.with_bollinger(B.events_1h(spark, d)), ["bb_middle", "bb_upper", "bb_lower", "bb_position"])


_LO, _HI = roll("min({})", "low", 14), roll("max({})", "high", 14)


@query(with_(EVENTS, f"k AS (SELECT *, 100 * (close - {_LO}) / nullif({_HI} - {_LO}, 0) AS raw FROM bars)", f"m AS (SELECT *, {roll('avg({})', 'raw', 3)} AS stoch_k FROM k)") + sql_of({"stoch_k": "stoch_k", "stoch_d": roll("avg({})", "stoch_k", 3), "williams_r": f"-100 * ({_HI} - close) / nullif({_HI} - {_LO}, 0)"}, "m"))
def stochastic(spark: SparkSession, d: str) -> DataFrame:
    return out(X.with_stochastic(B.events_1h(spark, d)).withColumn("williams_r", X.williams_r()), ["stoch_k", "stoch_d", "williams_r"])


@query(with_(EVENTS, f"t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars)", f"m AS (SELECT *, {roll('avg({})', 'tp', 20)} AS ma, list(tp) OVER {frame(20)} AS l FROM t)") + sql_of({"cci": "(tp - ma) / nullif(0.015 * list_sum(list_transform(l, lambda x: abs(x - ma))) / 20, 0)"}, "m"))
def cci(spark: SparkSession, d: str) -> DataFrame:
    return out(X.with_cci(B.events_1h(spark, d)), ["cci"])


_TP = "(high + low + close) / 3"


@query(with_(EVENTS, f"t AS (SELECT *, {_TP} AS tp, lag({_TP}) OVER s AS tb, CASE WHEN close > {_LAG} THEN volume WHEN close < {_LAG} THEN -volume ELSE 0 END AS v FROM bars {_S})", "f AS (SELECT *, CASE WHEN tp > tb THEN tp * volume ELSE 0 END AS i, CASE WHEN tp < tb THEN tp * volume ELSE 0 END AS o FROM t)") + sql_of({"obv": f"sum(v) OVER ({SERIES} ROWS UNBOUNDED PRECEDING)", "vwap": f"sum(tp * volume) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) / nullif(sum(volume) OVER ({SERIES} ROWS UNBOUNDED PRECEDING), 0)", "vwap_20": f"CASE WHEN count(*) OVER {frame(20)} = 20 THEN sum(tp * volume) OVER {frame(20)} / nullif(sum(volume) OVER {frame(20)}, 0) END", "mfi": f"CASE WHEN {roll('sum({})', 'o', 14)} = 0 AND {roll('sum({})', 'i', 14)} > 0 THEN 100 ELSE 100 - 100 / (1 + {roll('sum({})', 'i', 14)} / nullif({roll('sum({})', 'o', 14)}, 0)) END"}, "f", digits=8))
def volume_indicators(spark: SparkSession, d: str) -> DataFrame:
    df = X.with_money_flow(X.with_obv(B.events_1h(spark, d))).withColumns({"vwap": X.vwap(), "vwap_20": X.vwap(20)})
    return out(df, ["obv", "vwap", "vwap_20", "mfi"], 8)


@query(with_(EVENTS, _TR, f"u AS (SELECT *, high - lag(high) OVER s AS up, lag(low) OVER s - low AS dn FROM t {_S})", "p AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS m FROM u)", f"q AS (SELECT *, 100 * {roll('avg({})', 'p', 14)} / nullif({roll('avg({})', 'tr', 14)}, 0) AS plus_di, 100 * {roll('avg({})', 'm', 14)} / nullif({roll('avg({})', 'tr', 14)}, 0) AS minus_di FROM p)", "x AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM q)") + sql_of({"plus_di": "plus_di", "minus_di": "minus_di", "adx": roll("avg({})", "dx", 14)}, "x"))
def adx(spark: SparkSession, d: str) -> DataFrame:
    return out(X.with_adx(B.events_1h(spark, d)), ["plus_di", "minus_di", "adx"])


def _mid(n: int) -> str:
    return f"({roll('max({})', 'high', n)} + {roll('min({})', 'low', n)}) / 2"


@query(with_(EVENTS, f"i AS (SELECT *, {_mid(9)} AS c, {_mid(26)} AS b, {_mid(52)} AS sb FROM bars)") + sql_of({"ichi_conversion": "c", "ichi_base": "b", "ichi_span_a": "lag((c + b) / 2, 26) OVER s", "ichi_span_b": "lag(sb, 26) OVER s", "ichi_lagging": "lead(close, 26) OVER s"}, "i", _S))
def ichimoku(spark: SparkSession, d: str) -> DataFrame:
    return out(X.with_ichimoku(B.events_1h(spark, d)), ["ichi_conversion", "ichi_base", "ichi_span_a", "ichi_span_b", "ichi_lagging"])


def _ema(x: str, n: int) -> str:
    return f"list_reduce(list({x}) OVER ({SERIES} ROWS UNBOUNDED PRECEDING), lambda a, v: a * {1 - 2 / (n + 1)!r} + v * {2 / (n + 1)!r})"


@query(with_(EVENTS, f"m AS (SELECT *, {_ema('close', 12)} - {_ema('close', 26)} AS macd FROM bars)", f"g AS (SELECT *, {_ema('macd', 9)} AS signal FROM m)") + sql_of({"macd": "macd", "macd_signal": "signal", "macd_histogram": "macd - signal"}, "g"))
def macd(spark: SparkSession, d: str) -> DataFrame:
    return out(R.macd(B.events_1h(spark, d)), ["macd", "macd_signal", "macd_histogram"])


@query(with_(EVENTS, f"l AS (SELECT symbol, ts, list_reverse(list(close) OVER ({SERIES} ROWS UNBOUNDED PRECEDING)) AS l FROM bars)") + "SELECT symbol, ts, round(list_sum(list_transform(l, lambda x, i: x * pow(1 - 2 / 21, i - 1))) / list_sum(list_transform(l, lambda x, i: pow(1 - 2 / 21, i - 1))), 6) AS ewm_mean FROM l")
def ewm_mean(spark: SparkSession, d: str) -> DataFrame:
    return out(R.ewm(B.events_1h(spark, d), "close", span=20), ["ewm_mean"])


@query(with_(EVENTS, RETURNS, "v AS (SELECT symbol, ts, returns, var_pop(returns) OVER (PARTITION BY symbol) AS v FROM r WHERE returns IS NOT NULL)", f"l AS (SELECT symbol, ts, list_prepend(any_value(v) OVER (PARTITION BY symbol), list(lag_r) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS l FROM (SELECT *, lag(returns) OVER (PARTITION BY symbol ORDER BY ts) AS lag_r FROM v))") + "SELECT symbol, ts, round(sqrt(list_reduce(list_filter(l, lambda x: x IS NOT NULL), lambda a, r: 1e-5 + 0.1 * r * r + 0.85 * a)), 6) AS garch_vol FROM l")
def garch_volatility(spark: SparkSession, d: str) -> DataFrame:
    df = R.garch_volatility(X.with_returns(B.events_1h(spark, d)))
    return out(df.where("garch_vol IS NOT NULL"), ["garch_vol"])


_BINS = f"""w AS (SELECT symbol, ts, list(close) OVER {frame(50)} AS l FROM bars), m AS (SELECT *, list_min(l) AS lo, list_max(l) AS hi FROM w WHERE len(l) = 50),
  b AS (SELECT symbol, ts, unnest(list_transform(l, lambda x: CASE WHEN hi = lo THEN 5 ELSE least(floor((x - lo) / (hi - lo) * 10), 9) END)) AS b FROM m), c AS (SELECT symbol, ts, b, count(*) / 50 AS p FROM b GROUP BY ALL)"""


@query(with_(EVENTS, _BINS) + "SELECT symbol, ts, round(-sum(p * log2(p)), 6) + 0.0 AS shannon, round(-log2(sum(p * p)), 6) + 0.0 AS renyi FROM c GROUP BY symbol, ts")
def histogram_entropies(spark: SparkSession, d: str) -> DataFrame:
    df = E.with_histogram_entropies(B.events_1h(spark, d), "close", 50)
    return out(df.where("shannon IS NOT NULL"), ["shannon", "renyi"])


@query(with_(EVENTS, f"t AS (SELECT *, lag(close, 2) OVER s AS a, {_LAG} AS b FROM bars {_S})", "p AS (SELECT symbol, timeframe, ts, CASE WHEN a IS NULL THEN NULL ELSE (a > b)::INT * 4 + (a > close)::INT * 2 + (b > close)::INT END AS p FROM t)", f"l AS (SELECT symbol, ts, unnest(list(p) OVER {frame(48)}) AS p, count(p) OVER {frame(48)} AS n FROM p)", "c AS (SELECT symbol, ts, p, count(*) / 48 AS q FROM l WHERE n = 48 GROUP BY ALL)") + "SELECT symbol, ts, round(-sum(q * ln(q)) / ln(6), 6) + 0.0 AS permutation FROM c GROUP BY symbol, ts")
def permutation_entropy(spark: SparkSession, d: str) -> DataFrame:
    return out(E.with_permutation_entropy(B.events_1h(spark, d), "close", 50).where("permutation IS NOT NULL"), ["permutation"])


@query()
def complexity_features(spark: SparkSession, d: str) -> DataFrame:
    """Entropies and exponents that need a pass over each window; checked against plain versions in the tests."""
    return E.with_complexity(X.with_returns(B.events_1h(spark, d)), "returns", 60)


_STATS = {f"{n}_20": roll(f + "({})", "close", 20) for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))} | {"median_20": roll("quantile_cont({}, 0.5)", "close", 20), "skewness_20": _MOMENTS["skew_20"], "kurtosis_20": _MOMENTS["kurt_20"]}
_BANDS = {"bb_middle": _M, "bb_upper": f"{_M} + 2 * {_SD}", "bb_lower": f"{_M} - 2 * {_SD}"}
_RSI = f"100 - 100 / (1 + {roll('avg({})', 'g', 14)} / nullif({roll('avg({})', 'l', 14)}, 0))"
_SIDE = (_TERMS, f"d AS (SELECT *, coalesce(close - {_LAG}, 0) AS d, greatest(high - low, abs(high - {_LAG}), abs(low - {_LAG})) AS tr, close / nullif({_LAG}, 0) - 1 AS returns FROM t {_S})", "g AS (SELECT *, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM d)")
_ALL_FEATURES = {"returns": "returns"} | _VOLS | _BANDS | {"atr": roll("avg({})", "tr", 14), "rsi": _RSI} | _STATS


@query(with_(EVENTS, *_SIDE) + sql_of(_ALL_FEATURES, "g"))
def all_features(spark: SparkSession, d: str) -> DataFrame:
    """All four families side by side, in one pass over the windows."""
    df = X.with_volatility(X.with_returns(B.events_1h(spark, d)))
    return out(X.rolling_statistics(X.with_rsi(X.with_atr(X.with_bollinger(df)))), list(_ALL_FEATURES))


def _vols_of(n: int) -> dict[str, str]:
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    yang = f'({roll("avg({})", "night", n)} + {k!r} * {roll("avg({})", "oc", n)} + (1 - {k!r}) * {roll("avg({})", "rs", n)})'
    return {f"parkinson_{n}": f"sqrt({roll('avg({})', 'hl', n)} / (4 * ln(2))) * {_ANNUAL}", f"garman_klass_{n}": f"({_root(roll('avg({})', 'gk', n))}) * {_ANNUAL}", f"rogers_satchell_{n}": f"({_root(roll('avg({})', 'rs', n))}) * {_ANNUAL}", f"yang_zhang_{n}": f"({_root(yang)}) * {_ANNUAL}", f"close_to_close_{n}": f"{roll('stddev_samp({})', 'lr', n)} * {_ANNUAL}"}


_LONG = f"{roll('avg({})', 'close', 30)}"
_BENCH = _vols_of(28) | {"rsi": _RSI, "rolling_vol": roll("stddev_samp({})", "returns", 28), "mean_28": roll("avg({})", "close", 28), "volume_ratio": f"coalesce(volume / nullif(avg(volume) OVER {frame(28)} + 1e-10, 0), 1)", "momentum": f"({roll('avg({})', 'close', 10)} - {_LONG}) / nullif({_LONG}, 0)"}


@query(with_(EVENTS, *_SIDE, f"b AS (SELECT symbol, ts, returns, {', '.join(f'{x} AS {n}' for n, x in _BENCH.items())} FROM g)") + "SELECT symbol, ts, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("returns", *_BENCH)) + " FROM b WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ("returns", *_BENCH)))
def benchmark_features(spark: SparkSession, d: str) -> DataFrame:
    return out(X.benchmark_features(B.events_1h(spark, d), 28), ["returns", *_BENCH])


_ENGINE = {"rsi": _RSI, "macd": "macd", "sma_20": _M, "ema_20": _ema("close", 20)} | _BANDS | {"atr": roll("avg({})", "tr", 14), "mean_20": _M, "parkinson_20": _VOLS["parkinson_20"], "close_to_close_20": _VOLS["close_to_close_20"], "skewness_20": _STATS["skewness_20"]}
_HUNDRED = _BINS.replace(frame(50), frame(100)).replace("= 50", "= 100").replace("/ 50", "/ 100")


@query(with_(EVENTS, *_SIDE, f"e AS (SELECT *, {_ema('close', 12)} - {_ema('close', 26)} AS macd FROM g)", f"f AS ({sql_of(_ENGINE, 'e')})", _HUNDRED, "h AS (SELECT symbol, ts, round(-sum(p * log2(p)), 6) + 0.0 AS shannon FROM c GROUP BY symbol, ts)") + "SELECT f.*, shannon FROM f LEFT JOIN h USING (symbol, ts)")
def engine_features(spark: SparkSession, d: str) -> DataFrame:
    """The engine's default feature set of all families."""
    return out(engine.compute(B.events_1h(spark, d)), [*_ENGINE, "shannon"])


@query(with_(EVENTS, RETURNS, f"v AS (SELECT *, volume / nullif(lag(volume) OVER s, 0) - 1 AS dv FROM r {_S})", f"y AS (SELECT *, lag(dv, 2) OVER s AS y2 FROM v {_S})") + sql_of({"cross_corr": f"CASE WHEN count(CASE WHEN returns IS NOT NULL AND y2 IS NOT NULL THEN 1 END) OVER {frame(20)} = 20 AND var_pop(returns) OVER {frame(20)} > 0 AND var_pop(y2) OVER {frame(20)} > 0 THEN corr(returns, y2) OVER {frame(20)} END"}, "y"))
def cross_correlation(spark: SparkSession, d: str) -> DataFrame:
    df = X.with_returns(B.events_1h(spark, d)).withColumn("dv", X.returns("volume"))
    return out(X.cross_correlation(df, "returns", "dv", 20, 2), ["cross_corr"])


_WEIGHTS = f"w AS (SELECT symbol, ts, l, list_transform(l, lambda x, i: pow(1 - 2 / 21, i - 1)) AS w FROM (SELECT symbol, ts, list_reverse(list(close) OVER ({SERIES} ROWS UNBOUNDED PRECEDING)) AS l FROM bars)), m AS (SELECT *, list_dot_product(l, w) / list_sum(w) AS m, list_sum(w) AS sw, list_dot_product(w, w) AS sq FROM w), q AS (SELECT symbol, ts, len(l) AS n, list_sum(list_transform(l, lambda x, i: w[i] * (x - m) * (x - m))) / sw * sw * sw / nullif(sw * sw - sq, 0) AS v FROM m)"


@query(with_(EVENTS, _WEIGHTS) + "SELECT symbol, ts, round(CASE WHEN n > 1 THEN v END, 6) AS ewm_var, round(CASE WHEN n > 1 THEN sqrt(v) END, 6) AS ewm_std FROM q")
def ewm_spread(spark: SparkSession, d: str) -> DataFrame:
    df = R.ewm(B.events_1h(spark, d), "close", span=20, operation="var")
    return out(R.ewm(df, "close", span=20, operation="std"), ["ewm_var", "ewm_std"])


@query()
def transfer_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Bits that volume's changes add to returns' own past; checked against a plain version in the tests."""
    df = X.with_returns(B.events_1h(spark, d)).withColumn("dv", X.returns("volume"))
    return out(E.with_transfer(df, "dv", "returns", 60), ["transfer"])


@query()
def multiscale_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Sample entropies over coarser series; checked against a plain version in the tests."""
    return out(E.with_multiscale(X.with_returns(B.events_1h(spark, d)), "returns", 60), ["mse_1", "mse_2", "mse_4"])
