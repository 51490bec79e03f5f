"""Queries: regime models. Those with an iterative fit have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import features as X
from tidegauge.operators import classify as C
from tidegauge.operators import garch, hmm
from tidegauge.operators import regimes as G
from tidegauge.session import scratch
from tidegauge.sources import bars as B

from .sql import EVENTS, RETURNS, SERIES, frame, roll, with_

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

FEATURES = ["returns", "vol", "log_volume"]


def query(sql: str | None = None):
    def named(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return named


def prepared(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars with log returns, their deviation over 10 bars, and the log of volume, written down once, as a fit reads them many times."""
    df = X.with_returns(B.events_1h(spark, d), method="log")
    df = df.withColumns({"vol": X.volatility("returns", 10), "log_volume": F.ln("volume")}).na.drop(subset=FEATURES)
    path = scratch(spark, "prepared")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@query()
def hmm_parameters(spark: SparkSession, d: str) -> DataFrame:
    return hmm.fitted(prepared(spark, d), FEATURES, 3, "diag")


@query()
def hmm_regimes(spark: SparkSession, d: str) -> DataFrame:
    df = prepared(spark, d)
    return hmm.predicted(df, hmm.fitted(df, FEATURES, 3, "diag"), FEATURES).select("symbol", "ts", "regime", "p")


@query()
def hmm_best_k(spark: SparkSession, d: str) -> DataFrame:
    return hmm.fitted(prepared(spark, d), FEATURES, kind="diag", starts=2, ks=(2, 3, 4)).select("symbol", "k", "aic", "bic")


@query()
def gmm_regimes(spark: SparkSession, d: str) -> DataFrame:
    return C.mixture(prepared(spark, d), FEATURES).select("symbol", "ts", "regime", "p")


@query()
def gmm_tied_regimes(spark: SparkSession, d: str) -> DataFrame:
    df = prepared(spark, d)
    return hmm.predicted(df, hmm.fitted(df, FEATURES, 3, "tied", markov=False), FEATURES, markov=False).select("symbol", "ts", "regime", "p", "log_density")


@query()
def kmeans_regimes(spark: SparkSession, d: str) -> DataFrame:
    return C.clustered(prepared(spark, d), FEATURES).select("symbol", "ts", "regime")


@query()
def garch_parameters(spark: SparkSession, d: str) -> DataFrame:
    return garch.fitted(prepared(spark, d))


@query()
def garch_regimes(spark: SparkSession, d: str) -> DataFrame:
    return garch.regimes(prepared(spark, d)).select("symbol", "ts", "garch_vol", "regime")


_SLICES = "t AS (SELECT symbol, timeframe, ts, returns, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE returns IS NOT NULL), g AS (SELECT symbol, least(floor(i / floor(n / 3)), 2) AS k, stddev_pop(returns) AS level FROM t GROUP BY ALL), a AS (SELECT symbol, list(level ORDER BY level) AS levels FROM g GROUP BY symbol)"


@query(with_(EVENTS, RETURNS, _SLICES, f"s AS (SELECT t.*, stddev_samp(returns) OVER {frame(20)} AS sd FROM t)", "u AS (SELECT s.*, CASE WHEN sd IS NULL THEN 0 ELSE list_position(list_transform(levels, lambda v: abs(v - sd)), list_min(list_transform(levels, lambda v: abs(v - sd)))) - 1 END AS raw FROM s JOIN a USING (symbol))") + f"SELECT symbol, ts, quantile_cont(raw, 0.5) OVER ({SERIES} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)::INT AS regime FROM u")
def switching_regimes(spark: SparkSession, d: str) -> DataFrame:
    df = X.with_returns(B.events_1h(spark, d)).where("returns IS NOT NULL")
    return garch.switching(df).select("symbol", "ts", "regime")


_LOG = f"r AS (SELECT *, ln(close / nullif(lag(close) OVER s, 0)) AS returns FROM bars WINDOW s AS ({SERIES}))"
_CONSISTENT = with_(EVENTS, _LOG, f"v AS (SELECT *, {roll('stddev_samp({})', 'returns', 10)} AS vol FROM r)") + "SELECT symbol, ts, true AS likeliest, true AS sums_to_one FROM v WHERE returns IS NOT NULL AND vol IS NOT NULL AND volume > 0"


def consistent(df: DataFrame, p: str, label: str = G.LABEL) -> DataFrame:
    """symbol, ts, whether the label is the likeliest by p, and whether p sums to one."""
    total = F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
    return df.select("symbol", "ts", (F.try_element_at(p, F.col(label) + 1) == F.array_max(p)).alias("likeliest"), (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


@query(_CONSISTENT)
def gmm_consistent(spark: SparkSession, d: str) -> DataFrame:
    """What no fit may break: every bar has a label, its likeliest regime, and probabilities."""
    return consistent(C.mixture(prepared(spark, d), FEATURES), "p")


@query(_CONSISTENT)
def forest_consistent(spark: SparkSession, d: str) -> DataFrame:
    df = prepared(spark, d)
    return consistent(C.Detector("random_forest", FEATURES).fit(df).transform(df), "regime_p")


@query(_CONSISTENT)
def logistic_consistent(spark: SparkSession, d: str) -> DataFrame:
    df = prepared(spark, d)
    return consistent(C.Detector("logistic", FEATURES).fit(df).transform(df), "regime_p")


for _name in C.CLASSIFIERS:

    def _classified(spark: SparkSession, d: str, name=_name) -> DataFrame:
        df = prepared(spark, d)
        return C.Detector(name, FEATURES).fit(df).transform(df).select("symbol", "ts", "regime")

    QUERIES[f"classify_{_name}"] = _classified


@query()
def ensemble_regimes(spark: SparkSession, d: str) -> DataFrame:
    df = prepared(spark, d)
    members = C.fitted(df, [C.Detector(n, FEATURES) for n in ("random_forest", "svm_linear", "logistic")])
    return C.voted(df, members).select("symbol", "ts", "votes", "regime", "agreement")


@query()
def ensemble_bayesian(spark: SparkSession, d: str) -> DataFrame:
    df = prepared(spark, d)
    members = C.fitted(df, [C.Detector(n, FEATURES) for n in ("random_forest", "logistic")])
    return C.voted(df, members, "bayesian").select("symbol", "ts", "p", "regime")


@query()
def ensemble_stacked(spark: SparkSession, d: str) -> DataFrame:
    df = G.quantile_labels(prepared(spark, d), "vol", 3, "target")
    return C.stacked(df, [C.Detector(n, FEATURES) for n in ("random_forest", "logistic")], "target", 2).select("symbol", "ts", "target", "regime")
