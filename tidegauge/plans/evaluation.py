"""Queries: evaluation of labels and predictions, selection scores, imputation, forecasts, and bars read back from files and services."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import features as X
from tidegauge.functions import recursive as R
from tidegauge.operators import classify as C
from tidegauge.operators import clean, garch
from tidegauge.operators import metrics as M
from tidegauge.operators import regimes as G
from tidegauge.operators import select as S
from tidegauge.operators import splits as P
from tidegauge.session import scratch
from tidegauge.sources import bars as B
from tidegauge.sources import files, service

from . import features as XQ
from . import labels as L
from . import models as MQ
from .labels import BASE, labelled
from .sql import EVENTS, SERIES, with_

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def named(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return named


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Predictions: the tercile of volatility, said by the tercile of the bar before.

_SAID = f"s AS (SELECT *, coalesce(lag(regime) OVER ({SERIES}), 0) AS said FROM l)"


def _said(spark: SparkSession, d: str) -> DataFrame:
    df = labelled(spark, d)
    return df.withColumn("said", F.coalesce(X.lag("regime"), F.lit(0)))


_CLASSES = "k AS (SELECT unnest([0, 1, 2]) AS class), rc AS (SELECT class::INT AS class, count(*) FILTER (WHERE regime = class) AS support, count(*) FILTER (WHERE regime = class AND said = class) AS hits, count(*) FILTER (WHERE said = class) AS n_said FROM s, k GROUP BY class), t AS (SELECT class, support, coalesce(hits / nullif(n_said, 0), 0) AS prec, coalesce(hits / nullif(support, 0), 0) AS recall FROM rc), f AS (SELECT *, coalesce(2 * prec * recall / nullif(prec + recall, 0), 0) AS f1, support / sum(support) OVER () AS w FROM t)"


_SCORES = (("precision", "prec"), ("recall", "recall"), ("f1", "f1"))


@query(with_(*BASE, _SAID, _CLASSES) + 'SELECT class, support, round(prec, 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f')
def prediction_classes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.prediction_report(_said(spark, d), "said", "regime"))


@query(with_(*BASE, _SAID, _CLASSES) + "SELECT round(sum(recall * w), 9) AS accuracy, " + ", ".join([f"round(avg({x}), 9) AS macro_{c}" for c, x in _SCORES] + [f"round(sum({x} * w), 9) AS weighted_{c}" for c, x in _SCORES]) + " FROM f")
def prediction_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.prediction_summary(M.prediction_report(_said(spark, d), "said", "regime")))


_AMI = "c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), ta AS (SELECT a, sum(n) AS x FROM c GROUP BY a), tb AS (SELECT b, sum(n) AS y FROM c GROUP BY b), tt AS (SELECT sum(n) AS t FROM c), mi AS (SELECT sum(n / t * ln(n * t / (x * y))) AS v FROM c JOIN ta USING (a) JOIN tb USING (b), tt), ha AS (SELECT -sum(x / t * ln(x / t)) AS v FROM ta, tt), hb AS (SELECT -sum(y / t * ln(y / t)) AS v FROM tb, tt), k AS (SELECT x, y, t, unnest(range(greatest(1, x + y - t)::BIGINT, least(x, y)::BIGINT + 1)) AS k FROM ta, tb, tt), e AS (SELECT sum(k / t * ln(t * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(t - x - y + k + 1))) AS v FROM k)"


@query(f"WITH {_AMI} SELECT round((mi.v - e.v) / ((ha.v + hb.v) / 2 - e.v), 8) AS adjusted_mutual_info FROM mi, ha, hb, e")
def adjusted_mutual_info(spark: SparkSession, d: str) -> DataFrame:
    value = M.adjusted_mutual_info(spark.read.parquet(f"{d}/labels.parquet"), "quality", "toxic")
    return spark.createDataFrame([(round(value, 8) + 0.0,)], "adjusted_mutual_info double")


# Stability of labels.


@query(with_(*BASE, "i AS (SELECT symbol, timeframe, ts, regime, close, volume, row_number() OVER w AS i, CASE WHEN var_pop(close) OVER p > 0 AND var_pop(volume) OVER p > 0 THEN corr(close, volume) OVER p END AS c FROM l WINDOW w AS (PARTITION BY symbol, timeframe, regime ORDER BY ts), p AS (PARTITION BY symbol, timeframe, regime ORDER BY ts ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))") + "SELECT symbol, regime, count(*) AS rows, round(CASE WHEN count(*) < 60 THEN 1 ELSE coalesce(1 / (1 + var_pop(c) FILTER (WHERE i > 30)), 0) END, 6) AS stability FROM i GROUP BY symbol, regime")
def correlation_stability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.correlation_stability(labelled(spark, d), "close", "volume").drop("timeframe"), 6)


@query(with_(*BASE, f"i AS (SELECT symbol, ts, row_number() OVER ({SERIES}) AS i, list(regime) OVER ({SERIES} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS w FROM l)") + "SELECT round(avg(list_max(list_transform([0, 1, 2], lambda v: len(list_filter(w, lambda x: x = v)))) / 5), 9) AS consistency FROM i WHERE i > 5")
def trailing_consistency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.trailing_consistency(labelled(spark, d)))


_DENSE = f"p AS (SELECT regime AS from_regime, lead(regime) OVER ({SERIES}) AS t FROM l), m AS (SELECT from_regime, t, count(*) / sum(count(*)) OVER (PARTITION BY from_regime) AS p FROM p WHERE t IS NOT NULL GROUP BY from_regime, t)"


@query(with_(*BASE, _DENSE) + "SELECT from_regime, round(sum(p), 9) AS total, abs(sum(p) - 1) <= 1e-5 AND bool_and(p BETWEEN 0 AND 1) AS valid FROM m GROUP BY from_regime")
def transition_check(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.is_stochastic(M.transition_matrix(labelled(spark, d))))


@query(with_(*BASE, L._P.replace("AS (SELECT symbol, ts, regime,", "AS (SELECT symbol, ts, regime, close, vol, volume,"), L._CLUSTER, f"d AS (SELECT i.symbol, i.ts, i.regime AS a, j.regime AS b, sum({L._apart('i', 'j')}) AS d, count(*) AS n FROM x i, x j GROUP BY ALL)", "e AS (SELECT symbol, ts, max(CASE WHEN a = b AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN a <> b THEN d / n END) AS b FROM d GROUP BY symbol, ts)", "si AS (SELECT avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS v FROM e)", "co AS (SELECT avg(list_max(p)) AS v FROM f)", f"pe AS (SELECT 1 - count(*) FILTER (WHERE regime <> before) / count(before) AS v FROM (SELECT regime, lag(regime) OVER ({SERIES}) AS before FROM l))", "di AS (SELECT -sum(q * ln(q)) / ln(count(*)) AS v FROM (SELECT count(*) / sum(count(*)) OVER () AS q FROM l GROUP BY regime))") + "SELECT round(si.v, 6) AS silhouette, round(co.v, 6) AS mean_confidence, round(pe.v, 6) AS persistence, round(di.v, 6) AS normalized_entropy, round(100 * (0.35 * (si.v + 1) / 2 + 0.25 * co.v + 0.25 * pe.v + 0.15 * di.v), 5) AS quality_index FROM si, co, pe, di")
def quality_index(spark: SparkSession, d: str) -> DataFrame:
    df = M.quality_index(L._probable(spark, d), L._FEATURES, "p")
    return df.select(*[F.round(c, 6).alias(c) for c in ("silhouette", "mean_confidence", "persistence", "normalized_entropy")], F.round("quality_index", 5).alias("quality_index"))


@query()
def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """All measures of one labelling in a row; the parts have queries with SQL of their own."""
    return rounded(M.evaluated(_said(spark, d).withColumn("p", G.neighbour_probabilities("regime", 3)), L._FEATURES, p="p", target="said"))


_FOLDS = f"b AS (SELECT *, ntile(4) OVER (ORDER BY ts) AS fold FROM s), n AS (SELECT *, lead(regime) OVER (PARTITION BY fold, symbol, timeframe ORDER BY ts) AS nx FROM b), f AS (SELECT fold, count(*) AS n_rows, avg(CASE WHEN nx IS NOT NULL THEN (nx = regime)::INT END) AS persistence, avg((regime = said)::INT) AS accuracy FROM n GROUP BY fold)"
_ONE = (EVENTS.replace("event_type AS symbol", "'(all)' AS symbol"), *BASE[1:])


@query(with_(*_ONE, _SAID, _FOLDS) + " UNION ALL ".join(f"SELECT '{c}' AS measure, round(avg({c}), 9) AS mean, round(stddev_pop({c}), 9) AS std, round(min({c}), 9)::DOUBLE AS min, round(max({c}), 9)::DOUBLE AS max FROM f" for c in ("persistence", "accuracy")))
def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    df = P.numbered(labelled(spark, d, B.events_all_1h)).withColumn("said", F.coalesce(X.lag("regime"), F.lit(0)))
    n = df.count()
    small, more = n // 4, n % 4
    edge = [sum(small + (j < more) for j in range(k)) for k in range(1, 4)]
    fold = sum(((F.col("row_no") >= e).cast("int") for e in edge), F.lit(1))
    return rounded(M.aggregated(M.folds_evaluated(df.withColumn("fold", fold), target="said"), ["persistence", "accuracy"]))


@query(with_(*BASE, L._VOTES) + "SELECT i::INT AS member, round(1 / 3, 9) AS weight, round(avg((v[i + 1] = modal)::INT), 9) AS agrees, count(*) AS n_rows FROM (SELECT w.v, t.modal, unnest([0, 1, 2]) AS i FROM w JOIN t USING (symbol, ts)) GROUP BY i")
def ensemble_contributions(spark: SparkSession, d: str) -> DataFrame:
    votes = F.array("regime", (F.col("vol") > 1.5).cast("int") * 2, (F.col("close") > 50).cast("int"))
    df = labelled(spark, d).withColumn("v", votes).withColumn("regime", G.modal("v"))
    return rounded(C.contributions(df, "v"))


# Volatility regimes: probabilities, and forecasts by given parameters.

_GARCH = XQ.ORACLE["garch_volatility"]


@query(f"WITH g AS ({_GARCH}), q AS (SELECT symbol, quantile_cont(garch_vol, 1.0::DOUBLE / 3) AS q1, quantile_cont(garch_vol, 2.0::DOUBLE / 3) AS q2 FROM g GROUP BY symbol), l AS (SELECT g.*, (garch_vol > q1)::INT + (garch_vol > q2)::INT AS regime FROM g JOIN q USING (symbol)) SELECT symbol, ts, regime, " + ", ".join(f"round(CASE WHEN regime = {i} THEN 0.8 WHEN abs(regime - {i}) = 1 THEN 0.1 ELSE 0 END / CASE WHEN regime = 1 THEN 1.0 ELSE 0.9 END::DOUBLE, 9)::DOUBLE AS p{i}" for i in range(3)) + " FROM l")
def garch_probabilities(spark: SparkSession, d: str) -> DataFrame:
    df = R.garch_volatility(X.with_returns(B.events_1h(spark, d))).where("garch_vol IS NOT NULL").withColumn("garch_vol", F.round("garch_vol", 6))
    df = G.quantile_labels(df, "garch_vol", 3).withColumn("p", G.neighbour_probabilities("regime", 3))
    return df.select("symbol", "ts", "regime", *[F.round(F.get("p", F.lit(i)), 9).alias(f"p{i}") for i in range(3)])


_SWITCHING = MQ.ORACLE["switching_regimes"]


@query(f"WITH g AS ({_SWITCHING}) SELECT symbol, ts, " + ", ".join(f"round(avg(CASE WHEN regime = {i} THEN 0.8 WHEN abs(regime - {i}) = 1 THEN 0.1 ELSE 0 END / CASE WHEN regime = 1 THEN 1.0 ELSE 0.9 END::DOUBLE) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS p{i}" for i in range(3)) + " FROM g")
def switching_probabilities(spark: SparkSession, d: str) -> DataFrame:
    df = garch.switching(X.with_returns(B.events_1h(spark, d)).where("returns IS NOT NULL")).withColumn("p", G.neighbour_probabilities("regime", 3))
    df = G.with_smoothed_probabilities(df, "p", 3)
    return df.select("symbol", "ts", *[F.round(F.get("smoothed_p", F.lit(i)), 9).alias(f"p{i}") for i in range(3)])


@query(with_(*BASE) + "SELECT count(*) AS n_rows, count(*) FILTER (WHERE regime IS NULL) AS missing, count(*) FILTER (WHERE regime NOT BETWEEN 0 AND 1) AS outside, count(DISTINCT regime) AS labels, count(*) FILTER (WHERE regime NOT BETWEEN 0 AND 1) = 0 AS valid FROM l")
def label_check(spark: SparkSession, d: str) -> DataFrame:
    """Three labels held against two."""
    return G.label_check(labelled(spark, d), 2)


@query(with_(EVENTS, "z AS (SELECT symbol, arg_max(close, ts) / 1000 AS residual, arg_max(volume, ts) / 10 AS variance FROM bars GROUP BY symbol)", "h AS (SELECT *, unnest(range(1, 11)) AS step FROM z)", "f AS (SELECT *, 0.05 + 0.1 * residual * residual + 0.8 * variance AS first, 0.05 / (1 - 0.9::DOUBLE) AS long FROM h)") + "SELECT symbol, step::INT AS step, round(sqrt(long + pow(0.9::DOUBLE, step - 1) * (first - long)), 9) AS volatility FROM f")
def garch_forecast(spark: SparkSession, d: str) -> DataFrame:
    bars = B.events_1h(spark, d)
    last = bars.groupBy("symbol", "timeframe").agg((F.max_by("close", "ts") / 1000).alias("residual"), (F.max_by("volume", "ts") / 10).alias("variance"))
    given = bars.select("symbol", "timeframe").distinct().withColumns({"omega": F.lit(0.05), "alpha": F.lit(0.1), "beta": F.lit(0.8), "persistence": F.lit(0.9)})
    return rounded(garch.forecast(given, last).select("symbol", "step", "volatility"))


# Selection scores and imputation.


@query(with_(*BASE) + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(pow(corr({c}, vol), 2) * (count(*) - 2) / (1 - pow(corr({c}, vol), 2)), 6) AS score FROM l" for c in ("close", "volume")))
def regression_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.regression_scores(labelled(spark, d), ["close", "volume"], "vol"), 6)


def _mutual(c: str) -> str:
    return f"SELECT '{c}' AS feature, round(sum(n / t * ln(n * t / (nb * nr))), 9) AS score FROM (SELECT *, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY regime) AS nr, sum(n) OVER () AS t FROM (SELECT least(floor(({c} - lo) / (hi - lo) * 10), 9) AS b, regime, count(*) AS n FROM l, (SELECT min({c}) AS lo, max({c}) AS hi FROM l) GROUP BY ALL))"


@query(with_(*BASE) + " UNION ALL ".join(map(_mutual, ("close", "volume"))))
def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.mutual_information(labelled(spark, d), ["close", "volume"], "regime").select("feature", "score"))


_GAPS = f"h AS (SELECT symbol, ts, open, CASE WHEN row_number() OVER ({SERIES}) % 17 <> 0 THEN close END AS close, CASE WHEN row_number() OVER ({SERIES}) % 23 <> 0 THEN volume END AS volume FROM bars)"
_NEAR = "d AS (SELECT * FROM h WHERE close IS NOT NULL AND volume IS NOT NULL), g AS (SELECT * FROM h WHERE close IS NULL OR volume IS NULL), n AS (SELECT g.symbol, g.ts, d.close AS dc, d.volume AS dv, row_number() OVER (PARTITION BY g.symbol, g.ts ORDER BY (pow(g.open - d.open, 2) + coalesce(pow(g.close - d.close, 2), 0) + coalesce(pow(g.volume - d.volume, 2), 0)) * 3 / (1 + (g.close IS NOT NULL)::INT + (g.volume IS NOT NULL)::INT), d.open, d.close, d.volume) AS i FROM g JOIN d USING (symbol)), m AS (SELECT symbol, ts, avg(dc) AS dc, avg(dv) AS dv FROM n WHERE i <= 5 GROUP BY symbol, ts)"


@query(with_(EVENTS, _GAPS, _NEAR) + "SELECT symbol, ts, round(coalesce(close, dc), 6) AS close, round(coalesce(volume, dv), 6) AS volume FROM h LEFT JOIN m USING (symbol, ts)")
def impute_knn(spark: SparkSession, d: str) -> DataFrame:
    i = F.row_number().over(X.series())
    df = B.events_1h(spark, d).withColumns({"close": F.when(i % 17 != 0, F.col("close")), "volume": F.when(i % 23 != 0, F.col("volume"))})
    return rounded(clean.knn_imputed(df, ["open", "close", "volume"]).select("symbol", "ts", "close", "volume"), 6)


@query(with_(EVENTS) + f"SELECT symbol, ts, round(coalesce(close / nullif(close - lag(close) OVER s, 0), 0), 6) + 0.0 AS ratio FROM bars WINDOW s AS ({SERIES})")
def safe_ratio(spark: SparkSession, d: str) -> DataFrame:
    df = B.events_1h(spark, d).withColumn("ratio", clean.safe_divide(F.col("close"), F.col("close") - X.lag("close")))
    return rounded(df.select("symbol", "ts", "ratio"), 6)


# Bars from files and from a service.


@query(with_(EVENTS) + "SELECT * FROM bars")
def bar_files(spark: SparkSession, d: str) -> DataFrame:
    """Bars written as tab-separated files without a header, day and time apart, and read back."""
    path = scratch(spark, "bar-files")
    bars = B.events_1h(spark, d).select("symbol", "timeframe", F.date_format("ts", "yyyy.MM.dd"), F.date_format("ts", "HH:mm:ss"), "open", "high", "low", "close", "volume")
    bars.write.option("sep", "\t").csv(path)
    return files.bar_files(spark, path, separator="\t", columns=["symbol", "timeframe", "day", "time", "open", "high", "low", "close", "volume"])


@query(with_(EVENTS) + "SELECT symbol, timeframe, ts, open, high, low, close, volume FROM bars WHERE ts >= (SELECT min(ts) + INTERVAL 10 DAY FROM bars)")
def bar_files_since(spark: SparkSession, d: str) -> DataFrame:
    """Bars written with a header of other names and read back from a day on."""
    path = scratch(spark, "bar-files")
    bars = B.events_1h(spark, d)
    bars.select("symbol", "timeframe", F.col("ts").cast("string").alias("Date"), *[F.col(c).alias(c.capitalize()) for c in ("open", "high", "low", "close", "volume")]).write.option("header", True).csv(path)
    first = bars.agg(F.min("ts")).first()[0]
    return files.bar_files(spark, path, since=str(first + timedelta(days=10)))


@query(with_(EVENTS, "e AS (SELECT min(ts) AS a FROM bars)") + "SELECT bars.* FROM bars, e WHERE symbol IN ('click', 'purchase') AND ts <= a + INTERVAL 400 HOUR QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 150")
def bars_from_service(spark: SparkSession, d: str) -> DataFrame:
    """The last 150 bars of two symbols up to a time, page by page, from a service over the tables."""
    from . import sources

    path, first, _ = sources._base(spark, B.events_1h(spark, d))
    return service.fetched(spark, "klines", ["click", "purchase"], "H1", first.isoformat(), (first + timedelta(hours=400)).isoformat(), f"{sources.__name__}.served", 150, base=path, page="120")
