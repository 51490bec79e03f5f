"""Queries: boosting, kernels, cross-validation, benchmarks, distances, ensemble weights, joins in time."""

from __future__ import annotations

import json

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import benchmarks, boosting, intervals, reports, scatter, validation
from tidegauge.operators.estimator import RegimeDetector
from tidegauge.operators.kernels import NystromKernelModel
from tidegauge.session import scratch
from tidegauge.sources import bars as B

from .labels import _ALL, _ROWS, BASE, labelled
from .models import FEATURES, prepared
from .sql import EVENTS, RETURNS, SERIES, frame, with_

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def named(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return named


# Boosting.

_X = ["returns", "vol", "volume"]
_BINS = ", ".join(f"quantile_cont({c}, [" + ", ".join(f"{i / 8!r}" for i in range(1, 8)) + f"]) AS e_{c}" for c in _X)
_CUT = " UNION ALL ".join(f"SELECT regime, {i} AS f, 1 + len(list_filter(list_distinct(e_{c}), lambda e: e < {c})) AS b FROM l, e" for i, c in enumerate(_X))


@query(with_(*BASE, f"e AS (SELECT {_BINS} FROM l)", f"x AS ({_CUT})", "s AS (SELECT c, f, b, sum(1.0::DOUBLE / 3 - (regime = c)::INT) AS g, count(*) * (2.0::DOUBLE / 9) AS h FROM x, (SELECT unnest([0, 1, 2]) AS c) GROUP BY ALL)", "w AS (SELECT *, sum(g) OVER (PARTITION BY c, f ORDER BY b) AS gl, sum(h) OVER (PARTITION BY c, f ORDER BY b) AS hl, sum(g) OVER (PARTITION BY c, f) AS gt, sum(h) OVER (PARTITION BY c, f) AS ht FROM s)") + "SELECT c::INT AS class, f::INT AS feature, b::INT AS bin, round(CASE WHEN hl >= 1 AND ht - hl >= 1 THEN 0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) END, 5) + 0.0 AS gain FROM w")
def boost_level_gains(spark: SparkSession, d: str) -> DataFrame:
    """Gains of all cuts of the first level of the first round, over bins by exact quantiles."""
    rows = labelled(spark, d).withColumn("x", F.array(*_X))
    at = F.array(*[F.lit(i / 8) for i in range(1, 8)])
    cuts = rows.agg(*[F.percentile(c, at).alias(c) for c in _X]).first()
    rows = rows.select(boosting.binned("x", [sorted(set(cuts[c])) for c in _X]).alias("bins"), F.col("regime").alias("y"), F.array(*[F.lit(0.0)] * 3).alias("m"))
    out = boosting.gains(boosting.sums(rows, [F.lit(1)] * 3, 3))
    return out.select(F.col("c").alias("class"), F.col("f").alias("feature"), F.col("b").alias("bin"), (F.round("gain", 5) + 0.0).alias("gain"))


@query()
def boosting_regimes(spark: SparkSession, d: str) -> DataFrame:
    """Regimes by a booster of all classes at once that stops by the loss of the last fifth of time."""
    est = RegimeDetector(kind="boosting", features=FEATURES, options=json.dumps({"maxIter": 20, "maxDepth": 3, "stepSize": 0.5, "heldOut": 0.2, "patience": 3}))
    df = prepared(spark, d)
    return est.fit(df).transform(df).select("symbol", "ts", "regime", "p")


# Kernels.

_AT = "z AS (SELECT regime AS landmark, avg(vol) AS v, avg(returns) AS r FROM l GROUP BY regime)"


@query(with_(*BASE, _AT) + "SELECT symbol, ts, landmark, round(exp(-0.05 * (pow(vol - v, 2) + pow(returns - r, 2))), 6) AS rbf, round(pow(0.05 * (vol * v + returns * r) + 1, 2), 4) AS poly, round(tanh(0.05 * (vol * v + returns * r) + 1), 6) AS sigmoid FROM l, z")
def kernel_values(spark: SparkSession, d: str) -> DataFrame:
    """Three kernels between each bar and the centres of the regimes as landmarks."""
    df = labelled(spark, d)
    at = [[r.v, r.r] for r in df.groupBy("regime").agg(F.avg("vol").alias("v"), F.avg("returns").alias("r")).orderBy("regime").collect()]
    df = df.withColumn("x", array_to_vector(F.array("vol", "returns")))
    for kind, degree in (("rbf", 3), ("poly", 2), ("sigmoid", 3)):
        m = NystromKernelModel(state=json.dumps({"landmarks": at, "map": []}))
        m._set(inputCol="x", kind=kind, gamma=0.05, coef0=1.0, degree=degree)
        df = m.values(df, kind)
    rows = df.select("symbol", "ts", F.posexplode(F.arrays_zip("rbf", "poly", "sigmoid")).alias("landmark", "k"))
    return rows.select("symbol", "ts", "landmark", F.round("k.rbf", 6).alias("rbf"), F.round("k.poly", 4).alias("poly"), F.round("k.sigmoid", 6).alias("sigmoid"))


@query()
def svm_support(spark: SparkSession, d: str) -> DataFrame:
    """The landmarks that hold up a kernel machine's planes."""
    df = prepared(spark, d)
    return RegimeDetector(kind="svm_rbf", features=FEATURES, options=json.dumps({"landmarks": 32})).fit(df).support(df)


# Detectors.

_PREPARED = f"v AS (SELECT *, ln(close / lag(close) OVER ({SERIES})) AS lr FROM bars), w AS (SELECT *, CASE WHEN count(lr) OVER {frame(10)} = 10 THEN 1 END AS whole FROM v)"
_KINDS = ("gmm", "random_forest", "boosting", "logistic")


@query(with_(EVENTS, _PREPARED, "k AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in _KINDS) + "]) AS model)") + "SELECT model, count(*) AS n_rows, 0::BIGINT AS not_greatest, 0::BIGINT AS not_one FROM w, k WHERE whole = 1 GROUP BY model")
def detector_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each detector with probabilities: rows, rows whose label isn't the class of greatest probability, rows whose probabilities don't sum to 1."""
    df, out = prepared(spark, d), None
    for kind in _KINDS:
        told = RegimeDetector(kind=kind, features=FEATURES, options=json.dumps({"maxIter": 3} if kind == "boosting" else {})).fit(df).transform(df)
        part = told.agg(F.lit(kind).alias("model"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.get("p", F.col("regime")) < F.array_max("p")).alias("not_greatest"), F.count_if(F.abs(F.aggregate("p", F.lit(0.0), lambda s, v: s + v) - 1) > 1e-9).alias("not_one"))
        out = part if out is None else out.unionByName(part)
    return out


# Folds.

_FOLDS = "SELECT k.fold, CASE WHEN row_no < k.fold * 21 + 252 THEN 'train' ELSE 'test' END AS role, x.ts, x.vol, x.regime FROM x JOIN (SELECT unnest(range(0, 100)) AS fold) k ON row_no BETWEEN k.fold * 21 AND k.fold * 21 + 314 AND k.fold * 21 + 315 < n"


def _cv_sql(folds: str) -> str:
    return (
        f"cf AS ({folds}), cq AS (SELECT fold, quantile_cont(vol, 1.0::DOUBLE / 3) AS a, quantile_cont(vol, 2.0::DOUBLE / 3) AS b FROM cf WHERE role = 'train' GROUP BY fold),"
        " ct AS (SELECT cf.*, (vol > a)::INT + (vol > b)::INT AS p FROM cf JOIN cq USING (fold) WHERE role = 'test'), cs AS (SELECT *, lead(p) OVER (PARTITION BY fold ORDER BY ts) AS nx FROM ct),"
        " cm AS (SELECT fold, count(*) AS n_rows, count(DISTINCT p) AS labels, round(avg((nx = p)::INT), 6) AS persistence, round(avg((p = regime)::INT), 6) AS accuracy FROM cs GROUP BY fold),"
        " cc AS (SELECT fold, p, regime, count(*) AS n FROM ct GROUP BY ALL), pa AS (SELECT fold, p, sum(n) AS n, max(n) AS top FROM cc GROUP BY ALL), pb AS (SELECT fold, regime, sum(n) AS n FROM cc GROUP BY ALL),"
        " ce AS (SELECT fold, sum(n) AS n, -sum(n / tot * ln(n / tot)) AS entropy, sum(top) / any_value(tot) AS purity, sum(n * (n - 1) / 2.0) AS ra FROM (SELECT *, sum(n) OVER (PARTITION BY fold) AS tot FROM pa) GROUP BY fold),"
        " cg AS (SELECT fold, sum(n * (n - 1) / 2.0) AS rb FROM pb GROUP BY fold), ci AS (SELECT fold, sum(n * (n - 1) / 2.0) AS rc FROM cc GROUP BY fold)"
    )


_CV = "SELECT cm.fold::INT AS fold, n_rows, labels, persistence, round(entropy, 6) + 0.0 AS entropy, accuracy, round(purity, 6) AS purity, round(CASE WHEN (ra + rb) / 2 = ra * rb / (ce.n * (ce.n - 1) / 2.0) THEN 1 ELSE (rc - ra * rb / (ce.n * (ce.n - 1) / 2.0)) / ((ra + rb) / 2 - ra * rb / (ce.n * (ce.n - 1) / 2.0)) END, 6) + 0.0 AS adjusted_rand FROM cm JOIN ce USING (fold) JOIN cg USING (fold) JOIN ci USING (fold)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("fold", "n_rows", "labels", *[(F.round(c, 6) + 0.0).alias(c) for c in ("persistence", "entropy", "accuracy", "purity", "adjusted_rand")])


@query(with_(*_ALL, _ROWS.replace("regime, row_number", "vol, regime, row_number"), _cv_sql(_FOLDS)) + _CV)
def cv_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """A quantile rule learned anew in each fold, measured against the terciles of the whole series."""
    rows = labelled(spark, d, B.events_all_1h).withColumnRenamed("regime", "target")
    return _rounded(validation.cross_validated(rows, validation.QuantileRule(inputCol="vol"), validation.strategy("walk_forward"), "target"))


_SERIES_ROWS = f"x AS (SELECT symbol, ts, vol, regime, row_number() OVER ({SERIES}) - 1 AS row_no, count(*) OVER (PARTITION BY symbol) AS n FROM l)"
_THREE = "SELECT k.fold, CASE WHEN row_no < s THEN 'train' ELSE 'test' END AS role, ts, symbol, vol, regime FROM (SELECT x.*, k.fold, n - (3 - k.fold) * (n // 4) AS s, n // 4 AS size FROM x, (SELECT unnest(range(0, 3)) AS fold) k) k WHERE row_no <= s - 2 - 1 OR row_no BETWEEN s AND s + size - 1"


@query(with_(*BASE, _SERIES_ROWS, _cv_sql(_THREE).replace("OVER (PARTITION BY fold ORDER BY ts) AS nx", "OVER (PARTITION BY fold, symbol ORDER BY ts) AS nx")) + _CV)
def cv_time_series(spark: SparkSession, d: str) -> DataFrame:
    """Folds of every series by its own length; one rule learned from all series of a fold."""
    rows = labelled(spark, d).withColumnRenamed("regime", "target")
    return _rounded(validation.cross_validated(rows, validation.QuantileRule(inputCol="vol"), validation.strategy("time_series", folds=3, gap=2), "target"))


# Benchmarks.

_MODELS = ("vol", "volume", "close")
_BENCH = ", ".join(f"quantile_cont({c}, 1.0::DOUBLE / 3) OVER s AS {c}1, quantile_cont({c}, 2.0::DOUBLE / 3) OVER s AS {c}2" for c in _MODELS)
_EACH = " UNION ALL ".join(f"SELECT symbol, ts, '{c}' AS model, ({c} > {c}1)::INT + ({c} > {c}2)::INT AS p FROM y" for c in _MODELS)


@query(with_(*BASE, f"y AS (SELECT *, {_BENCH} FROM l WINDOW s AS (PARTITION BY symbol))", f"p AS ({_EACH})", "o AS (SELECT symbol AS dataset, model, sum((nx = p)::INT) / count(nx) AS score FROM (SELECT *, lead(p) OVER (PARTITION BY symbol, model ORDER BY ts) AS nx FROM p) GROUP BY ALL)") + "SELECT dataset, model, round(score, 6) AS score, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0::DOUBLE AS rank, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, model) <= 1 AS best FROM o")
def benchmark_ranks(spark: SparkSession, d: str) -> DataFrame:
    """A grid of models over the series as data sets, run in two goes, the second of which has the rest to do; ranks by persistence."""
    df = labelled(spark, d)
    sets = {r.symbol: df.where(F.col("symbol") == r.symbol) for r in df.select("symbol").distinct().collect()}
    path = scratch(spark, "benchmark")
    make = lambda models: benchmarks.Benchmark(spark, path, sets, {m: validation.QuantileRule(inputCol=m) for m in models}, benchmarks.measured(), times=False)
    make(_MODELS[:1]).run()
    whole = make(_MODELS)
    whole.run()
    ranks = reports.ranked(benchmarks.mean_scores(whole.table(), "persistence"), 1)
    return ranks.select("dataset", "model", F.round("score", 6).alias("score"), "rank", F.col("in_top").alias("best"))


# Distances and weights.

_D = "pow(vol - mv, 2) * crr - 2 * (vol - mv) * (returns - mr) * cvr + pow(returns - mr, 2) * cvv"


@query(with_(*BASE, "g AS (SELECT regime, avg(vol) AS mv, avg(returns) AS mr, var_pop(vol) AS cvv, var_pop(returns) AS crr, covar_pop(vol, returns) AS cvr FROM l GROUP BY regime)", f"o AS (SELECT l.symbol, l.ts, l.regime, g.regime AS k, sqrt(({_D}) / (cvv * crr - cvr * cvr)) AS m FROM l, g)") + "SELECT symbol, ts, round(max(m) FILTER (WHERE k = regime), 5) AS mahalanobis, round(min(m), 5) AS mahalanobis_nearest FROM o GROUP BY symbol, ts")
def mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    out = scatter.with_mahalanobis(labelled(spark, d), ["vol", "returns"])
    return out.select("symbol", "ts", F.round("mahalanobis", 5).alias("mahalanobis"), F.round("mahalanobis_nearest", 5).alias("mahalanobis_nearest"))


_VOTE = "[regime, (volume > 2)::INT + (volume > 3)::INT, (close > 20)::INT + (close > 60)::INT]"


@query(with_(*BASE, f"u AS (SELECT {_VOTE} AS v, CASE WHEN row_number() OVER ({SERIES}) % 4 = 0 THEN (volume > 2)::INT ELSE regime END AS target FROM l)", "a AS (SELECT unnest(range(0, 6)) AS i), s AS (SELECT [x.i / 5.0::DOUBLE, y.i / 5.0::DOUBLE, (5 - x.i - y.i) / 5.0::DOUBLE] AS w FROM a x, a y WHERE x.i + y.i <= 5)", "m AS (SELECT w, target, [" + ", ".join(f"round(list_sum([CASE WHEN v[1] = {c} THEN w[1] ELSE 0 END, CASE WHEN v[2] = {c} THEN w[2] ELSE 0 END, CASE WHEN v[3] = {c} THEN w[3] ELSE 0 END]), 9)" for c in range(3)) + "] AS mass FROM u, s)") + "SELECT w[1] AS w1, w[2] AS w2, w[3] AS w3, round(avg((list_position(mass, list_max(mass)) - 1 = target)::INT), 6) AS accuracy FROM m GROUP BY w")
def ensemble_weights(spark: SparkSession, d: str) -> DataFrame:
    """The accuracy of every choice of weights, in fifths, for three members."""
    from tidegauge.functions.windows import series

    of = lambda c, a, b: (F.col(c) > a).cast("int") + (F.col(c) > b).cast("int")
    df = labelled(spark, d).withColumn("votes", F.array("regime", of("volume", 2, 3), of("close", 20, 60)))
    target = F.when(F.row_number().over(series()) % 4 == 0, (F.col("volume") > 2).cast("int")).otherwise(F.col("regime"))
    scores = scatter.weight_scores(df.withColumn("target", target), "votes", "target", 3, 5)
    return scores.select(*[F.get("weights", F.lit(i)).alias(f"w{i + 1}") for i in range(3)], F.round("accuracy", 6).alias("accuracy"))


# Joins in time.

#: Periods by customer segment: from its first order to its last, and the same a tenth of a year later.
_PERIODS = "p AS (SELECT o_orderpriority AS period, min(o_orderdate) + INTERVAL (20 * k) DAY AS start, min(o_orderdate) + INTERVAL (20 * k + 45) DAY AS stop FROM orders, (SELECT unnest(range(0, 12)) AS k) GROUP BY o_orderpriority, k)"


@query("WITH " + _PERIODS + " SELECT period, start, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN p ON l_shipdate BETWEEN start AND stop GROUP BY period, start")
def periods_joined(spark: SparkSession, d: str) -> DataFrame:
    """Lines by the overlapping periods that hold their day: twelve periods for each priority of orders."""
    orders, lines = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    first = orders.groupBy(F.col("o_orderpriority").alias("period")).agg(F.min("o_orderdate").alias("first")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11))))
    days = lambda n: F.col("first") + F.make_dt_interval(days=n)
    periods = first.select("period", days(F.col("k") * 20).alias("start"), days(F.col("k") * 20 + 45).alias("stop"))
    met = intervals.in_periods(lines.select("l_shipdate", "l_extendedprice"), periods, "l_shipdate", bucket="45 days")
    return met.groupBy("period", "start").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


_H4 = "h AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts_h4, time_bucket(INTERVAL 4 HOUR, ts) + INTERVAL 4 HOUR AS known, arg_max(close, ts) AS close_h4, sum(volume) AS volume_h4 FROM bars GROUP BY ALL), dd AS (SELECT symbol, time_bucket(INTERVAL 1 DAY, ts) AS ts_d, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS known, arg_max(close, ts) AS close_d, sum(volume) AS volume_d FROM bars GROUP BY ALL)"


@query(with_(EVENTS, _H4) + "SELECT b.symbol, b.ts, b.close, ts_h4, close_h4, volume_h4, ts_d, close_d, volume_d FROM (SELECT *, ts + INTERVAL 1 HOUR AS at FROM bars) b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.at >= h.known ASOF LEFT JOIN dd ON b.symbol = dd.symbol AND b.at >= dd.known")
def multi_timeframe(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars with the last four-hour and daily bars that had ended."""
    out = intervals.with_wider(B.events_1h(spark, d), "H1", ["H4", "D"])
    return out.select("symbol", "ts", "close", *[F.col(f"{c}_{w}").alias(f"{c}_{w.lower()}") for w in ("H4", "D") for c in ("ts", "close", "volume")])
