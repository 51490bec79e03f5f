"""Queries: label sequences, their evaluation, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import features as X
from tidegauge.operators import metrics as M
from tidegauge.operators import regimes as G
from tidegauge.operators import select as S
from tidegauge.operators import splits as P
from tidegauge.sources import bars as B

from .sql import EVENTS, RETURNS, SERIES, frame, roll, with_

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def query(sql: str | None = None):
    def named(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return named


def labelled(spark: SparkSession, d: str, load=B.events_1h) -> DataFrame:
    """Hourly bars with returns, vol (of 20 returns) and regime: its tercile in the series, of rows that have one."""
    df = X.with_returns(load(spark, d)).withColumn("vol", X.volatility("returns", 20)).where("vol IS NOT NULL")
    return G.quantile_labels(df, "vol", 3)


LABELS = f"""v AS (SELECT *, {roll('stddev_samp({})', 'returns', 20)} AS vol FROM r), q AS (SELECT symbol, timeframe, quantile_cont(vol, 1.0::DOUBLE / 3) AS q1, quantile_cont(vol, 2.0::DOUBLE / 3) AS q2 FROM v WHERE vol IS NOT NULL GROUP BY ALL),
  l AS (SELECT v.*, (vol > q1)::INT + (vol > q2)::INT AS regime FROM v JOIN q USING (symbol, timeframe) WHERE vol IS NOT NULL)"""
BASE = (EVENTS, RETURNS, LABELS)
RUNS = f"c AS (SELECT *, CASE WHEN regime <> lag(regime) OVER ({SERIES}) THEN 1 ELSE 0 END AS ch, lag(regime) OVER ({SERIES}) AS before FROM l), n AS (SELECT *, sum(ch) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) AS run FROM c), runs AS (SELECT symbol, timeframe, run, any_value(regime) AS regime, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS length FROM n GROUP BY symbol, timeframe, run)"


@query(with_(*BASE) + "SELECT symbol, ts, round(returns, 6) AS returns, round(vol, 6) AS vol, regime FROM l")
def regime_labels(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).select("symbol", "ts", F.round("returns", 6).alias("returns"), F.round("vol", 6).alias("vol"), "regime")


_NEXT = f"p AS (SELECT symbol, regime AS from_regime, lead(regime) OVER ({SERIES}) AS to_regime FROM l)"


@query(with_(*BASE, _NEXT) + "SELECT from_regime, to_regime, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY from_regime), 9) AS p FROM p WHERE to_regime IS NOT NULL GROUP BY from_regime, to_regime")
def regime_transitions(spark: SparkSession, d: str) -> DataFrame:
    return M.transition_matrix(labelled(spark, d)).withColumn("p", F.round("p", 9))


@query(with_(*BASE, _NEXT, "k AS (SELECT unnest([0, 1, 2, 3]) AS i)", "a AS (SELECT DISTINCT symbol FROM l)", "m AS (SELECT symbol, from_regime, to_regime, count(*) AS n FROM p WHERE to_regime IS NOT NULL GROUP BY ALL)", "f AS (SELECT a.symbol, k.i::INT AS from_regime, j.i::INT AS to_regime, coalesce(n, 0) AS n FROM a, k, k AS j LEFT JOIN m ON m.symbol = a.symbol AND m.from_regime = k.i AND m.to_regime = j.i)") + "SELECT symbol, from_regime, to_regime, n, round((n + 0.01) / sum(n + 0.01) OVER (PARTITION BY symbol, from_regime), 9) AS p FROM f")
def regime_transitions_dense(spark: SparkSession, d: str) -> DataFrame:
    return M.transition_matrix(labelled(spark, d), 4, 0.01, by=("symbol",)).withColumn("p", F.round("p", 9))


@query(with_(*BASE, RUNS) + "SELECT symbol, run::BIGINT AS run, regime, start_ts, end_ts, length FROM runs")
def regime_runs(spark: SparkSession, d: str) -> DataFrame:
    return G.runs(labelled(spark, d)).select("symbol", F.col("run").cast("long").alias("run"), "regime", "start_ts", "end_ts", "length")


@query(with_(*BASE, RUNS) + f"SELECT symbol, ts, (CASE WHEN row_number() OVER ({SERIES}) = 1 THEN 0 ELSE row_number() OVER (PARTITION BY symbol, timeframe, run ORDER BY ts) END)::BIGINT AS duration FROM n")
def regime_duration(spark: SparkSession, d: str) -> DataFrame:
    return G.with_duration(labelled(spark, d)).select("symbol", "ts", "duration")


@query(with_(*BASE, RUNS, f"i AS (SELECT *, row_number() OVER ({SERIES}) AS i FROM n)", f"j AS (SELECT *, coalesce(last_value(CASE WHEN ch = 1 THEN i END IGNORE NULLS) OVER ({SERIES} ROWS UNBOUNDED PRECEDING), 1) AS last FROM i)") + f"SELECT symbol, ts, {', '.join(f'round(avg((regime = {k})::INT) OVER {frame(50)}, 9) AS freq_{k}' for k in range(3))}, ch AS change, round(avg(ch) OVER {frame(50)}, 9) AS change_rate, i - last AS since_change, round(CASE WHEN i >= 20 THEN 1 - sum(ch) OVER {frame(19)} / 19 END, 9) AS stability FROM j")
def regime_window_features(spark: SparkSession, d: str) -> DataFrame:
    df = G.with_transitions(G.with_frequency(labelled(spark, d), [0, 1, 2])).withColumn("stability", G.stability(20))
    cols = [F.round(c, 9).alias(c) for c in ("freq_0", "freq_1", "freq_2", "change_rate", "stability")]
    return df.select("symbol", "ts", "change", "since_change", *cols)


@query(with_(*BASE, f"w AS (SELECT symbol, timeframe, ts, unnest(list(regime) OVER ({SERIES} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS r FROM l)", "k AS (SELECT symbol, ts, r, count(*) AS n FROM w GROUP BY ALL)") + "SELECT symbol, ts, arg_min(r, {'a': -n, 'b': r}) AS smoothed FROM k GROUP BY symbol, ts")
def regime_smoothed(spark: SparkSession, d: str) -> DataFrame:
    return G.smoothed(labelled(spark, d), 5).select("symbol", "ts", "smoothed")


@query(with_(*BASE, "m AS (SELECT symbol, regime, avg(close) AS mean FROM l GROUP BY ALL)") + "SELECT symbol, regime, (row_number() OVER (PARTITION BY symbol ORDER BY mean, regime) - 1)::INT AS new_label FROM m")
def regime_mapping(spark: SparkSession, d: str) -> DataFrame:
    return G.mapping(labelled(spark, d), "close", [0, 1, 2]).select("symbol", "regime", "new_label")


@query(with_(EVENTS, RETURNS, f"t AS (SELECT *, row_number() OVER ({SERIES}) AS i, {roll('stddev_samp({})', 'returns', 20)} AS sd, abs(({roll('avg({})', 'close', 20)} - {roll('avg({})', 'close', 50)}) / nullif({roll('avg({})', 'close', 50)}, 0)) AS apart FROM r)") + "SELECT symbol, ts, CASE WHEN i <= 50 THEN 0 WHEN sd > 2.5 THEN 2 WHEN apart > 0.1 THEN 1 ELSE 0 END AS regime FROM t")
def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    return G.rule_labels(B.events_1h(spark, d), 2.5, 0.1).select("symbol", "ts", "regime")


@query(with_(EVENTS, RETURNS, "t AS (SELECT symbol, ts, returns, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE returns IS NOT NULL)") + "SELECT symbol, least(floor(i / floor(n / 3)), 2)::INT AS slice, round(stddev_pop(returns), 9) AS sigma, round(0.1 * pow(stddev_pop(returns), 2), 9) AS omega FROM t GROUP BY ALL")
def slice_parameters(spark: SparkSession, d: str) -> DataFrame:
    df = G.slice_parameters(X.with_returns(B.events_1h(spark, d)), "returns", 3)
    return df.select("symbol", "slice", F.round("sigma", 9).alias("sigma"), F.round("omega", 9).alias("omega"))


@query(with_(*BASE, RUNS) + "SELECT regime, count(*) AS runs, round(avg(length), 9) AS mean_length, round(stddev_pop(length), 9) AS std_length, quantile_cont(length, 0.5)::DOUBLE AS median_length, min(length) AS min_length, max(length) AS max_length FROM runs GROUP BY regime")
def duration_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.duration_stats(labelled(spark, d)).withColumns({c: F.round(c, 9) for c in ("mean_length", "std_length")})


@query(with_(*BASE, RUNS) + "SELECT count(*) AS n_rows, sum(ch)::BIGINT AS changes, count(before) AS steps, (SELECT count(*) FROM runs) AS runs, round((SELECT avg(length) FROM runs), 9) AS mean_length, round((SELECT stddev_pop(length) FROM runs), 9) AS std_length, round(sum(ch) / count(before), 9) AS transition_rate, round(1 - sum(ch) / count(before), 9) AS persistence FROM n")
def stability(spark: SparkSession, d: str) -> DataFrame:
    return M.stability(labelled(spark, d)).withColumns({c: F.round(c, 9) for c in ("mean_length", "std_length", "transition_rate", "persistence")})


@query(with_(*BASE, _NEXT) + "SELECT from_regime AS regime, count(*) AS n_rows, count(*) FILTER (WHERE from_regime <> to_regime) AS exits, round(count(*) FILTER (WHERE from_regime <> to_regime) / count(*), 9) AS flip_rate FROM p WHERE to_regime IS NOT NULL GROUP BY from_regime")
def flip_rates(spark: SparkSession, d: str) -> DataFrame:
    return M.flip_rates(labelled(spark, d)).withColumn("flip_rate", F.round("flip_rate", 9))


@query(with_(*BASE, RUNS) + f"SELECT symbol, ts, round(CASE WHEN row_number() OVER ({SERIES}) > 20 THEN sum(ch) OVER ({SERIES} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) / 19 END, 9) AS flip_rate FROM n")
def windowed_flip_rate(spark: SparkSession, d: str) -> DataFrame:
    return M.with_windowed_flip_rate(labelled(spark, d)).select("symbol", "ts", F.round("flip_rate", 9).alias("flip_rate"))


@query(with_(*BASE, RUNS, "p AS (SELECT regime, avg(length) AS mean, sum(length) AS n FROM runs GROUP BY regime)") + "SELECT round(sum(CASE WHEN mean >= 20 THEN n ELSE 0 END) / sum(n), 9) AS consistency FROM p")
def consistency(spark: SparkSession, d: str) -> DataFrame:
    return M.consistency(labelled(spark, d), 20).withColumn("consistency", F.round("consistency", 9))


@query(with_(*BASE, "k AS (SELECT regime, count(*) AS n FROM l GROUP BY regime)", "p AS (SELECT *, n / sum(n) OVER () AS p, row_number() OVER (ORDER BY n, regime) AS i FROM k)") + "SELECT count(*) AS labels, round(-sum(p * ln(p)), 9) AS entropy, round(-sum(p * ln(p)) / ln(count(*)), 9) AS normalized_entropy, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 9) AS gini, arg_min(regime, {'a': -n, 'b': regime}) AS dominant FROM p")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    return M.distribution(labelled(spark, d)).withColumns({c: F.round(c, 9) for c in ("entropy", "normalized_entropy", "gini")})


@query(with_(*BASE, f"w AS (SELECT *, list(regime) OVER ({SERIES} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS a FROM l)") + "SELECT symbol, ts, round(len(list_filter(a, lambda x: x = regime)) / len(a), 9) AS same FROM w")
def temporal_consistency(spark: SparkSession, d: str) -> DataFrame:
    return M.with_temporal_consistency(labelled(spark, d)).select("symbol", "ts", F.round("same", 9).alias("same"))


@query(with_(*BASE, RUNS, "d AS (SELECT regime, avg(length) AS mean_duration FROM runs GROUP BY regime)") + "SELECT regime, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share, round(any_value(mean_duration), 9) AS mean_duration, round(avg(close), 6) AS close_mean, round(stddev_pop(close), 6) AS close_std, min(close) AS close_min, max(close) AS close_max, round(quantile_cont(close, 0.5), 6) AS close_median FROM l JOIN d USING (regime) GROUP BY regime")
def regime_statistics(spark: SparkSession, d: str) -> DataFrame:
    df = M.regime_statistics(labelled(spark, d), ["close"])
    return df.select("regime", "n", F.round("share", 9).alias("share"), F.round("mean_duration", 9).alias("mean_duration"), F.round("close_mean", 6).alias("close_mean"), F.round("close_std", 6).alias("close_std"), "close_min", "close_max", F.round("close_median", 6).alias("close_median"))


_T = "t AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS tt FROM t), sa AS (SELECT sum(x * (x - 1) / 2) AS v, -sum(x / s * ln(x / s)) AS h FROM (SELECT sum(n) AS x, any_value(tt) AS s FROM u GROUP BY a)), sb AS (SELECT sum(x * (x - 1) / 2) AS v, -sum(x / s * ln(x / s)) AS h, sum(m) AS top FROM (SELECT sum(n) AS x, any_value(tt) AS s, max(n) AS m FROM u GROUP BY b)), sn AS (SELECT sum(n * (n - 1) / 2) AS v, sum(n / tt * ln(n * tt / (na * nb))) AS mi, any_value(tt) AS tt, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM u)"


@query(f"WITH {_T} SELECT round(same / tt, 9) AS accuracy, round(top / tt, 9) AS purity, round((sn.v - sa.v * sb.v / (tt * (tt - 1) / 2)) / ((sa.v + sb.v) / 2 - sa.v * sb.v / (tt * (tt - 1) / 2)), 9) AS adjusted_rand, round(mi, 9) AS mutual_info, round(mi / ((sa.h + sb.h) / 2), 9) AS normalized_mutual_info FROM sn, sa, sb")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    df = M.agreement(spark.read.parquet(f"{d}/labels.parquet"), "quality", "toxic")
    return df.select(*[F.round(c, 9).alias(c) for c in df.columns])


_FEATURES = ["close", "vol", "volume"]


def _apart(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"pow({a}.{c} - {b}.{c}, 2)" for c in _FEATURES) + ")"


_MEANS = ", ".join(f"avg({c}) AS {c}" for c in _FEATURES)
_CLUSTER = f"""x AS (SELECT symbol, ts, regime, close, vol, volume FROM l), m AS (SELECT regime, count(*) AS n, {_MEANS} FROM x GROUP BY regime), g AS (SELECT count(*) AS n, {_MEANS} FROM x),
  o AS (SELECT x.regime, {_apart('x', 'm')} AS off FROM x JOIN m USING (regime)), s AS (SELECT regime, avg(off) AS s, sum(off * off) AS w, sum(off) AS o FROM o GROUP BY regime),
  p AS (SELECT a.regime, max((sa.s + sb.s) / {_apart('a', 'b')}) AS r, sum({_apart('a', 'b')}) AS d, count(*) AS k FROM m a JOIN m b ON a.regime <> b.regime JOIN s sa ON sa.regime = a.regime JOIN s sb ON sb.regime = b.regime GROUP BY a.regime),
  t AS (SELECT count(*) AS k, sum(w) AS w, sum(o) AS o FROM s), b AS (SELECT sum(m.n * pow({_apart('m', 'g')}, 2)) AS b, any_value(g.n) AS n FROM m, g)"""


@query(with_(*BASE, _CLUSTER) + "SELECT (SELECT round(avg(r), 6) FROM p) AS davies_bouldin, round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz, round((SELECT sum(d) / sum(k) FROM p) / (o / n), 6) AS separation FROM t, b")
def cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    df = M.cluster_quality(labelled(spark, d), _FEATURES)
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query(with_(*BASE, _CLUSTER, f"d AS (SELECT i.symbol, i.ts, i.regime AS a, j.regime AS b, sum({_apart('i', 'j')}) AS d, count(*) AS n FROM x i, x j GROUP BY ALL)", "e AS (SELECT symbol, ts, max(CASE WHEN a = b AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN a <> b THEN d / n END) AS b FROM d GROUP BY symbol, ts)") + "SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM e")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    df = M.silhouette(labelled(spark, d), _FEATURES)
    return df.withColumn("silhouette", F.round("silhouette", 6))


@query(with_(*BASE) + " UNION ALL ".join(f"SELECT regime, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM l GROUP BY regime" for a, b in (("close", "vol"), ("close", "volume"), ("vol", "volume"))))
def regime_correlations(spark: SparkSession, d: str) -> DataFrame:
    return M.regime_correlations(labelled(spark, d), _FEATURES).withColumn("corr", F.round("corr", 6))


_P = "f AS (SELECT symbol, ts, regime, [CASE WHEN regime = 0 THEN 0.7 ELSE 0.15 END + x, 0.3, CASE WHEN regime = 0 THEN 0 ELSE 0.55 END - x] AS p FROM (SELECT *, (hour(ts) % 5) / 100.0::DOUBLE AS x FROM l))"


def _probable(spark: SparkSession, d: str) -> DataFrame:
    x, zero = (F.hour("ts") % 5) / 100.0, F.col("regime") == 0
    return labelled(spark, d).withColumn("p", F.array(F.when(zero, 0.7).otherwise(0.15) + x, F.lit(0.3), F.when(zero, 0.0).otherwise(0.55) - x))


@query(with_(*BASE, _P, "g AS (SELECT symbol, ts, p, list_max(p) AS top, list_reverse_sort(p) AS s FROM f)") + "SELECT symbol, ts, (list_position(p, top) - 1)::INT AS crisp, round(s[1] - s[2], 9) AS margin, CASE WHEN top < 0.6 THEN -1 ELSE (list_position(p, top) - 1)::INT END AS uncertain, round(-list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) / ln(3), 9) AS entropy_share, round(CASE WHEN top >= 0.6 THEN (list_position(p, top) = 1)::INT ELSE CASE WHEN p[1] < 0.5 / 3 THEN 0 ELSE p[1] END / list_sum(list_transform(p, lambda v: CASE WHEN v < 0.5 / 3 THEN 0 ELSE v END)) END, 9) AS fuzzy_0 FROM g")
def probability_rules(spark: SparkSession, d: str) -> DataFrame:
    df = _probable(spark, d)
    return df.select("symbol", "ts", G.crisp("p").alias("crisp"), F.round(G.margin("p"), 9).alias("margin"), G.uncertain("p").alias("uncertain"), F.round(G.entropy_share("p"), 9).alias("entropy_share"), F.round(F.get(G.fuzzy("p"), 0), 9).alias("fuzzy_0"))


@query(with_(*BASE, _P, "g AS (SELECT list_max(p) AS top, list_reverse_sort(p) AS s, -list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) AS e FROM f)") + "SELECT round(avg(top), 6) AS mean_confidence, round(stddev_pop(top), 6) AS std_confidence, round(min(top), 6) AS min_confidence, round(max(top), 6) AS max_confidence, round(avg(e), 6) AS mean_entropy, round(avg(s[1] - s[2]), 6) AS mean_margin FROM g")
def confidence(spark: SparkSession, d: str) -> DataFrame:
    df = M.confidence(_probable(spark, d), "p")
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


_VOTES = "w AS (SELECT symbol, ts, [regime, (vol > 1.5)::INT * 2, (close > 50)::INT] AS v FROM l), k AS (SELECT symbol, ts, any_value(v) AS v, x, count(*) AS n FROM (SELECT *, unnest(v) AS x FROM w) GROUP BY symbol, ts, x), t AS (SELECT symbol, ts, arg_min(x, {'a': -n, 'b': x}) AS modal, max(n) / 3 AS share, any_value(v)[1] AS first FROM k GROUP BY symbol, ts)"


@query(with_(*BASE, _VOTES) + "SELECT symbol, ts, modal, round(share, 9) AS share, CASE WHEN share >= 0.6 THEN modal ELSE first END AS consensus FROM t")
def ensemble_votes(spark: SparkSession, d: str) -> DataFrame:
    votes = F.array("regime", (F.col("vol") > 1.5).cast("int") * 2, (F.col("close") > 50).cast("int"))
    df = labelled(spark, d).withColumn("v", votes)
    return df.select("symbol", "ts", G.modal("v").alias("modal"), F.round(G.modal_share("v"), 9).alias("share"), G.consensus("v").alias("consensus"))


# Folds.


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return P.numbered(labelled(spark, d, B.events_all_1h)).select("symbol", "timeframe", "ts", "regime", "row_no")


#: Folds are of one series: all events'.
_ALL = (EVENTS.replace("event_type AS symbol", "'(all)' AS symbol"), RETURNS, LABELS)
_ROWS = f"x AS (SELECT symbol, ts, regime, row_number() OVER ({SERIES}) - 1 AS row_no, count(*) OVER () AS n FROM l)"


@query(with_(*_ALL, _ROWS, "k AS (SELECT unnest(range(0, 100)) AS fold)") + "SELECT fold::INT AS fold, CASE WHEN row_no < fold * 21 + 252 THEN 'train' ELSE 'test' END AS role, row_no FROM x JOIN k ON row_no BETWEEN fold * 21 AND fold * 21 + 314 AND fold * 21 + 315 < n")
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, d)
    return P.assigned(df, P.walk_forward_ranges(df.count())).select("fold", "role", "row_no")


@query(with_(*_ALL, _ROWS, "k AS (SELECT unnest(range(0, 5)) AS fold)", "b AS (SELECT fold, n - (5 - fold) * (n // 6) AS s, n // 6 AS size FROM k, (SELECT any_value(n) AS n FROM x))") + "SELECT fold::INT AS fold, CASE WHEN row_no < s THEN 'train' ELSE 'test' END AS role, row_no FROM x JOIN b ON row_no <= s - 5 - 1 OR row_no BETWEEN s AND s + size - 1")
def time_series_split(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, d)
    return P.assigned(df, P.time_series_ranges(df.count(), 5, gap=5)).select("fold", "role", "row_no")


@query(with_(*_ALL, _ROWS, "k AS (SELECT unnest(range(0, 5)) AS fold)", "b AS (SELECT fold, fold * (n // 5) + least(fold, n % 5) AS lo, (fold + 1) * (n // 5) + least(fold + 1, n % 5) - 1 AS hi FROM k, (SELECT any_value(n) AS n FROM x))") + "SELECT fold::INT AS fold, CASE WHEN row_no BETWEEN lo AND hi THEN 'test' ELSE 'train' END AS role, row_no FROM x JOIN b ON row_no < lo - 10 OR row_no > hi + 10 OR row_no BETWEEN lo AND hi - 3")
def purged_split(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, d)
    return P.assigned(df, P.purged_ranges(df.count(), 5, 10, 3)).select("fold", "role", "row_no")


@query(with_(*_ALL, _ROWS, RUNS, "k AS (SELECT unnest(range(0, 3)) AS fold)", "e AS (SELECT fold::INT AS fold, CASE WHEN run % 3 = fold THEN 'test' ELSE 'train' END AS role, regime, row_number() OVER (PARTITION BY fold ORDER BY ts) - 1 AS row_no FROM n, k)", "few AS (SELECT fold FROM e GROUP BY fold, regime HAVING count(*) FILTER (WHERE role = 'train') < 2)") + "SELECT fold, role, row_no FROM e WHERE fold NOT IN (SELECT fold FROM few)")
def regime_aware_split(spark: SparkSession, d: str) -> DataFrame:
    return P.regime_aware(labelled(spark, d, B.events_all_1h), 3).select("fold", "role", "row_no")


# Selection of features.


@query(with_(*BASE) + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_pop({c}), 6) AS variance, var_pop({c}) > 100 AS kept FROM l" for c in ("close", "returns", "vol", "volume")))
def variance_selection(spark: SparkSession, d: str) -> DataFrame:
    df = S.variances(labelled(spark, d), ["close", "returns", "vol", "volume"])
    return df.select("feature", F.round("variance", 6).alias("variance"), (F.col("variance") > 100).alias("kept"))


@query(with_(*BASE) + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 6) AS corr FROM l" for a, b in (("open", "high"), ("open", "close"), ("high", "close"))))
def correlation_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.correlations(labelled(spark, d), ["open", "high", "close"]).select("a", "b", F.round(F.abs("corr"), 6).alias("corr"))


@query(with_(*BASE, "k AS (SELECT regime, count(*) AS n, avg(close) AS m, var_samp(close) AS v FROM l GROUP BY regime)", "g AS (SELECT avg(close) AS m, count(*) AS n FROM l)") + "SELECT 'close' AS feature, round((sum(k.n * pow(k.m - g.m, 2)) / (count(*) - 1)) / (sum((k.n - 1) * v) / (any_value(g.n) - count(*))), 6) AS score FROM k, g")
def anova_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.anova(labelled(spark, d), ["close"], "regime").select("feature", F.round("score", 6).alias("score"))


# Reports over models and data sets.

_SCORES = "x AS (SELECT symbol AS dataset, 'q' || regime::VARCHAR AS model, round(avg(close), 1) AS score FROM l GROUP BY ALL)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).groupBy(F.col("symbol").alias("dataset"), F.concat(F.lit("q"), F.col("regime").cast("string")).alias("model")).agg(F.round(F.avg("close"), 1).alias("score"))


@query(with_(*BASE, _SCORES) + "SELECT dataset, model, score, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0::DOUBLE AS rank, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, model) <= 2 AS in_top FROM x")
def model_ranks(spark: SparkSession, d: str) -> DataFrame:
    from tidegauge.operators import reports

    return reports.ranked(_scores(spark, d), 2)


@query(with_(*BASE, _SCORES) + "SELECT model, " + ", ".join(f"max(score) FILTER (WHERE dataset = '{t}') AS \"{t}\"" for t in EVENT_TYPES) + " FROM x GROUP BY model")
def model_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).groupBy("model").pivot("dataset", list(EVENT_TYPES)).agg(F.max("score"))


_POS = f"b AS (SELECT symbol, timeframe, ts, regime, returns, coalesce(lag(CASE regime WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0 END) OVER ({SERIES}), 0)::DOUBLE AS position FROM (SELECT * REPLACE (greatest(least(returns / 100, 0.05), -0.05) AS returns) FROM l)), c AS (SELECT *, position * returns - 0.001 * abs(position - coalesce(lag(position) OVER ({SERIES}), 0)) AS net FROM b), e AS (SELECT *, exp(sum(ln(1 + net)) OVER ({SERIES} ROWS UNBOUNDED PRECEDING)) AS equity FROM c)"


@query(with_(*BASE, _POS) + f"SELECT symbol, ts, position, round(net, 11) + 0.0 AS net, round(equity, 11) AS equity, round(equity / max(equity) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) - 1, 11) + 0.0 AS drawdown FROM e")
def backtest(spark: SparkSession, d: str) -> DataFrame:
    from tidegauge.operators import reports

    df = labelled(spark, d).withColumn("returns", F.greatest(F.least(F.col("returns") / 100, F.lit(0.05)), F.lit(-0.05)))
    out = reports.backtested(df, {0: 1.0, 1: 0.5, 2: 0.0}, cost=0.001)
    return out.select("symbol", "ts", "position", *[(F.round(c, 11) + F.lit(0.0)).alias(c) for c in ("net", "equity", "drawdown")])
