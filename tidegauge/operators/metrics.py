"""Evaluation: transitions, durations, agreement of labels, cluster quality, quality indexes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.windows import KEYS, corr, div, series

from . import regimes as G

LABEL = G.LABEL


# Transitions and durations.


def transition_matrix(df: DataFrame, k: int | None = None, smoothing: float = 0.0, label: str = LABEL, by: tuple[str, ...] = ()) -> DataFrame:
    """by, from_regime, to_regime, n and p; with k all k * k pairs, rows without a transition having p 0."""
    pairs = df.withColumn("_to", F.lead(label).over(series())).where(F.col("_to").isNotNull() & F.col(label).isNotNull())
    found = pairs.groupBy(*by, F.col(label).cast("int").alias("from_regime"), F.col("_to").cast("int").alias("to_regime")).agg(F.count(F.lit(1)).alias("n"))
    if k is not None:
        spark = df.sparkSession
        every = spark.range(k).select(F.col("id").cast("int").alias("from_regime")).crossJoin(spark.range(k).select(F.col("id").cast("int").alias("to_regime")))
        if by:
            every = df.select(*by).distinct().crossJoin(F.broadcast(every))
        found = every.join(found, [*by, "from_regime", "to_regime"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    weight = F.col("n") + F.lit(smoothing)
    total = F.sum(weight).over(Window.partitionBy(*by, "from_regime"))
    return found.withColumn("p", F.coalesce(div(weight.cast("double"), total.cast("double")), F.lit(0.0)))


def is_stochastic(matrix: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """from_regime, total, valid: whether a row's probabilities are in [0, 1] and sum to 1."""
    return matrix.groupBy("from_regime").agg(F.sum("p").alias("total"), F.bool_and(F.col("p").between(0, 1)).alias("_in")).select("from_regime", "total", (F.col("_in") & (F.abs(F.col("total") - 1) <= tolerance)).alias("valid"))


def persistence_of(matrix: DataFrame) -> DataFrame:
    """from_regime, persistence (stays), expected_duration 1 / (1 - stays), null for a regime that is never left."""
    return matrix.where("from_regime = to_regime").select("from_regime", F.col("p").alias("persistence"), div(F.lit(1.0), 1 - F.col("p")).alias("expected_duration"))


def duration_stats(df: DataFrame, label: str = LABEL) -> DataFrame:
    """label, runs, mean, std (population), median, min and max length of runs."""
    return G.runs(df, label).groupBy(label).agg(F.count(F.lit(1)).alias("runs"), F.avg("length").alias("mean_length"), F.stddev_pop("length").alias("std_length"), F.percentile("length", F.lit(0.5)).alias("median_length"), F.min("length").alias("min_length"), F.max("length").alias("max_length"))


def stability(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: rows, changes, steps, transition_rate, persistence, runs, mean and std (population) of their lengths."""
    df = df.withColumn("_c", G.changed(label))
    steps = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("_c").alias("changes"), F.count("_c").alias("steps"))
    lengths = G.runs(df.drop("_c"), label).agg(F.count(F.lit(1)).alias("runs"), F.avg("length").alias("mean_length"), F.stddev_pop("length").alias("std_length"))
    rate = F.coalesce(div(F.col("changes").cast("double"), F.col("steps").cast("double")), F.lit(0.0))
    return steps.crossJoin(lengths).withColumns({"transition_rate": rate, "persistence": 1 - rate})


def flip_rates(df: DataFrame, label: str = LABEL) -> DataFrame:
    """label, rows that have a next one, exits, flip_rate."""
    nxt = F.lead(label).over(series())
    return df.withColumn("_n", nxt).where(F.col("_n").isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_n") != F.col(label)).alias("exits")).withColumn("flip_rate", F.col("exits") / F.col("n_rows"))


def with_windowed_flip_rate(df: DataFrame, n: int = 20, label: str = LABEL) -> DataFrame:
    """flip_rate over the n rows before the current one."""
    df = df.withColumn("_c", F.coalesce(G.changed(label).cast("int"), F.lit(0)))
    ready = F.row_number().over(series()) > n
    return df.withColumn("flip_rate", F.when(ready, F.sum("_c").over(series().rowsBetween(-(n - 1), -1)) / (n - 1))).drop("_c")


def consistency(df: DataFrame, least: float = 5.0, label: str = LABEL) -> DataFrame:
    """One row: the share of rows of labels whose mean run is least or longer."""
    per = G.runs(df, label).groupBy(label).agg(F.avg("length").alias("mean"), F.sum("length").alias("n"))
    return per.agg((F.sum(F.when(F.col("mean") >= least, F.col("n")).otherwise(0)) / F.sum("n")).alias("consistency"))


def distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: labels, entropy, its share of the greatest, Gini coefficient of the counts, most frequent label (the smallest of equals)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy())
    ranked = counts.withColumns({"p": p, "i": F.row_number().over(Window.orderBy("n", label))})
    out = ranked.agg(F.count(F.lit(1)).alias("labels"), (-F.sum(F.col("p") * F.ln("p"))).alias("entropy"), (2 * F.sum(F.col("i") * F.col("n"))).alias("_w"), F.sum("n").alias("_n"), F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("dominant"))
    k = F.col("labels")
    return out.select("labels", "entropy", F.coalesce(div(F.col("entropy"), F.ln(k)), F.lit(0.0)).alias("normalized_entropy"), (F.col("_w") / (k * F.col("_n")) - (k + 1) / k).alias("gini"), "dominant")


def with_temporal_consistency(df: DataFrame, half: int = 5, label: str = LABEL) -> DataFrame:
    """same: the share of the rows up to half before and after that have the row's label."""
    w = series().rowsBetween(-half, half)
    df = df.withColumn("_all", F.collect_list(label).over(w))
    return df.withColumn("same", F.size(F.filter("_all", lambda v: v == F.col(label))) / F.size("_all")).drop("_all")


def trailing_consistency(df: DataFrame, n: int = 5, label: str = LABEL) -> DataFrame:
    """One row, consistency: the mean share of the most frequent label of the n rows before each row that has so many; 1 without such rows."""
    df = df.withColumns({"_last": F.collect_list(label).over(series().rowsBetween(-n, -1)), "_i": F.row_number().over(series())}).where(F.col("_i") > n)
    share = G.modal_share("_last")
    return df.agg(F.coalesce(F.avg(share), F.lit(1.0)).alias("consistency"))


def correlation_stability(df: DataFrame, x: str, y: str, n: int = 30, label: str = LABEL) -> DataFrame:
    """KEYS, label, rows, stability: 1 / (1 + variance of the correlation of x and y over the n rows of the label before each row from the n-th on).

    1 for a label with under 2n rows in its series, 0 for one whose windows have no correlation. A label's rows are taken as
    one sequence, whatever lies between them.
    """
    own = Window.partitionBy(*KEYS, label).orderBy("ts")
    df = df.where(F.col(label).isNotNull()).withColumns({"_c": corr(x, y, own.rowsBetween(-n, -1)), "_i": F.row_number().over(own)})
    per = df.groupBy(*KEYS, label).agg(F.count(F.lit(1)).alias("rows"), F.var_pop(F.when(F.col("_i") > n, F.col("_c"))).alias("_v"))
    return per.select(*KEYS, label, "rows", F.when(F.col("rows") < 2 * n, 1.0).otherwise(F.coalesce(1 / (1 + F.col("_v")), F.lit(0.0))).alias("stability"))


def regime_statistics(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """label, n, share, mean_duration, and mean, std (population), min, max, median, skew and kurtosis of each feature."""
    per = [f(c).alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max), ("median", lambda x: F.percentile(x, F.lit(0.5))), ("skew", F.skewness), ("kurt", F.kurtosis))]
    stats = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *per)
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    lengths = G.runs(df, label).groupBy(label).agg(F.avg("length").alias("mean_duration"))
    return stats.withColumn("share", share).join(lengths, label, "left")


def regime_names(k: int) -> list[str]:
    """Names from the lowest to the highest regime: bears, a neutral one if k is odd, and bulls."""
    if k % 2 == 0:
        return [f"Regime_{i}" for i in range(k)]
    h = k // 2
    return [f"Bear_L{h - i}" for i in range(h)] + ["Neutral"] + [f"Bull_L{i + 1}" for i in range(h)]


def labelled_by_moments(df: DataFrame, returns: str = "returns", label: str = LABEL) -> DataFrame:
    """label, name: Bull, Bear or Sideways by the mean return (0.001 and more either way), with high or low volatility (against 1.2 times that of all rows)."""
    per = df.groupBy(label).agg(F.avg(returns).alias("_m"), F.stddev(returns).alias("_s"))
    whole = df.agg(F.stddev(returns).alias("_all"))
    trend = F.when(F.col("_m") > 0.001, "Bull").when(F.col("_m") < -0.001, "Bear").otherwise("Sideways")
    high = F.when(F.col("_s") > 1.2 * F.col("_all"), "High").otherwise("Low")
    return per.crossJoin(F.broadcast(whole)).select(label, F.concat_ws("_", trend, high, F.lit("Vol")).alias("name"))


def labelled_by_quantiles(df: DataFrame, returns: str = "returns", label: str = LABEL) -> DataFrame:
    """label, name: Bear under the first quartile of returns by its mean, Bull over the third, else Neutral."""
    q = df.agg(F.percentile(returns, F.lit(0.25)).alias("_lo"), F.percentile(returns, F.lit(0.75)).alias("_hi"))
    per = df.groupBy(label).agg(F.avg(returns).alias("_m")).crossJoin(F.broadcast(q))
    return per.select(label, F.when(F.col("_m") < F.col("_lo"), "Bear").when(F.col("_m") > F.col("_hi"), "Bull").otherwise("Neutral").alias("name"))


def labelled_by_rank(df: DataFrame, k: int, returns: str = "returns", label: str = LABEL) -> DataFrame:
    """label, name: regime_names() in order of the mean return."""
    place = F.row_number().over(Window.orderBy("_m", label))
    names = F.array(*[F.lit(n) for n in regime_names(k)])
    return df.groupBy(label).agg(F.avg(returns).alias("_m")).withColumn("_i", place).select(label, F.get(names, F.col("_i") - 1).alias("name"))


# Agreement of two labellings.


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n and the counts na and nb of each alone: at most labels times labels rows, from one aggregation."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumns({"na": F.sum("n").over(Window.partitionBy(a)), "nb": F.sum("n").over(Window.partitionBy(b)), "total": F.sum("n").over(Window.partitionBy())})


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: accuracy, purity, adjusted_rand, mutual_info and normalized_mutual_info of labels a and b."""
    t = contingency(df, a, b)
    pairs = lambda x: F.col(x) * (F.col(x) - 1) / 2
    first = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"))) == 1
    t = t.withColumns({"_fa": first(a), "_fb": first(b)})
    p = F.col("n") / F.col("total")
    once = lambda c, x: F.sum(F.when(F.col(c), x))
    s = t.agg(
        F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"), F.first("total").alias("total"), F.sum(pairs("n")).alias("sn"), once("_fa", pairs("na")).alias("sa"), once("_fb", pairs("nb")).alias("sb"),
        once("_fb", F.col("n")).alias("top"), F.sum(p * F.ln(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"),
        (-once("_fa", F.col("na") / F.col("total") * F.ln(F.col("na") / F.col("total")))).alias("ha"), (-once("_fb", F.col("nb") / F.col("total") * F.ln(F.col("nb") / F.col("total")))).alias("hb"),
    )
    total = F.col("total") * (F.col("total") - 1) / 2
    chance, most = F.col("sa") * F.col("sb") / total, (F.col("sa") + F.col("sb")) / 2
    return s.select((F.col("same") / F.col("total")).alias("accuracy"), (F.col("top") / F.col("total")).alias("purity"), F.coalesce(div(F.col("sn") - chance, most - chance), F.lit(1.0)).alias("adjusted_rand"), F.col("mi").alias("mutual_info"), F.coalesce(div(F.col("mi"), (F.col("ha") + F.col("hb")) / 2), F.lit(1.0)).alias("normalized_mutual_info"))


def prediction_report(df: DataFrame, label: str = LABEL, target: str = "target") -> DataFrame:
    """A row for each class of either column: class, support, precision, recall and f1 (0 where undefined); from the contingency counts."""
    t = contingency(df, target, label)
    own = t.groupBy(F.col(target).alias("class")).agg(F.first("na").alias("support"), F.sum(F.when(F.col(target) == F.col(label), F.col("n")).otherwise(0)).alias("hits"))
    said = t.groupBy(F.col(label).alias("class")).agg(F.first("nb").alias("said"))
    both = own.join(said, "class", "full")
    share = lambda x: F.coalesce(div(F.col("hits").cast("double"), F.col(x).cast("double")), F.lit(0.0))
    p, r = share("said"), share("support")
    return both.select("class", F.coalesce("support", F.lit(0)).alias("support"), p.alias("precision"), r.alias("recall"), F.coalesce(div(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def prediction_summary(report: DataFrame) -> DataFrame:
    """One row over prediction_report(): accuracy, and precision, recall and f1 as plain means and as means weighted by support."""
    w = F.col("support") / F.sum("support").over(Window.partitionBy())
    parts = report.withColumn("_w", w)
    return parts.agg(F.sum(F.col("recall") * F.col("_w")).alias("accuracy"), *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[F.sum(F.col(c) * F.col("_w")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """Natural log of n! by Stirling's series; small ones from a table."""
    small = np.r_[0.0, np.cumsum(np.log(np.arange(1, 64)))]
    x = np.maximum(n, 1.0)
    series_ = x * np.log(x) - x + 0.5 * np.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 64, small[np.minimum(n, 63).astype(int)], series_)


def _expected_cell(x: float, y: float, n: float) -> float:
    """What a cell with margins x and y adds to the mutual information in expectation. Counts further than 40 deviations from the mean have weights that no double holds."""
    mean = x * y / n
    far = 40 * math.sqrt(mean * (1 - x / n) * max(n - y, 0) / max(n - 1, 1)) + 60
    k = np.arange(max(1.0, x + y - n, math.floor(mean - far)), min(x, y, math.ceil(mean + far)) + 1)
    f = _log_factorial
    log = f(np.array([x, y, n - x, n - y])).sum() - f(np.array([n]))[0] - f(k) - f(x - k) - f(y - k) - f(n - x - y + k)
    return float((k / n * np.log(n * k / (x * y)) * np.exp(log)).sum())


def adjusted_mutual_info(df: DataFrame, a: str, b: str) -> float:
    """Mutual information over what chance would give, from the contingency counts, whose size is that of the labels; 1 for no rows."""
    rows = contingency(df, a, b).collect()
    if not rows:
        return 1.0
    n = rows[0]["total"]
    na, nb = {r[a]: r["na"] for r in rows}, {r[b]: r["nb"] for r in rows}
    mi = sum(r["n"] / n * math.log(r["n"] * n / (r["na"] * r["nb"])) for r in rows)
    h = lambda c: -sum(v / n * math.log(v / n) for v in c.values())
    expected = sum(_expected_cell(float(x), float(y), float(n)) for x in na.values() for y in nb.values())
    spare = (h(na) + h(nb)) / 2 - expected
    return 1.0 if abs(spare) < 1e-15 else (mi - expected) / spare


# Cluster quality.


def _distance(left: list[Column], right: list[Column]) -> Column:
    return F.sqrt(sum((F.pow(a - b, 2) for a, b in zip(left, right)), F.lit(0.0)))


def cluster_quality(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """One row: davies_bouldin, calinski_harabasz, separation (mean distance of centroids over mean distance to the own one).

    Rows with a null are left out. Two passes: one for the centroids, a row a label, one for the distances to them; only the
    centroids meet in pairs, on the driver.
    """
    spark, schema = df.sparkSession, "davies_bouldin double, calinski_harabasz double, separation double"
    df = df.na.drop(subset=[*features, label])
    cent = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)]).collect()  # a row a label
    if not cent:
        return spark.createDataFrame([(None, None, None)], schema)
    means = np.array([[r[f"m{i}"] for i in range(len(features))] for r in cent])
    n = np.array([r["n"] for r in cent], float)
    own = F.create_map(*[x for r, m in zip(cent, means.tolist()) for x in (F.lit(r[label]), F.array(*map(F.lit, m)))])
    off = _distance([F.col(c) for c in features], [F.get(F.col("_m"), F.lit(i)) for i in range(len(features))])
    spread = {r[label]: r for r in df.withColumn("_m", F.try_element_at(own, F.col(label))).groupBy(label).agg(F.avg(off).alias("s"), F.sum(F.pow(off, 2)).alias("w"), F.sum(off).alias("o")).collect()}
    s, within, all_off = (np.array([spread[r[label]][c] for r in cent]) for c in ("s", "w", "o"))
    apart = np.sqrt(((means[:, None] - means[None]) ** 2).sum(axis=2))
    grand = (means * n[:, None]).sum(axis=0) / n.sum()
    k, rows = len(cent), n.sum()
    others = ~np.eye(k, dtype=bool)
    pairs = np.where(others & (apart > 0), (s[:, None] + s[None]) / np.where(apart > 0, apart, 1), -np.inf)
    worst = pairs.max(axis=1)
    ratio = lambda a, b: float(a / b) if b else None
    davies = float(worst[np.isfinite(worst)].mean()) if k > 1 and np.isfinite(worst).any() else None
    between = (n * ((means - grand) ** 2).sum(axis=1)).sum()
    calinski = ratio(between / (k - 1), within.sum() / (rows - k)) if k > 1 and rows > k else None
    separation = ratio(apart[others].mean(), all_off.sum() / rows) if k > 1 else None
    return spark.createDataFrame([(davies, calinski, separation)], schema)


def silhouette(df: DataFrame, features: list[str], label: str = LABEL, key: str = "ts", block: int = 1000) -> DataFrame:
    """One row: the mean Euclidean silhouette; 0 for a single label.

    The measure is quadratic by definition. Rows are gathered to blocks of bounded size, and a row meets blocks, not rows:
    distances to a block are added up by label within one expression, so no pair is ever a row. Rows times blocks meet by
    block number, an even key.
    """
    df = df.na.drop(subset=[*features, label]).select(F.array(*features).alias("_x"), F.col(label).alias("_l"), F.xxhash64(key, *features).alias("_k"))
    df = df.withColumn("_id", F.monotonically_increasing_id())
    n = df.count()
    count = max(1, -(-n // block))
    blocks = df.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(count)).cast("int")).groupBy("_b", F.col("_l").alias("_bl")).agg(F.collect_list("_x").alias("_xs"), F.count(F.lit(1)).alias("_bn"))
    far = F.aggregate("_xs", F.lit(0.0), lambda a, y: a + F.sqrt(F.aggregate(F.zip_with("_x", y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)))
    met = df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(blocks, F.col("_j") == F.col("_b"))
    sums = met.select("_id", "_l", "_bl", "_bn", far.alias("_d")).groupBy("_id", "_l", "_bl").agg(F.sum("_d").alias("_d"), F.sum("_bn").alias("_n"))
    own = F.max(F.when(F.col("_l") == F.col("_bl"), div(F.col("_d"), F.col("_n") - 1.0)))
    near = F.min(F.when(F.col("_l") != F.col("_bl"), F.col("_d") / F.col("_n")))
    each = sums.groupBy("_id").agg(own.alias("a"), near.alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(div(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return each.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("silhouette"))


def regime_correlations(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """label, a, b, corr for each pair of features within a label."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    each = df.groupBy(label).agg(*[corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return each.select(label, F.explode(rows).alias("r")).select(label, "r.*")


# Probabilities and indexes.


def confidence(df: DataFrame, p: str) -> DataFrame:
    """One row: mean, std (population), min and max of the greatest probability, mean entropy and mean margin."""
    top = F.array_max(p)
    entropy = F.aggregate(p, F.lit(0.0), lambda a, v: a - F.when(v > 0, v * F.ln(v)).otherwise(F.lit(0.0)))
    return df.agg(F.avg(top).alias("mean_confidence"), F.stddev_pop(top).alias("std_confidence"), F.min(top).alias("min_confidence"), F.max(top).alias("max_confidence"), F.avg(entropy).alias("mean_entropy"), F.avg(G.margin(p)).alias("mean_margin"))


def quality_index(df: DataFrame, features: list[str], p: str, label: str = LABEL) -> DataFrame:
    """One row: 100 * (0.35 silhouette on [0, 1] + 0.25 confidence + 0.25 persistence + 0.15 balance), and its parts."""
    parts = silhouette(df, features, label).crossJoin(confidence(df, p).select("mean_confidence")).crossJoin(stability(df, label).select("persistence")).crossJoin(distribution(df, label).select("normalized_entropy"))
    return parts.withColumn("quality_index", _index())


def _index() -> Column:
    return 100 * (0.35 * (F.col("silhouette") + 1) / 2 + 0.25 * F.col("mean_confidence") + 0.25 * F.col("persistence") + 0.15 * F.col("normalized_entropy"))


def evaluated(df: DataFrame, features: list[str], label: str = LABEL, p: str | None = None, target: str | None = None) -> DataFrame:
    """One row with the measures of a labelling: cluster quality, stability, distribution, trailing consistency, and confidence and the quality index with probabilities p, agreement with a target."""
    parts = [silhouette(df, features, label), cluster_quality(df, features, label), stability(df, label).select("n_rows", "transition_rate", "persistence", "runs", "mean_length"), distribution(df, label).select("labels", "entropy", "normalized_entropy", "gini"), trailing_consistency(df, label=label)]
    if p is not None:
        parts.append(confidence(df, p))
    if target is not None:
        parts.append(agreement(df, label, target))
    out = parts[0]
    for one in parts[1:]:
        out = out.crossJoin(F.broadcast(one))  # each has one row
    if p is not None:
        out = out.withColumn("quality_index", _index())
    return out


def folds_evaluated(df: DataFrame, by: str = "fold", label: str = LABEL, target: str | None = None) -> DataFrame:
    """A row a fold of rows that carry one: rows, persistence of its labels, and accuracy against a target."""
    steps = df.withColumn("_n", F.lead(label).over(Window.partitionBy(by, *KEYS).orderBy("ts")))
    same = F.avg(F.when(F.col("_n").isNotNull(), (F.col("_n") == F.col(label)).cast("double")))
    more = [] if target is None else [F.avg((F.col(label) == F.col(target)).cast("double")).alias("accuracy")]
    return steps.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), same.alias("persistence"), *more)


def aggregated(results: DataFrame, measures: list[str]) -> DataFrame:
    """measure, mean, std (population), min, max of each measure over the rows of results, such as folds."""
    each = [F.struct(F.lit(c).alias("measure"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in measures]
    return results.agg(F.array(*each).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def readiness(parts: DataFrame, silhouette_: float = 0.30, separation: float = 1.50, persistence: float = 0.85, share: float = 0.10) -> DataFrame:
    """parts (silhouette, separation, persistence, min_share) with ready."""
    return parts.withColumn("ready", (F.col("silhouette") >= silhouette_) & (F.col("separation") >= separation) & (F.col("persistence") >= persistence) & (F.col("min_share") >= share))

