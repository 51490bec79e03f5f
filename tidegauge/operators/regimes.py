"""Label sequences: runs, durations, transitions, smoothing, relabelling, rule labels and rules on probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.windows import KEYS, div, last_rows, roll, series, so_far

LABEL = "regime"


def changed(label: str = LABEL) -> Column:
    """Whether a label differs from the one before; null for the first."""
    return F.col(label) != F.lag(label).over(series())


def with_runs(df: DataFrame, label: str = LABEL, out: str = "run") -> DataFrame:
    """The number of the run of equal labels that a row is in, from 0 on in each series."""
    return df.withColumn("_c", F.coalesce(changed(label).cast("int"), F.lit(0))).withColumn(out, F.sum("_c").over(so_far())).drop("_c")


def runs(df: DataFrame, label: str = LABEL, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A row for each run: keys, run, label, start_ts, end_ts and length."""
    return with_runs(df, label).groupBy(*keys, "run").agg(F.first(label).alias(label), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("length"))


def with_duration(df: DataFrame, label: str = LABEL, out: str = "duration") -> DataFrame:
    """How long a run has lasted, the current row counted; 0 on the first row of a series."""
    df = with_runs(df, label, "_run")
    within = F.row_number().over(Window.partitionBy(*KEYS, "_run").orderBy("ts"))
    return df.withColumn(out, F.when(F.row_number().over(series()) == 1, F.lit(0)).otherwise(within).cast("long")).drop("_run")


def with_frequency(df: DataFrame, labels: list[int], n: int = 50, label: str = LABEL) -> DataFrame:
    """freq_k: the share of label k in the last n rows, or as many as there are."""
    return df.withColumns({f"freq_{k}": F.avg((F.col(label) == k).cast("double")).over(last_rows(n)) for k in labels})


def with_transitions(df: DataFrame, n: int = 50, label: str = LABEL) -> DataFrame:
    """change, change_rate over the last n rows, and rows since the last change (since the start before any)."""
    df = df.withColumns({"change": F.coalesce(changed(label).cast("int"), F.lit(0)), "_i": F.row_number().over(series())})
    last = F.coalesce(F.last(F.when(F.col("change") == 1, F.col("_i")), True).over(so_far()), F.lit(1))
    return df.withColumns({"change_rate": F.avg(F.col("change").cast("double")).over(last_rows(n)), "since_change": (F.col("_i") - last).cast("long")}).drop("_i")


def stability(n: int = 20, change: str = "change") -> Column:
    """1 less the share of changes among the n - 1 steps of the last n rows."""
    w = series().rowsBetween(-(n - 2), 0)
    return F.when(F.count(F.lit(1)).over(last_rows(n)) == n, 1 - F.sum(change).over(w) / (n - 1))


def smoothed(df: DataFrame, n: int = 5, label: str = LABEL, out: str = "smoothed") -> DataFrame:
    """The most frequent label of the n rows around, the smallest of equals; n is made odd; the ends have fewer rows."""
    h = (n + 1 - n % 2) // 2
    return df.withColumn(out, F.mode(F.col(label), deterministic=True).over(series().rowsBetween(-h, h)))


def mapping(df: DataFrame, feature: str, labels: list[int], label: str = LABEL, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, label, new_label: labels in order of their mean of a feature, that of an absent label counting as 0; ties by label."""
    spark = df.sparkSession
    means = df.groupBy(*keys, label).agg(F.avg(feature).alias("mean"))
    every = df.select(*keys).distinct().join(F.broadcast(spark.createDataFrame([(k,) for k in labels], f"{label} {dict(df.dtypes)[label]}")))
    full = every.join(means, [*keys, label], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("mean", label)) - 1
    return full.select(*keys, label, place.cast("int").alias("new_label"))


def reordered(df: DataFrame, feature: str, labels: list[int], label: str = LABEL, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """df with labels renumbered by mapping()."""
    return df.join(F.broadcast(mapping(df, feature, labels, label, keys)), [*keys, label], "left").drop(label).withColumnRenamed("new_label", label)


def reordered_probabilities(p: str, order: list[int]) -> Column:
    """An array of probabilities with those of labels in the given order."""
    return F.array(*[F.get(F.col(p), k) for k in order])


def by_thresholds(x: str, thresholds: list[Column]) -> Column:
    """How many thresholds a value exceeds; null stays null."""
    return F.when(F.col(x).isNotNull(), sum(((F.col(x) > t).cast("int") for t in thresholds), F.lit(0)))


def quantile_labels(df: DataFrame, x: str, k: int = 3, out: str = LABEL, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Labels 0 to k - 1 by the equal quantiles of x in each series."""
    w = Window.partitionBy(*keys)
    return df.withColumn(out, by_thresholds(x, [F.percentile(x, F.lit(i / k)).over(w) for i in range(1, k)]))


def rule_labels(df: DataFrame, volatility: float = 0.02, trend: float = 0.001, out: str = LABEL) -> DataFrame:
    """2 where the deviation of 20 returns exceeds volatility, else 1 where means of 20 and 50 closes are further apart than trend, else 0; 0 for the first 50 rows."""
    df = df.withColumns({"_r": div(F.col("close"), F.lag("close").over(series())) - 1, "_i": F.row_number().over(series())})
    apart = F.abs(div(roll(F.avg, "close", 20) - roll(F.avg, "close", 50), roll(F.avg, "close", 50)))
    rule = F.when(roll(F.stddev, "_r", 20) > volatility, 2).when(apart > trend, 1).otherwise(0)
    return df.withColumn(out, F.when(F.col("_i") <= 50, 0).otherwise(rule)).drop("_r", "_i")


def slice_parameters(df: DataFrame, x: str, k: int = 3, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, slice, sigma, omega: the population deviation of x in k equal stretches of time, and a tenth of its square."""
    df = df.where(F.col(x).isNotNull()).withColumns({"_i": F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    part = F.least(F.floor(F.col("_i") / F.floor(F.col("_n") / k)), F.lit(k - 1)).cast("int")
    return df.groupBy(*keys, part.alias("slice")).agg(F.stddev_pop(x).alias("sigma")).withColumn("omega", 0.1 * F.pow("sigma", 2))


def nearest_labels(df: DataFrame, x: str, levels: DataFrame, level: str, k: int, keys: tuple[str, ...] = KEYS, out: str = LABEL) -> DataFrame:
    """The number of the level nearest to x among the series' sorted levels, the lower of equals; 0 where x is null."""
    sorted_ = levels.groupBy(*keys).agg(F.array_sort(F.collect_list(level)).alias("_levels"))
    df = df.join(F.broadcast(sorted_), list(keys), "left")
    far = F.transform("_levels", lambda v: F.abs(v - F.col(x)))
    return df.withColumn(out, F.when(F.col(x).isNull(), F.lit(0)).otherwise((F.array_position(far, F.array_min(far)) - 1).cast("int"))).drop("_levels")


# Rules on arrays of probabilities.


def crisp(p: str) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def entropy_share(p: str) -> Column:
    """Entropy over its greatest value."""
    return F.aggregate(p, F.lit(0.0), lambda a, v: a - F.when(v > 0, v * F.ln(v)).otherwise(F.lit(0.0))) / F.ln(F.size(p))


def margin(p: str) -> Column:
    """The greatest less the second greatest probability."""
    top = F.sort_array(p, asc=False)
    return F.get(top, 0) - F.get(top, 1)


def uncertain(p: str, threshold: float = 0.6) -> Column:
    """The likeliest label, or -1 where it is less likely than threshold."""
    return F.when(F.array_max(p) < threshold, -1).otherwise(crisp(p))


def fuzzy(p: str, threshold: float = 0.6) -> Column:
    """One-hot where the greatest probability is threshold or more; else probabilities under half of 1/k dropped and the rest made to sum to 1."""
    top = F.array_max(p)
    kept = F.transform(p, lambda v: F.when(v < 0.5 / F.size(p), F.lit(0.0)).otherwise(v))
    total = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v)
    return F.when(top >= threshold, F.transform(p, lambda v, i: (i == F.array_position(p, top) - 1).cast("double"))).otherwise(F.transform(kept, lambda v: v / total))


def neighbour_probabilities(label: str, k: int) -> Column:
    """0.8 for the label, 0.1 for each neighbour, made to sum to 1."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == F.col(label), 0.8).when(F.abs(i - F.col(label)) == 1, 0.1).otherwise(0.0))
    total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raw, lambda v: v / total)


def with_smoothed_probabilities(df: DataFrame, p: str, k: int, n: int = 5, out: str = "smoothed_p") -> DataFrame:
    """The mean of each of the k probabilities over the n rows around a row, fewer at the ends of a series."""
    w = series().rowsBetween(-(n // 2), n // 2)
    return df.withColumn(out, F.array(*[F.avg(F.get(p, F.lit(i))).over(w) for i in range(k)]))


def label_check(df: DataFrame, k: int, label: str = LABEL) -> DataFrame:
    """One row: rows, those without a label, those with one outside 0 to k - 1, labels in use, and whether all is sound."""
    x = F.col(label)
    told = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(x.isNull()).alias("missing"), F.count_if(~x.between(0, k - 1)).alias("outside"), F.countDistinct(x).alias("labels"))
    return told.withColumn("valid", (F.col("n_rows") > 0) & (F.col("missing") == 0) & (F.col("outside") == 0))


def modal(votes: str) -> Column:
    """The most frequent of an array of labels, the smallest of equals."""
    count = lambda v: F.size(F.filter(votes, lambda w: w == v))
    return F.array_min(F.filter(votes, lambda v: count(v) == F.array_max(F.transform(votes, count))))


def modal_share(votes: str) -> Column:
    count = lambda v: F.size(F.filter(votes, lambda w: w == v))
    return F.array_max(F.transform(votes, count)) / F.size(votes)


def consensus(votes: str, share: float = 0.6) -> Column:
    """The modal label if enough votes are for it, else the first vote."""
    return F.when(modal_share(votes) >= share, modal(votes)).otherwise(F.get(votes, 0))


def mean_probabilities(ps: list[str], weights: list[float] | None = None) -> Column:
    """Weighted mean of arrays of probabilities; equal weights by default."""
    weights = weights or [1.0] * len(ps)
    total = sum(weights)
    parts = [F.transform(p, _times(w / total)) for p, w in zip(ps, weights)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)


def _times(w: float):
    return lambda v: v * w
