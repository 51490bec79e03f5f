"""Missing values, scaling, outliers, checks of features, and the join by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.windows import KEYS, div, finite, series, so_far


def _ahead():
    return series().rowsBetween(0, Window.unboundedFollowing)


def forward(x: str) -> Column:
    return F.last(x, ignorenulls=True).over(so_far())


def backward(x: str) -> Column:
    return F.first(x, ignorenulls=True).over(_ahead())


STATISTICS = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5))}


def by_series(x: str, statistic: str, keys: tuple[str, ...] = KEYS) -> Column:
    """x, or its mean or median over the series where it is null."""
    return F.coalesce(F.col(x), STATISTICS[statistic](F.col(x)).over(Window.partitionBy(*keys)))


def interpolated(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """Null values on a line between their neighbours by row, at most limit rows after the last value; the ends repeat the first and last value."""
    df = df.withColumn("_i", F.row_number().over(series()))
    for x in columns:
        at = F.when(F.col(x).isNotNull(), F.col("_i"))
        df = df.withColumns({"_a": forward(x), "_b": backward(x), "_ia": F.last(at, True).over(so_far()), "_ib": F.first(at, True).over(_ahead())})
        line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_i") - F.col("_ia")) / F.nullif(F.col("_ib") - F.col("_ia"), F.lit(0))
        line = line if limit is None else F.when(F.col("_i") - F.col("_ia") <= limit, line)
        df = df.withColumn(x, F.coalesce(F.col(x), line, F.col("_a"), F.col("_b"))).drop("_a", "_b", "_ia", "_ib")
    return df.drop("_i")


def handle_missing(df: DataFrame, columns: list[str], strategy: str = "interpolate", value: float = 0.0, k: int = 5) -> DataFrame:
    """drop, fill (by value), forward, backward, interpolate, mean, median or knn."""
    if strategy == "drop":
        return df.na.drop(subset=columns)
    if strategy == "fill":
        return df.na.fill(value, columns)
    if strategy in ("forward", "backward"):
        return df.withColumns({c: (forward if strategy == "forward" else backward)(c) for c in columns})
    if strategy == "interpolate":
        return interpolated(df, columns)
    if strategy in STATISTICS:
        return df.withColumns({c: by_series(c, strategy) for c in columns})
    if strategy == "knn":
        return knn_imputed(df, columns, k)
    raise ValueError(f"unknown strategy {strategy!r}")


def knn_imputed(df: DataFrame, columns: list[str], k: int = 5, block: int = 1000) -> DataFrame:
    """Nulls by the mean of the k complete rows of the series that are nearest in the columns present, by rescaled Euclidean distance; of equal distances the smaller values.

    An incomplete row meets blocks of its series' complete rows, each block in a group of its own, and keeps the k nearest of
    each, so no pair becomes a row and no task holds a series.
    """
    df = df.withColumn("_id", F.monotonically_increasing_id())
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    donors = df.where(whole).withColumn("_b", F.floor((F.row_number().over(series()) - 1) / block).cast("int"))
    blocks = donors.groupBy(*KEYS, "_b").agg(F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).alias("_rows"))
    own = F.array(*[F.col(c).cast("double") for c in columns])
    gaps = df.where(~whole).select("_id", *KEYS, own.alias("_own"))
    present = F.size(F.filter("_own", lambda v: v.isNotNull()))

    def far(row: Column) -> Column:
        squares = F.zip_with("_own", row, lambda a, b: F.coalesce((a - b) * (a - b), F.lit(0.0)))
        return F.coalesce(F.try_divide(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v) * len(columns), present), F.lit(float("inf")))

    nearest = lambda rows: F.slice(F.array_sort(rows), 1, k)
    n_blocks = blocks.groupBy(*KEYS).agg(F.max("_b").alias("_last"))
    dealt = gaps.join(n_blocks, list(KEYS)).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    met = dealt.join(blocks, [*KEYS, "_b"]).select("_id", nearest(F.transform("_rows", lambda r: F.struct(far(r).alias("far"), r.alias("row")))).alias("_near"))
    best = met.groupBy("_id").agg(nearest(F.flatten(F.collect_list("_near"))).alias("_near"))
    mean = lambda i: F.aggregate("_near", F.lit(0.0), lambda s, r: s + F.get(r["row"], F.lit(i))) / F.size("_near")
    filled = best.select("_id", *[mean(i).alias(f"_d_{c}") for i, c in enumerate(columns)])
    return df.join(filled, "_id", "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_d_{c}")) for c in columns}).drop("_id", *[f"_d_{c}" for c in columns])


def _with_statistics(df: DataFrame, by: tuple[str, ...], statistics: dict[str, Column]) -> DataFrame:
    """df with aggregates of the groups by `by`, or of all rows: these come from one aggregation, combined before its shuffle, not from a window over the whole table."""
    if by:
        w = Window.partitionBy(*by)
        return df.withColumns({n: e.over(w) for n, e in statistics.items()})
    row = df.agg(*[e.alias(n) for n, e in statistics.items()])
    kinds, values = dict(row.dtypes), row.first()
    return df.withColumns({n: F.lit(values[n]).cast(kinds[n]) for n in statistics})


def scaled(df: DataFrame, columns: list[str], method: str = "standard", by: tuple[str, ...] = (), suffix: str = "") -> DataFrame:
    """zscore (sample deviation), standard (population), minmax, or robust (median and quartile distance); null without spread."""
    if method not in CENTRE_AND_SPREAD:
        raise ValueError(f"unknown method {method!r}")
    parts = {f"_{k}_{c}": e for c in columns for k, e in zip("mba", CENTRE_AND_SPREAD[method](F.col(c)))}
    out = _with_statistics(df, by, parts)
    spread = lambda c: F.col(f"_b_{c}") - F.col(f"_a_{c}") if f"_a_{c}" in parts else F.col(f"_b_{c}")
    return out.withColumns({c + suffix: div(F.col(c) - F.col(f"_m_{c}"), spread(c)) for c in columns}).drop(*parts)


#: By method the centre of a column, and its spread, or the two values that it lies between.
CENTRE_AND_SPREAD = {
    "standard": lambda x: (F.avg(x), F.stddev_pop(x)),
    "zscore": lambda x: (F.avg(x), F.stddev(x)),
    "minmax": lambda x: (F.min(x), F.max(x), F.min(x)),
    "robust": lambda x: (F.percentile(x, F.lit(0.5)), F.percentile(x, F.lit(0.75)), F.percentile(x, F.lit(0.25))),
}


def scaler(df: DataFrame, columns: list[str], method: str = "standard") -> dict[str, tuple[float, float]]:
    """Centre and spread of columns, to be kept and used again by scale(): one pass, two numbers a column."""
    pick = CENTRE_AND_SPREAD[method]
    row = df.agg(*[e.alias(f"{c}_{k}") for c in columns for k, e in enumerate(pick(F.col(c)))]).first()
    spread = lambda c: row[f"{c}_1"] - row[f"{c}_2"] if f"{c}_2" in row and row[f"{c}_1"] is not None else row[f"{c}_1"]
    return {c: (row[f"{c}_0"], spread(c)) for c in columns}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns by a scaler's centre and spread; without spread only centred."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s or 1.0) for c, (m, s) in fitted.items() if m is not None})


def mad_scaled(df: DataFrame, x: str, by: tuple[str, ...] = ()) -> DataFrame:
    df = _with_statistics(df, by, {"_m": F.percentile(x, F.lit(0.5))}).withColumn("_off", F.abs(F.col(x) - F.col("_m")))
    df = _with_statistics(df, by, {"_mad": F.percentile("_off", F.lit(0.5))})
    return df.withColumn(f"{x}_mad", div(F.col(x) - F.col("_m"), 1.4826 * F.col("_mad"))).drop("_m", "_off", "_mad")


def without_outliers(df: DataFrame, columns: list[str], method: str = "iqr", by: tuple[str, ...] = (), factor: float | None = None) -> DataFrame:
    """Null in place of values beyond 1.5 quartile distances (iqr) or 3 sample deviations (zscore)."""
    if method not in ("iqr", "zscore"):
        raise ValueError(f"unknown method {method!r}")
    k = factor or (3.0 if method == "zscore" else 1.5)
    pair = (lambda x: (F.avg(x), F.stddev(x))) if method == "zscore" else (lambda x: (F.percentile(x, F.lit(0.25)), F.percentile(x, F.lit(0.75))))
    parts = {f"_{k_}_{c}": e for c in columns for k_, e in zip("ab", pair(F.col(c)))}

    def kept(c: str) -> Column:
        x, a, b = F.col(c), F.col(f"_a_{c}"), F.col(f"_b_{c}")
        return F.when(F.abs(x - a) <= k * b, x) if method == "zscore" else F.when(x.between(a - k * (b - a), b + k * (b - a)), x)

    return _with_statistics(df, by, parts).withColumns({c: kept(c) for c in columns}).drop(*parts)


def clipped(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, by: tuple[str, ...] = ()) -> DataFrame:
    parts = {f"_{k}_{c}": F.percentile(c, F.lit(q)) for c in columns for k, q in (("a", low), ("b", high))}
    bounded = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_b_{c}")), F.col(f"_a_{c}")))
    return _with_statistics(df, by, parts).withColumns({c: bounded(c) for c in columns}).drop(*parts)


def safe_divide(a: Column, b: Column, fill: float = 0.0) -> Column:
    return F.coalesce(finite(div(a, b)), F.lit(fill))


def feature_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: rows, missing, infinite, distinct values, whether all are alike; one pass over df."""
    def told(c: str) -> Column:
        x = F.col(c)
        return F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(x.isNull() | F.isnan(x)).alias("missing"), F.count_if(F.abs(x) == float("inf")).alias("infinite"), F.countDistinct(x).alias("n_distinct"), (F.stddev(x) == 0).alias("is_constant"))

    return df.agg(F.array(*map(told, columns)).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, ts: str) -> DataFrame:
    """left with the columns of the last row of right with the same key and a time not after left's: one shuffle, no pairs."""
    rest = [c for c in right.columns if c != key]
    rows = left.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*rest)).schema[0].dataType).alias("_r"))
    others = right.select(key, F.col(ts).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*rest).alias("_r"))
    w = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(others).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in rest])
