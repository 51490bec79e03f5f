"""Reports over models and data sets, and the backtest of a labelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.windows import KEYS, series, so_far

from .regimes import LABEL


def ranked(scores: DataFrame, top: int = 3, ascending: bool = False) -> DataFrame:
    """scores (dataset, model, score) with rank, equal scores sharing their mean one, and in_top."""
    order = F.asc("score") if ascending else F.desc("score")
    w = Window.partitionBy("dataset").orderBy(order)
    ties = F.count(F.lit(1)).over(Window.partitionBy("dataset", "score"))
    place = F.row_number().over(Window.partitionBy("dataset").orderBy(order, "model"))
    return scores.withColumns({"rank": F.rank().over(w) + (ties - 1) / 2.0, "in_top": place <= top})


def mean_ranks(scores: DataFrame) -> DataFrame:
    """model, mean_rank, mean_score, best (data sets where it ranks first)."""
    return ranked(scores, 1).groupBy("model").agg(F.avg("rank").alias("mean_rank"), F.avg("score").alias("mean_score"), F.count_if("in_top").alias("best"))


def best_per_dataset(scores: DataFrame) -> DataFrame:
    return scores.groupBy("dataset").agg(F.max_by("model", F.struct("score", "model")).alias("model"), F.max("score").alias("score"))


def backtested(df: DataFrame, positions: dict[int, float], cost: float = 0.0, returns: str = "returns", label: str = LABEL) -> DataFrame:
    """df with position (from the label before), net return after cost of changes, equity and drawdown."""
    held = F.lit(0.0)
    for k, v in positions.items():
        held = F.when(F.col(label) == k, F.lit(float(v))).otherwise(held)
    df = df.withColumn("position", F.coalesce(F.lag(held).over(series()), F.lit(0.0)))
    turn = F.abs(F.col("position") - F.coalesce(F.lag("position").over(series()), F.lit(0.0)))
    df = df.withColumn("net", F.col("position") * F.coalesce(F.col(returns), F.lit(0.0)) - cost * turn)
    df = df.withColumn("equity", F.exp(F.sum(F.ln(1 + F.col("net"))).over(so_far())))
    return df.withColumn("drawdown", F.col("equity") / F.max("equity").over(so_far()) - 1)


def backtest_summary(df: DataFrame, year: int = 252) -> DataFrame:
    """keys, total and annual return, volatility, sharpe, max_drawdown of backtested()."""
    out = df.groupBy(*KEYS).agg((F.max_by("equity", "ts") - 1).alias("total_return"), F.avg("net").alias("_m"), F.stddev("net").alias("_s"), F.min("drawdown").alias("max_drawdown"), F.count(F.lit(1)).alias("bars"))
    return out.select(*KEYS, "bars", "total_return", (F.col("_m") * year).alias("annual_return"), (F.col("_s") * year**0.5).alias("annual_volatility"), F.try_divide(F.col("_m"), F.col("_s")).__mul__(year**0.5).alias("sharpe"), "max_drawdown")


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A table of a report's rows, of which it has few; what is over `most` is told in a last line."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "-|" * len(rows.columns) + "\n"
    shown = rows.limit(most + 1).collect()
    body = "".join("| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |\n" for r in shown[:most])
    return head + body + (f"\n{rows.count() - most} rows more\n" if len(shown) > most else "")
