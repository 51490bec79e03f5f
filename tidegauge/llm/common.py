"""Helpers shared by the training-data operators: tables in the shared folder, skew-safe lookups, names of working columns."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import scratch

#: Rows of a table of a few numbers and short strings up to which it is broadcast.
FEW = 300_000
#: A key with more than 1/HEAVY of all rows is heavy, so at most HEAVY keys are; that bounds what is broadcast.
HEAVY = 1000


_held: list[dict] = []


def held(cache: dict) -> dict:
    """cache, which outlives the tasks of a Python worker until other work in it calls forget()."""
    _held.append(cache)
    return cache


def forget() -> None:
    """Gives up what this worker holds for other work, and gives the memory back."""
    if any(_held):
        for cache in _held:
            cache.clear()
        gc.collect()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)


#: Rows that Spark hands to a Python worker at once where they hold whole texts, and where they hold a few numbers.
TEXTS_AT_ONCE, NUMBERS_AT_ONCE = 1000, 20_000
_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands TEXTS_AT_ONCE rows at most to a Python worker at once, unless it is set to fewer: ten thousand texts and what is made of them are hundreds of MB."""
    if int(spark.conf.get(_AT_ONCE)) > TEXTS_AT_ONCE:
        spark.conf.set(_AT_ONCE, str(TEXTS_AT_ONCE))


def settled(df: DataFrame, name: str, at_once: int | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts lineage, survives lost executors. at_once: rows handed to Python workers at once meanwhile."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(_AT_ONCE)
    if at_once:
        spark.conf.set(_AT_ONCE, str(at_once))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_AT_ONCE, before)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """settled(), for the small tables of iterative operators: unlike checkpoint(), it also sets the planner's estimates of size anew, which joins would multiply round by round."""
    return settled(df, "step")


def unused(df: DataFrame, *names: str) -> list[str]:
    """names for working columns, with underscores before those that df has itself."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n = f"_{n}"
        taken.add(n)
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(table: DataFrame, most: int = FEW) -> bool:
    """Whether a table that costs little to make has at most so many rows, and so may be broadcast."""
    return table.limit(most + 1).count() <= most


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, unique: Column, n_rows: int, most: int = 0) -> DataFrame:
    """rows left-joined with table on the column key, safe from hot keys and without a second scan of rows.

    table has one row a key; its column weight holds how many rows have that key. A table of `most` rows at most is
    broadcast. Else keys with over n_rows/HEAVY rows (HEAVY at most) are broadcast; other rows are shuffled by key, while
    rows whose key was found already, or is null, are dealt by a surrogate made from unique, an expression that differs
    between rows.
    """
    values = [c for c in table.columns if c not in (key, weight)]
    hk, hv, lk, lv, k = unused(rows, "hk", "hv", "lk", "lv", "k")
    if most and few(table, most):
        return rows.drop(*values).join(F.broadcast(table.select(F.col(key).alias(hk), *values)), F.col(key) == F.col(hk), "left").drop(hk)
    limit = max(1, n_rows // HEAVY)
    heavy = table.where(F.col(weight) > limit).select(F.col(key).alias(hk), F.struct(*values).alias(hv))
    light = table.where(F.col(weight) <= limit).select(F.struct(F.lit(0).alias("s"), F.col(key).alias("k")).alias(lk), F.struct(*values).alias(lv))
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col(hk), "left")
    spread = F.col(hk).isNotNull() | F.col(key).isNull()
    out = out.withColumn(k, F.when(spread, F.struct(F.lit(1).alias("s"), unique.cast(rows.schema[key].dataType).alias("k"))).otherwise(F.struct(F.lit(0).alias("s"), F.col(key).alias("k"))))
    out = out.join(light.hint("shuffle_hash"), F.col(k) == F.col(lk), "left")
    got = [F.coalesce(F.col(f"{hv}.{c}"), F.col(f"{lv}.{c}")).alias(c) for c in values]
    return out.select(*[c for c in rows.columns if c not in values], *got)


def frequent(counts: DataFrame, c: str, most: int) -> Column:
    """A condition on c that `most` rows of counts meet at most, those with the largest c: rows of a quarter of an octave are taken together, as long as there aren't too many."""
    octave = F.floor(4 * F.log2(c))
    n, least = 0, None
    for r in counts.where(F.col(c) > 0).groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("o")).collect():  # some hundred rows
        n += r.n
        if n > most:
            break
        least = r.o
    return F.lit(False) if least is None else (F.col(c) > 0) & (octave >= least)
