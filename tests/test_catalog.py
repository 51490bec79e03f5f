"""Every query with SQL against DuckDB on the same tables; those without run."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidegauge.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    want = duck.execute(catalog.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 9


@pytest.mark.parametrize("name", ["backtest", "stochastic", "rolling_features", "histogram_entropies", "scale_global"])
def test_no_negative_zeros(spark, sf, name):
    assert not [r for r in catalog.QUERIES[name](spark, sf).collect() if any(isinstance(v, float) and v == 0 and math.copysign(1, v) < 0 for v in r)]
