"""Queries with SQL against DuckDB."""

import duckdb
import pytest

from tidegauge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    rows = lambda cols, got: sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in got), key=str)
    assert rows(names, want.fetchall()) == rows(df.columns, map(tuple, df.collect()))
