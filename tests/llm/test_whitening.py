"""Whitening against whole numbers of Python and numpy, far from zero, of odd rows and of low rank."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import whitening as W


def plain(rows):
    """x of each row that has a result."""
    out = {}
    for i, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            out[i] = tuple(min(max(math.floor(64 * float(c)) + 1_000_000, -(2**63)), 2**63 - 1) for c in v)
    return out


def exact(points):
    n, d = len(points), len(points[0])
    s = [sum(p[i] for p in points) for i in range(d)]
    cov = [[Fraction(n * sum(p[i] * p[j] for p in points) - s[i] * s[j], n * n) for j in range(d)] for i in range(d)]
    return n, s, cov


def check(spark, rows, kind="float", most=16):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = W.components(df, most=most).toPandas()
    x = plain(df.collect())
    n, s, cov = exact(sorted(set(x.values())))
    d = len(s)
    assert len(got) == len(x) * min(most, d) and set(got.vec_id) == set(x)
    assert (got.n == n).all() and got.identity_error.nunique() == 1
    for i, v in x.items():
        square = sum((n * a - b) ** 2 for a, b in zip(v, s))
        assert set(got[got.vec_id == i].deviation.dropna()) == ({square} if square < 2**63 else set())
    v = np.array([[float(c) for c in row] for row in cov])
    e = np.linalg.eigvalsh(v)[::-1]
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, e[:most] / float(sum(cov[i][i] for i in range(d))), rtol=1e-6)
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    distinct = wide.loc[[next(i for i in x if x[i] == p) for p in sorted(set(x.values()))]].to_numpy()
    error = np.abs(np.cov(distinct.T, bias=True) - np.eye(distinct.shape[1])).max()
    assert error < 1e-6 and got.identity_error.iloc[0] == pytest.approx(error, abs=1e-9)
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(x[i], s)] for i in wide.index])
    # Whitened along eigenvectors of the exact covariance: V u = e u, where u is what the projection was made by.
    u = np.linalg.lstsq(centred, wide.to_numpy() * np.sqrt(e[: wide.shape[1]]), rcond=None)[0]
    if len(x) > d:
        assert np.abs(v @ u - u * e[: u.shape[1]]).max() < 1e-6 * e[0]
    return got


def test_equals_whole_numbers(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(0, 1, (300, 6)) * [5, 3, 2, 1, 0.5, 0.2]
    rows = [(i, [float(np.float32(c)) for c in p]) for i, p in enumerate(points)]
    rows += [(1000 + i, rows[7][1]) for i in range(100)] + [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5)]
    check(spark, rows)
    check(spark, rows, most=2)


def test_large_entries(spark):
    """Entries of every width of code, whose squares no double or long holds."""
    rng = np.random.default_rng(4)
    for size in (1e3, 1e7, 1e15):
        check(spark, [(i, [float(c) for c in p]) for i, p in enumerate(rng.normal(size, size / 3, (60, 3)))], "double")


def test_entries_beyond_a_long_and_low_rank(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [5.0, 0.0]), (4, [5.0, 0.0])], "vec_id long, embedding array<double>")
    got = W.components(df).toPandas()
    assert len(got) == 8 and set(got.n) == {3}
    second = got[got.component == 2]
    assert second.whitened.isna().all() and (second.explained == 0).all() and got.identity_error.iloc[0] < 1e-6
    one = W.components(df.where("vec_id = 3")).toPandas()
    assert one.whitened.isna().all() and (one.deviation == 0).all()


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [3.0]), (4, []), (None, [0.5, 0.1])], "vec_id long, embedding array<float>")
    df = df.withColumns({"whitened": F.lit("clash"), "c": F.lit(1), "n": F.lit(2), "code": F.lit(0)})
    out = W.transformed(df, W.fitted(df))
    got = {r.vec_id: r.whitened for r in out.collect()}
    assert set(out.columns) == {*df.columns, "deviation"}
    assert got[3] is None and got[4] is None and len(got[1]) == len(got[None]) == 2
    assert W.components(df.limit(0)).count() == 0 and W.components(df.where("vec_id = 4")).count() == 0


def test_primes_put_numbers_together():
    p = W.primes(10**40)
    assert len(set(p)) == len(p) and math.prod(p) > 10**40 >= math.prod(p[:-1]) and all(W.ROWS * q * q < 2**53 for q in p)
