"""Folds of any estimator, benchmark grids that go on where they stopped, distances, weights, joins in time."""

import json
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Estimator
from pyspark.sql import functions as F

from tidegauge.operators import benchmarks as K
from tidegauge.operators import intervals as I
from tidegauge.operators import scatter as S
from tidegauge.operators import splits
from tidegauge.operators import validation as V
from tidegauge.operators.estimator import RegimeDetector
from tidegauge.sources import bars as B


def frame(n=240, symbol="a", seed=0):
    rng = np.random.default_rng(seed)
    y = (np.arange(n) // 15) % 3
    return pd.DataFrame({"symbol": symbol, "timeframe": "H1", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "vol": y + rng.normal(0, 0.3, n), "r": rng.normal(0, 1, n), "target": y})


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(pd.concat([frame(), frame(100, "b", 1)])).persist()


def test_folds_of_every_series(spark, df):
    rows = V.strategy("walk_forward", train=60, test=20, step=20)(df).toPandas()
    for symbol, n in (("a", 240), ("b", 100)):
        own = rows[rows.symbol == symbol]
        want = {(f, role, i) for f, role, lo, hi in splits.walk_forward_ranges(n, 60, 20, 20) for i in range(lo, hi + 1)}
        start = pd.Timestamp("2024-01-01")
        assert {(r.fold, r.role, int((r.ts - start) / pd.Timedelta("1h"))) for r in own.itertuples()} == want and len(own) == len(want)
    one = df.where("symbol = 'a'").withColumnRenamed("target", "regime")
    aware = V.strategy("regime_aware", folds=4)(one)
    assert {r.role for r in aware.select("role").distinct().collect()} == {"train", "test"}
    with pytest.raises(ValueError, match="unknown"):
        V.strategy("oracle")


def test_scores_equal_plain_measures(df):
    told = df.withColumns({"fold": F.lit(3), "regime": F.when(F.col("vol") > 1.7, 2).when(F.col("vol") > 0.6, 1).otherwise(0), "p": F.array(F.lit(0.6), F.lit(0.4))})
    got = V.scores(told, target="target", p="p").first()
    x = told.toPandas().sort_values(["symbol", "ts"])
    same = pd.concat([(g.regime == g.regime.shift(-1))[:-1] for _, g in x.groupby("symbol")])
    cells = pd.crosstab(x.regime, x.target).to_numpy()
    two = lambda v: (v * (v - 1) / 2).sum()
    a, b, both, every = two(cells.sum(1)), two(cells.sum(0)), two(cells), two(np.array([len(x)]))
    share = cells.sum(1) / len(x)
    assert got.n_rows == len(x) and got.persistence == pytest.approx(same.mean()) and got.accuracy == pytest.approx((x.regime == x.target).mean())
    assert got.adjusted_rand == pytest.approx((both - a * b / every) / ((a + b) / 2 - a * b / every)) and got.purity == pytest.approx(cells.max(1).sum() / len(x))
    assert got.entropy == pytest.approx(-(share * np.log(share)).sum()) and got.confidence == pytest.approx(0.6)


def test_cross_validation_of_a_detector(df):
    """Each fold's model learned from its training rows only: it says what a model fitted by hand says."""
    est = RegimeDetector(kind="logistic", features=["vol", "r"], labelCol="target")
    rows = V.strategy("time_series", folds=2, gap=3)(df)
    told = V.cross_predicted(rows, est, 2)
    by_hand = est.fit(rows.where("fold = 1 AND role = 'train'")).transform(rows.where("fold = 1 AND role = 'test'"))
    got = told.where("fold = 1").select("symbol", "ts", "regime")
    assert got.exceptAll(by_hand.select("symbol", "ts", "regime")).count() == 0 and got.count() == by_hand.count()
    assert V.cross_validated(df, est, V.strategy("time_series", folds=2), "target").where("accuracy > 0.6").count() == 2
    with pytest.raises(ValueError, match="no fold"):
        V.cross_predicted(rows.where("role = 'test'"), est)


class Failing(Estimator):
    calls = 0

    def _fit(self, df):
        Failing.calls += 1
        if Failing.calls <= 1:
            raise RuntimeError("no luck\nat all")
        return V.QuantileRule(inputCol="vol").fit(df)


class Counting(V.QuantileRule):
    fits: list = []

    def _fit(self, df):
        Counting.fits.append(1)
        return super()._fit(df)


def test_benchmark_goes_on_where_it_stopped(spark, df, tmp_path):
    path = str(tmp_path / "results")
    sets = {s: df.where(F.col("symbol") == s) for s in "ab"} | {"none": df.limit(0)}
    make = lambda models, seeds=(0, 1): K.Benchmark(spark, path, sets, models, K.measured(target="target"), seeds)
    models = {"vol": Counting(inputCol="vol"), "r": Counting(inputCol="r")}
    first = make({"vol": models["vol"]})
    assert len(first.cells()) == 4 and first.run(2) == 4 and len(Counting.fits) == 4
    whole = make(models)
    assert whole.run(3) == 4 and len(Counting.fits) == 8
    assert whole.run() == 0 and len(Counting.fits) == 8
    table = whole.table().toPandas()
    assert len(table.groupby(["dataset", "model", "seed"])) == 8 and {"accuracy", "fit_seconds", "predict_seconds", "persistence"} <= set(table.measure)
    scores = K.mean_scores(whole.table(), "accuracy").toPandas().set_index(["dataset", "model"]).score
    assert scores["a", "vol"] > scores["a", "r"]
    # Other parameters, or other rows, are other cells.
    assert make({"vol": Counting(inputCol="vol", k=4)}).run() == 4
    changed = K.Benchmark(spark, path, {"a": sets["a"].limit(200), "b": sets["b"]}, {"vol": models["vol"]}, K.measured())
    assert changed.run() == 1


def test_failures_are_rows_and_tried_again(spark, df, tmp_path):
    bench = K.Benchmark(spark, str(tmp_path / "r"), {"a": df}, {"fails": Failing(), "works": V.QuantileRule(inputCol="vol")}, K.measured())
    assert bench.run(1) == 2
    assert [r.error for r in bench.failures().collect()] == ["RuntimeError: no luck"] and bench.table().select("model").distinct().count() == 1
    assert bench.run(1) == 1 and bench.failures().count() == 0 and bench.table().select("model").distinct().count() == 2


def test_reports_are_read_back(spark):
    text = "# Title\n\n| model | score |\n|-|-|\n| a | 0.5 |\n| b (x) | -1.25 |\ntext | with bar\n"
    got = [r.cells for r in K.table_rows(spark.createDataFrame([(x,) for x in text.split("\n")], "value string")).collect()]
    assert got == [["model", "score"], ["a", "0.5"], ["b (x)", "-1.25"]]
    assert len(K.combined(["a", "b", "c"], (2, 3), ("voting",))) == 4 and list(K.counts_of_regimes(lambda k: k, (2, 5))) == ["k=2", "k=5"]


@pytest.mark.parametrize("kind", S.COVARIANCES)
def test_mahalanobis(df, kind):
    got = S.with_mahalanobis(df, ["vol", "r"], "target", kind).toPandas()
    parts = {k: g[["vol", "r"]].to_numpy() for k, g in got.groupby("target")}
    full = {k: np.cov(x.T, bias=True) for k, x in parts.items()}
    tied = sum(len(x) * full[k] for k, x in parts.items()) / len(got)
    of = {"full": lambda k: full[k], "tied": lambda k: tied, "diag": lambda k: np.diag(np.diag(full[k])), "spherical": lambda k: np.eye(2) * np.trace(full[k]) / 2}[kind]
    each = {k: np.sqrt(np.einsum("ij,jk,ik->i", o := got[["vol", "r"]].to_numpy() - parts[k].mean(0), np.linalg.inv(of(k)), o)) for k in parts}
    assert np.allclose(got.mahalanobis, [each[k][i] for i, k in enumerate(got.target)]) and np.allclose(got.mahalanobis_nearest, np.min(list(each.values()), 0))


def test_mahalanobis_odd_rows_and_outliers(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0), (1.0, 1.0, 0), (5.0, None, 0), (2.0, 2.0, 1), (9.0, 1.0, 1), (3.0, 7.0, 1), (3.0, 3.0, None)], "x double, y double, regime int")
    got = S.outliers(S.with_mahalanobis(df, ["x", "y"]), 0.2).toPandas()
    assert np.isnan(got.mahalanobis[2]) and got.mahalanobis[0] == pytest.approx(0, abs=1e-3) and np.isnan(got.mahalanobis[6]) and np.isfinite(got.mahalanobis_nearest[6]) and not got.outlier[2]
    assert S.with_mahalanobis(df.limit(0), ["x", "y"]).count() == 0


def test_weights_by_brute_force(spark):
    rng = np.random.default_rng(2)
    votes, y = rng.integers(0, 3, (200, 3)), rng.integers(0, 3, 200)
    votes[:120, 1] = y[:120]
    df = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(votes, y)], "votes array<int>, target int")
    got = {tuple(r.weights): r.accuracy for r in S.weight_scores(df, "votes", "target", 3, 4).collect()}
    want = {}
    for c in product(range(5), repeat=3):
        if sum(c) == 4:
            w = np.array(c) / 4
            mass = np.array([[round(sum(w[v == k]), 9) for k in range(3)] for v in votes])
            want[tuple(w)] = (mass.argmax(1) == y).mean()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    best = S.best_weights(df, "votes", "target", 3, 4)
    assert want[tuple(best)] == max(want.values()) and sum(best) == 1


def test_periods_that_overlap(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"id": range(500), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 90 * 24, 500), unit="h")})
    starts = pd.Timestamp("2023-12-20") + pd.to_timedelta(rng.integers(0, 100 * 24, 40), unit="h")
    periods = pd.DataFrame({"name": [f"p{i}" for i in range(40)], "start": starts, "stop": starts + pd.to_timedelta(rng.integers(-5, 600, 40), unit="h")})
    got = I.in_periods(spark.createDataFrame(rows), spark.createDataFrame(periods), bucket="7 days")
    want = {(i, n) for i, t in zip(rows.id, rows.ts) for n, a, b in zip(periods.name, periods.start, periods.stop) if a <= t <= b}
    pairs = [(r.id, r.name) for r in got.select("id", "name").collect()]
    assert set(pairs) == want and len(pairs) == len(want)
    odd = spark.createDataFrame([("x", None, pd.Timestamp("2024-01-01").to_pydatetime())], "name string, start timestamp, stop timestamp")
    assert I.in_periods(spark.createDataFrame(rows), odd).count() == 0


def test_wider_bars_are_known_from_their_end(spark):
    n = 60
    base = pd.DataFrame({"symbol": "a", "timeframe": "H1", "ts": pd.date_range("2024-01-01", periods=n, freq="h").delete(range(10, 15)), **{c: np.arange(n - 5, dtype=float) + i for i, c in enumerate(B.PRICES)}, "volume": 1.0})
    bars = lambda f: spark.createDataFrame(f).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = I.with_wider(bars(base), "H1", ["H4", "D"]).toPandas().sort_values("ts").reset_index(drop=True)
    for r in got.itertuples():
        end = r.ts + pd.Timedelta("1h")
        for w, width in (("H4", "4h"), ("D", "1D")):
            wide = base.assign(start=base.ts.dt.floor(width)).groupby("start").agg(close=("close", "last"), volume=("volume", "sum"))
            done = wide[wide.index + pd.Timedelta(width) <= end]
            if len(done):
                assert (getattr(r, f"close_{w}"), getattr(r, f"volume_{w}"), getattr(r, f"ts_{w}")) == (done.close.iloc[-1], done.volume.iloc[-1], done.index[-1])
            else:
                assert pd.isna(getattr(r, f"close_{w}"))
    # A bar of the future changes nothing before it has ended.
    moved = base.copy()
    moved.loc[40:, ["close", "volume"]] = 1e6
    again = I.with_wider(bars(moved), "H1", ["H4", "D"]).toPandas().sort_values("ts").reset_index(drop=True)
    early = got.ts < base.ts[40]
    assert got[early].equals(again[early])
