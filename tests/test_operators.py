"""Operators on small fixtures: known values, plain versions, odd rows."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import entropy as E
from tidegauge.functions import features as X
from tidegauge.functions import recursive as R
from tidegauge.functions import windows as W
from tidegauge.operators import classify as C
from tidegauge.operators import clean, garch, hmm, reports
from tidegauge.operators import metrics as M
from tidegauge.operators import regimes as G
from tidegauge.operators import select as S
from tidegauge.operators import splits as P
from tidegauge.sources import bars as B
from tidegauge.sources import payloads, service
from tidegauge.sources.store import BarStore

T0 = dt.datetime(2024, 1, 1)


def walk(n=100, seed=42):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = np.r_[close[0], close[:-1]] * (1 + rng.normal(0, 0.01, n))
    high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.02, n))
    low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.02, n))
    return pd.DataFrame({"symbol": "s", "timeframe": "D", "ts": [T0 + dt.timedelta(days=i) for i in range(n)], "open": open_, "high": high, "low": low, "close": close, "volume": rng.uniform(1e5, 1e6, n)})


@pytest.fixture(scope="module")
def frame():
    return walk()


@pytest.fixture(scope="module")
def bars(spark, frame):
    return spark.createDataFrame(frame, B.SCHEMA).cache()


def values(df, c):
    return df.orderBy("ts").toPandas()[c].astype(float).to_numpy()


def close_to(a, b):
    np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize(("op", "f"), [("mean", "mean"), ("std", "std"), ("var", "var"), ("median", "median"), ("skew", "skew"), ("kurt", "kurt"), ("min", "min"), ("max", "max"), ("sum", "sum")])
def test_rolling_like_pandas(bars, frame, op, f):
    close_to(values(bars.withColumn("x", X.rolling("close", 20, op)), "x"), getattr(frame.close.rolling(20), f)())


def test_indicators_like_pandas(bars, frame):
    d = frame.close.diff()
    gain, loss = d.clip(lower=0).fillna(0).rolling(14).mean(), (-d).clip(lower=0).fillna(0).rolling(14).mean()
    close_to(values(X.with_rsi(bars), "rsi"), 100 - 100 / (1 + gain / loss))
    tr = pd.concat([frame.high - frame.low, (frame.high - frame.close.shift()).abs(), (frame.low - frame.close.shift()).abs()], axis=1).max(axis=1)
    close_to(values(X.with_atr(bars), "atr"), tr.rolling(14).mean())
    macd = frame.close.ewm(span=12, adjust=False).mean() - frame.close.ewm(span=26, adjust=False).mean()
    close_to(values(R.macd(bars), "macd"), macd)
    close_to(values(R.ewm(bars, "close", alpha=0.3, operation="std"), "ewm_std"), frame.close.ewm(alpha=0.3).std())
    tp = (frame.high + frame.low + frame.close) / 3
    cci = tp.rolling(20).apply(lambda w: (w[-1] - w.mean()) / (0.015 * np.abs(w - w.mean()).mean()), raw=True)
    close_to(values(X.with_cci(bars), "cci"), cci)


def test_volatility_by_hand(bars, frame):
    hl = np.log(frame.high / frame.low) ** 2
    close_to(values(X.with_volatility(bars), "parkinson_20"), np.sqrt(hl.rolling(20).mean() / (4 * math.log(2)) * 252))
    r = frame.close.pct_change()
    got = values(R.garch_volatility(X.with_returns(bars)), "garch_vol")
    v = r[1:].var(ddof=0)
    assert got[1] == pytest.approx(math.sqrt(v)) and got[2] == pytest.approx(math.sqrt(1e-5 + 0.1 * r[1] ** 2 + 0.85 * v))


def test_constant_prices_give_nulls_not_errors(spark):
    df = spark.createDataFrame([("s", "D", T0 + dt.timedelta(days=i), 100.0, 100.0, 100.0, 100.0, 0.0) for i in range(40)], B.SCHEMA)
    out = X.with_money_flow(X.with_cci(X.with_stochastic(X.with_rsi(X.with_bollinger(df))))).withColumns({"z": X.rolling_zscore(), "k": W.kurtosis("close", 20), "w": X.williams_r(), "v": X.vwap()})
    last = out.orderBy(F.desc("ts")).first()
    assert all(last[c] is None for c in ("rsi", "stoch_k", "cci", "mfi", "z", "k", "w", "v", "bb_position")) and last["bb_upper"] == 100


def test_complexity_on_known_series():
    rng = np.random.default_rng(1)
    noise, sine = rng.normal(size=400), np.sin(np.arange(400) * 0.2)
    for f in (E.approximate, E.sample, E.spectral, E.lempel_ziv, E.conditional):
        assert f(noise) > f(sine), f.__name__
    assert E.hurst(noise) == pytest.approx(0.55, abs=0.15) and E.hurst(np.cumsum(noise)) > 0.8
    assert E.dickey_fuller(noise) < -5 < E.dickey_fuller(np.cumsum(noise))
    assert E.partial_autocorrelation(sine, 1) > 0.9
    lagged = np.r_[0, noise[:-1]] + 0.1 * rng.normal(size=400)
    assert E.transfer(noise, lagged) > E.transfer(lagged, noise)
    plain = -math.log(sum(max(abs(noise[i + k] - noise[j + k]) for k in range(3)) <= 0.2 * noise[:60].std() for i in range(58) for j in range(i + 1, 58)) / sum(max(abs(noise[i + k] - noise[j + k]) for k in range(2)) <= 0.2 * noise[:60].std() for i in range(58) for j in range(i + 1, 58)))
    assert E.sample(noise[:60]) == pytest.approx(plain)
    assert math.isnan(E.approximate(np.ones(20))) and math.isnan(E.sample(np.ones(20)))


def test_validation(spark, bars):
    assert B.validate(bars) is bars
    with pytest.raises(ValueError, match="high_too_low"):
        B.validate(bars.withColumn("high", F.col("low") / 2))
    with pytest.raises(ValueError, match="no bars"):
        B.validate(bars.limit(0))
    for bad in (("", "D"), ("s", "")):
        with pytest.raises(ValueError):
            B.fetch_checked(*bad)
    with pytest.raises(ValueError):
        B.fetch_checked("s", "D", 2, 1)
    raw = spark.createDataFrame([("2024-01-02", "1", "2", "0.5", "x"), ("2024-01-01", "1", "2", "0.5", "1.5"), ("2024-01-01", "1", "3", "0.5", "1.7")], "date string, o string, High string, low string, Close string").coalesce(1)
    got = B.standardized(raw, "s", "D").orderBy("ts").collect()
    assert [(r.high, r.close, r.volume) for r in got] == [(3.0, 1.7, 0.0), (2.0, None, 0.0)]
    with pytest.raises(ValueError):
        B.standardized(raw.drop("low"), "s", "D")


def test_store(spark, bars, tmp_path):
    store = BarStore(spark, str(tmp_path / "bars"))
    assert store.read("s", "D").count() == 0 and store.last_ts("s", "D") is None
    assert store.write(bars) == 100 and store.write(bars.limit(0)) == 0
    assert store.write(bars.limit(2).withColumn("close", F.lit(1.0))) == 2
    assert store.read("s", "D").count() == 100 and store.read("s", "D").where("close = 1").count() == 2
    store.write(bars.limit(3).withColumn("symbol", F.lit("t")))
    assert store.series().count() == 2 and store.read("s").count() == 100
    assert store.last_ts("s", "D") == T0 + dt.timedelta(days=99)
    assert store.aggregated("s", "D", "W").agg(F.sum("volume")).first()[0] == pytest.approx(bars.agg(F.sum("volume")).first()[0])


def test_store_rewrites_months(spark, bars, tmp_path):
    store = BarStore(spark, str(tmp_path / "bars"))
    store.write(bars)
    files = lambda: {m.name: sorted(f.name for f in m.glob("*.parquet")) for m in (tmp_path / "bars").glob("*/*/month=*")}
    before, late = files(), T0 + dt.timedelta(days=40)
    assert len(before) > 3
    store.write(bars.where(F.col("ts") == F.lit(late)).withColumn("close", F.lit(2.5)))
    after, month = files(), f"month={100 * late.year + late.month}"
    assert set(after) == set(before) and {m for m in after if after[m] != before[m]} == {month}
    assert store.read("s", "D").count() == 100 and store.read().where("close = 2.5").select("ts").first()[0] == late
    part = store.read("s", "D", late, late + dt.timedelta(days=3))
    assert sorted(r.ts for r in part.collect()) == [late + dt.timedelta(days=k) for k in range(3)]
    assert "month" in part._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("PushedFilters")[0]
    lost = bars.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    store.write(lost.withColumn("symbol", F.lit("u")))
    store.write(lost.withColumns({"symbol": F.lit("u"), "volume": F.lit(9.0)}))
    assert store.read("u").count() == 1 and store.read().count() == 101


def test_imputation(spark):
    df = spark.createDataFrame([("s", "D", T0 + dt.timedelta(days=i), x, y) for i, (x, y) in enumerate([(None, 1.0), (1.0, 2.0), (None, 3.0), (None, 4.0), (4.0, 5.0), (None, 6.0)])], "symbol string, timeframe string, ts timestamp_ntz, x double, y double")
    close_to(values(clean.interpolated(df, ["x"]), "x"), [1, 1, 2, 3, 4, 4])
    close_to(values(clean.handle_missing(df, ["x", "y"], "knn", k=1).where("x is not null"), "x"), [1, 1, 1, 4, 4, 4])
    for s in ("forward", "backward", "mean", "median", "fill", "drop"):
        clean.handle_missing(df, ["x"], s).count()
    with pytest.raises(ValueError):
        clean.handle_missing(df, ["x"], "other")
    fitted = clean.scaler(df, ["y"])
    assert clean.scale(df, fitted).agg(F.avg("y"), F.stddev_pop("y")).first() == pytest.approx((0, 1))


def labels(spark, values_, p=None):
    rows = [("s", "D", T0 + dt.timedelta(days=i), int(v)) for i, v in enumerate(values_)]
    return spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp_ntz, regime int")


def test_block_labels(spark):
    df = labels(spark, [0] * 30 + [1] * 40 + [2] * 30)
    assert {(r.regime, r.length) for r in G.runs(df).collect()} == {(0, 30), (1, 40), (2, 30)}
    t = {(r.from_regime, r.to_regime): r.n for r in M.transition_matrix(df).collect()}
    assert t == {(0, 0): 29, (0, 1): 1, (1, 1): 39, (1, 2): 1, (2, 2): 29}
    dense = M.transition_matrix(df, 4)
    assert dense.count() == 16 and {r.valid for r in M.is_stochastic(dense).where("from_regime < 3").collect()} == {True}
    s = M.stability(df).first()
    assert (s.changes, s.steps, s.runs) == (2, 99, 3) and s.persistence == pytest.approx(97 / 99)
    assert values(G.smoothed(labels(spark, [0, 0, 1, 0, 0, 2, 2]), 3), "smoothed").tolist() == [0, 0, 0, 0, 0, 2, 2]
    assert values(G.with_duration(df), "duration")[:3].tolist() == [0, 2, 3]


def test_agreement(spark):
    t, p = [0] * 4 + [1] * 4 + [2] * 4 + [0] * 3, [0, 0, 0, 1, 1, 1, 1, 1, 2, 2, 2, 0, 0, 0, 1]
    df = spark.createDataFrame(list(zip(t, p)), "t int, p int")
    a = M.agreement(df, "t", "p").first()
    assert a.accuracy == pytest.approx(12 / 15)
    pairs = lambda f: sum(f(i, j) for i in range(15) for j in range(i))
    both, st, sp, n = pairs(lambda i, j: t[i] == t[j] and p[i] == p[j]), pairs(lambda i, j: t[i] == t[j]), pairs(lambda i, j: p[i] == p[j]), 105
    assert a.adjusted_rand == pytest.approx((both - st * sp / n) / ((st + sp) / 2 - st * sp / n))
    assert M.adjusted_mutual_info(df, "t", "p") < a.normalized_mutual_info
    same = M.agreement(df, "t", "t").first()
    assert same.adjusted_rand == same.normalized_mutual_info == pytest.approx(1) and M.adjusted_mutual_info(df, "t", "t") == pytest.approx(1)


def test_cluster_quality(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.5, (20, 3)) for m in (0, 3, -3)])
    y = np.repeat([0, 1, 2], 20)
    df = spark.createDataFrame([("s", "D", T0 + dt.timedelta(days=i), int(c), *map(float, v)) for i, (v, c) in enumerate(zip(x, y))], "symbol string, timeframe string, ts timestamp_ntz, regime int, a double, b double, c double")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    s = []
    for i in range(60):
        own = d[i][(y == y[i]) & (np.arange(60) != i)].mean()
        near = min(d[i][y == k].mean() for k in range(3) if k != y[i])
        s.append((near - own) / max(own, near))
    assert M.silhouette(df, ["a", "b", "c"], block=7).first()[0] == pytest.approx(np.mean(s))
    q = M.cluster_quality(df, ["a", "b", "c"]).first()
    assert q.separation > 4 and q.davies_bouldin < 0.5 and q.calinski_harabasz > 500
    assert M.silhouette(df.withColumn("regime", F.lit(1)), ["a", "b"]).first()[0] == 0


def test_ranges():
    assert P.time_series_ranges(120, 5)[:2] == [(0, "train", 0, 19), (0, "test", 20, 39)]
    assert P.walk_forward_ranges(336) == [(0, "train", 0, 251), (0, "test", 252, 314)]
    got = P.purged_ranges(100, 5, 10, 2)
    assert (2, "train", 0, 29) in got and (2, "train", 70, 99) in got and (2, "test", 40, 57) in got


def test_selection(spark):
    rng = np.random.default_rng(0)
    a, n = rng.normal(size=300), rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": a * 2 + 0.001 * n, "c": n, "flat": 1.0, "y": (a > 0).astype(int)}))
    assert S.uncorrelated(df, ["a", "b", "c"]) == ["a", "c"]
    assert S.by_variance(df, ["a", "flat"]) == ["a"] and S.top_variance(df, ["a", "b", "c"], 1) == ["b"]
    for score in S.SCORES:
        assert S.k_best(df, ["c", "a"], "y", 1, score) == ["a"]
    found = S.importances(df, ["a", "c"], "y", 10)
    assert S.by_importance(found) == ["a"] and S.recursive_elimination(df, ["a", "c"], "y", 1, trees=5) == ["a"]
    assert S.voted([["a", "b"], ["a"], ["a", "c"]], "majority") == S.voted([["a", "b"], ["a"], ["a", "c"]], "intersection") == ["a"]


def regimes(spark, n=300):
    rng = np.random.default_rng(3)
    y = np.repeat([0, 1, 2], n // 3)
    x = rng.normal(size=(n, 2)) * 0.4 + np.column_stack([y * 2.0, y % 2 * 2.0])
    return spark.createDataFrame([("s", "D", T0 + dt.timedelta(days=i), int(c), *map(float, v)) for i, (v, c) in enumerate(zip(x, y))], "symbol string, timeframe string, ts timestamp_ntz, target int, a double, b double").cache()


def test_hidden_markov_and_mixtures(spark):
    df = regimes(spark)
    for markov, kind in ((True, "full"), (True, "tied"), (False, "diag"), (False, "spherical")):
        made = hmm.fitted(df, ["a", "b"], 3, kind, 3, markov)
        got = hmm.predicted(df, made, ["a", "b"], markov)
        assert C.accuracy(got) > 0.95, (markov, kind)
        assert got.where(F.abs(F.aggregate("p", F.lit(0.0), lambda s, v: s + v) - 1) > 1e-6).count() == 0
    assert hmm.fitted(df, ["a", "b"], ks=(2, 3, 4), kind="diag", starts=2).first().k == 3
    assert hmm.sampled(made, 20).count() == 20
    path, _ = hmm.viterbi(np.log(np.array([[0.9, 0.1], [0.4, 0.6], [0.9, 0.1]])), np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]))
    assert path.tolist() == [0, 0, 0]


def test_clusterings_classifiers_ensembles(spark):
    df = regimes(spark)
    assert C.accuracy(C.clustered(df, ["a", "b"])) > 0.95 and C.accuracy(C.mixture(df, ["a", "b"])) > 0.95
    members = [C.Detector(n, ["a", "b"]).fit(df, "target") for n in ("random_forest", "logistic")]
    for m in members:
        assert C.accuracy(m.transform(df)) > 0.95
    for strategy in ("voting", "weighted", "consensus", "bayesian"):
        assert C.accuracy(C.voted(df, members, strategy, [2.0, 1.0])) > 0.95, strategy
    assert C.diversity(C.voted(df, members)).first().diversity < 0.1
    assert sum(members[0].importances().values()) == pytest.approx(1)
    assert C.accuracy(C.hierarchical(df, [[C.Detector("logistic", ["a"])], [C.Detector("random_forest", ["a", "b"], numTrees=5)]], "target")) > 0.95
    with pytest.raises(ValueError):
        C.classifier("other")


def test_garch(spark):
    rng = np.random.default_rng(5)
    e, v, r = rng.normal(size=1500), 0.1, []
    for x in e:
        r.append(math.sqrt(v) * x)
        v = 0.02 + 0.15 * r[-1] ** 2 + 0.75 * v
    m = garch.estimate(np.array(r))
    assert m["alpha"] == pytest.approx(0.15, abs=0.08) and m["persistence"] == pytest.approx(0.9, abs=0.1)
    assert garch.breaks(np.r_[np.zeros(50), np.ones(50) * 5, np.ones(50) * 9], 3, "jenks") == [0.0, 5.0]
    sd = np.repeat([0.01, 0.05, 0.2], 120)
    df = spark.createDataFrame([("s", "D", T0 + dt.timedelta(days=i), float(x * s), i // 120) for i, (x, s) in enumerate(zip(rng.normal(size=360), sd))], "symbol string, timeframe string, ts timestamp_ntz, returns double, target int")
    assert C.accuracy(garch.regimes(df)) > 0.8 and C.accuracy(garch.switching(df)) > 0.8


def test_backtest_and_reports(spark):
    df = labels(spark, [0, 0, 1, 1, 0]).withColumn("returns", F.lit(0.1))
    got = reports.backtested(df, {0: 1.0, 1: 0.0}, cost=0.01)
    close_to(values(got, "position"), [0, 1, 1, 0, 0])
    close_to(values(got, "net"), [0, 0.09, 0.1, -0.01, 0])
    assert reports.backtest_summary(got).first().total_return == pytest.approx(1.09 * 1.1 * 0.99 - 1)
    scores = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 1.0), ("d", "c", 0.5)], "dataset string, model string, score double")
    assert {r.model: r.rank for r in reports.ranked(scores).collect()} == {"a": 1.5, "b": 1.5, "c": 3.0}
    assert reports.markdown(scores.orderBy("model")).count("\n") == 5


def fake_fetch(kind, symbol, timeframe, start, stop):
    if symbol == "BAD":
        raise ConnectionError("no")
    base = start.replace(minute=0, second=0)
    hours = int((stop - base).total_seconds() // 3600) + 1
    base = base.replace(tzinfo=dt.timezone.utc)
    return "[" + ",".join(f'["{int((base + dt.timedelta(hours=h)).timestamp() * 1000)}","1","2","0.5","1.5","10"]' for h in range(hours)) + "]"


def test_data_source(spark):
    more = {"fetcher": "tests.test_operators.fake_fetch", "pause": "0", "tries": "2"}
    got = service.fetched(spark, "klines", ["A", "B"], "H1", "2024-01-01", "2024-03-01", limit=None, **more)
    assert got.count() == 2 * (60 * 24 + 1)
    assert service.fetched(spark, "klines", ["A"], "H1", "2024-01-01", "2024-01-03", limit=5, **more).count() == 5
    with pytest.raises(Exception, match="no"):
        service.fetched(spark, "klines", ["BAD"], "H1", "2024-01-01", "2024-01-02", **more).count()
    with pytest.raises(ValueError):
        service.fetched(spark, "klines", [], "H1", "2024-01-01", "2024-01-02", **more)


def test_payload_errors(spark):
    df = spark.createDataFrame([("s", "D", '{"Note": "too often"}')], "symbol string, timeframe string, payload string")
    with pytest.raises(Exception, match="too often"):
        payloads.keyed_series(df).collect()
    with pytest.raises(Exception, match="unknown timeframe"):
        spark.range(1).select(payloads.timeframe_code("series", F.lit("7x"))).collect()
    got = payloads.traded(spark.createDataFrame([('{"symbols": [{"symbol": "B", "status": "TRADING"}, {"symbol": "A", "status": "BREAK"}]}',)], "payload string"))
    assert [r.symbol for r in got.collect()] == ["B"]


def test_correlation_without_spread_is_null(spark, bars):
    flat = X.with_returns(bars).withColumn("one", F.lit(1.0))
    got = flat.withColumn("c", W.correlation("returns", "one", 20)).agg(F.count("c"), W.corr("returns", "one").alias("all")).first()
    assert got[0] == 0 and got["all"] is None
    assert {r["corr"] for r in S.correlations(flat, ["one", "close"]).collect()} == {None}
    close_to(values(flat.withColumn("c", W.correlation("returns", "volume", 20)), "c"), flat.orderBy("ts").toPandas().pipe(lambda d: d.returns.rolling(20).corr(d.volume)))


def test_feature_engine(bars, tmp_path, monkeypatch):
    from tidegauge.plans import engine

    got = engine.compute(bars, config={"entropy": {"window": 30}})
    assert {"rsi", "macd", "sma_20", "ema_20", "parkinson_20", "mean_20", "shannon", "permutation"} <= set(got.columns) and got.count() == 100
    for bad in ({"other": {}}, {"volatility": {"window": 1}}):
        with pytest.raises(ValueError):
            engine.compute(bars, config=bad)
    with pytest.raises(ValueError):
        engine.compute(bars, ["other"])
    monkeypatch.setenv("N_BINS", "8")
    engine.save_config({"entropy": {"features": ["shannon", "${NOBODY}"], "bins": 8}}, str(tmp_path / "c.json"))
    assert engine.load_config(str(tmp_path / "c.json"))["entropy"]["features"][1] == "${NOBODY}"
    cache = engine.FeatureCache()
    assert cache.get(bars, ["statistical"]) is cache.get(bars, ["statistical"]) and len(cache.held) == 1
    cache.clear()


def test_more_models(spark, tmp_path):
    df = regimes(spark)
    assert C.accuracy(C.boosted_stumps(df, ["a", "b"], "target", 6, 2)) > 0.95
    made = C.Detector("logistic", ["a", "b"]).fit(df, "target")
    C.save(made, str(tmp_path / "m"))
    assert C.accuracy(C.load(spark, str(tmp_path / "m")).transform(df)) == C.accuracy(made.transform(df))
    machine = C.Detector("svm_linear", ["a", "b"], calibrated=True, maxIter=8).fit(df.withColumn("ts", F.timestamp_seconds(F.pmod(F.xxhash64("a"), F.lit(100_000))).cast("timestamp_ntz")), "target")
    C.save(machine, str(tmp_path / "svm"))
    again = C.load(spark, str(tmp_path / "svm"))
    assert again.params() == machine.params() and again.calibrated
    assert again.transform(df, "l").select("l", "l_p").exceptAll(machine.transform(df, "l").select("l", "l_p")).count() == 0
    assert C.best_k(df, ["a", "b"], (2, 3, 4)) == 3 and C.best_k(df, ["a", "b"], (2, 3), "calinski", 0.05) == 3
    far = df.unionByName(df.limit(1).withColumns({"a": F.lit(60.0), "b": F.lit(-60.0)}))
    top = C.isolation_scores(far, ["a", "b"], 50).orderBy(F.desc("isolation")).first()
    assert top.a == 60 and top.isolation > 0.6
    names = {r.name for r in M.labelled_by_rank(df.withColumn("returns", F.col("a")).withColumnRenamed("target", "regime"), 3).collect()}
    assert names == {"Bear_L1", "Neutral", "Bull_L1"}
    assert M.labelled_by_moments(df.withColumn("regime", F.col("target")), "a").count() == M.labelled_by_quantiles(df.withColumn("regime", F.col("target")), "a").count() == 3


def test_shapiro_wilk():
    rng = np.random.default_rng(2)
    assert E.shapiro_wilk(rng.normal(size=200)) > 0.98 > E.shapiro_wilk(rng.exponential(size=200)) + 0.05
    assert E.shapiro_wilk(np.array([1.0, 2.0, 3.0])) == pytest.approx(1.0)
