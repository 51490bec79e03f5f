"""Evaluation, selection of thresholds, detectors' outputs and file readers against plain versions."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import entropy, recursive
from tidegauge.operators import classify, clean, garch, hmm, metrics
from tidegauge.plans import models
from tidegauge.sources import bars, files, service


def test_variance_recursion_equals_a_loop():
    r = np.random.default_rng(1).normal(0, 1, 500)
    for beta in (0.0, 0.5, 0.999999, 1.0):
        want = [r.var()]
        for t in range(1, len(r)):
            want.append(0.1 + 0.2 * r[t - 1] ** 2 + beta * want[-1])
        assert recursive.garch_path(r, 0.1, 0.2, beta) == pytest.approx(np.array(want), rel=1e-8)


def test_chains_by_blocks_equal_a_loop():
    rng = np.random.default_rng(5)
    for n, k in ((1, 2), (2, 3), (7, 2), (50, 3), (333, 4)):
        log_b, start, trans = rng.normal(0, 3, (n, k)), rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k)
        b = np.exp(log_b)
        a, z = [start * b[0]], [np.ones(k)]
        for t in range(1, n):
            a.append(a[-1] @ trans * b[t])
        for t in range(n - 1, 0, -1):
            z.append(trans @ (b[t] * z[-1]))
        z.reverse()
        total = a[-1].sum()
        ll, post, moved = hmm.forward_backward(log_b, start, trans)
        assert ll == pytest.approx(math.log(total)) and post == pytest.approx(np.array(a) * np.array(z) / total)
        want = sum((a[t][:, None] * trans * (b[t + 1] * z[t + 1])[None] / total for t in range(n - 1)), np.zeros((k, k)))
        assert moved == pytest.approx(want)
        score, came = np.log(start) + log_b[0], []
        for row in log_b[1:]:
            both = score[:, None] + np.log(trans)
            came.append(both.argmax(axis=0))
            score = both.max(axis=0) + row
        path = [int(score.argmax())]
        for c in reversed(came):
            path.append(int(c[path[-1]]))
        got, best = hmm.viterbi(log_b, start, trans)
        assert got.tolist() == path[::-1] and best == pytest.approx(score.max())


def test_natural_breaks_are_the_best_of_all():
    rng = np.random.default_rng(2)
    for k in (2, 3, 4):
        v = np.r_[rng.normal(0, 1, 8), rng.normal(9, 1, 7), rng.normal(30, 2, 5)]
        s = np.sort(v)
        cost = lambda x: ((x - x.mean()) ** 2).sum()
        best = min(combinations(range(1, len(s)), k - 1), key=lambda c: sum(cost(p) for p in np.split(s, c)))
        assert garch.breaks(v, k, "jenks") == [s[i - 1] for i in best]
    many = np.sort(np.r_[rng.normal(0, 1, 3000), rng.normal(20, 1, 3000)])
    assert garch.breaks(many, 2, "jenks") == [many[2999]]


def test_expected_cell_equals_the_plain_sum():
    lg = math.lgamma
    for x, y, n in ((3, 4, 10), (30, 50, 100), (400, 700, 1200)):
        want = sum(k / n * math.log(n * k / (x * y)) * math.exp(lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1) - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1)) for k in range(max(1, x + y - n), min(x, y) + 1))
        assert metrics._expected_cell(float(x), float(y), float(n)) == pytest.approx(want, rel=1e-9)
    assert abs(metrics._expected_cell(4e8, 5e8, 1e9)) < 1


def series_frame(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [("a", "H1", i, *v) for i, v in enumerate(zip(*columns.values()))]
    kinds = ", ".join(f"{c} {'int' if isinstance(next(x for x in v if x is not None), int) else 'double'}" for c, v in columns.items())
    df = spark.createDataFrame(rows, f"symbol string, timeframe string, i int, {kinds}")
    assert n
    return df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, i)")).drop("i")


def test_windows_measured_apart_equal_a_loop(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=90).tolist(), rng.normal(size=90).tolist()
    x[40] = None
    df = series_frame(spark, x=x, y=y)
    got = entropy.with_transfer(df, "x", "y", 30).orderBy("ts").collect()
    more = entropy.with_complexity(df, "y", 30, ("sample", "hurst", "lempel_ziv")).orderBy("ts").collect()
    for t in range(90):
        a, b = x[max(0, t - 29) : t + 1], y[max(0, t - 29) : t + 1]
        whole = t >= 29 and None not in a
        assert (got[t].transfer is not None) == whole
        if whole:
            assert got[t].transfer == pytest.approx(entropy.transfer(np.array(a), np.array(b)))
        if t >= 29:
            assert more[t]["hurst"] == pytest.approx(entropy.hurst(np.array(b)))
            assert more[t]["lempel_ziv"] == pytest.approx(entropy.lempel_ziv(np.array(b)))
        else:
            assert more[t]["sample"] is None


def test_stability_of_correlations_and_labels(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=200), rng.normal(size=200)
    label = [0] * 120 + [1] * 50 + [0] * 30
    df = series_frame(spark, x=x.tolist(), y=y.tolist(), regime=label)
    got = {r.regime: r.stability for r in metrics.correlation_stability(df, "x", "y", 30).collect()}
    at = np.flatnonzero(np.array(label) == 0)
    c = [np.corrcoef(x[at[i - 30 : i]], y[at[i - 30 : i]])[0, 1] for i in range(30, len(at))]
    assert got[0] == pytest.approx(1 / (1 + np.var(c))) and got[1] == 1.0
    want = np.mean([max(np.bincount(label[i - 5 : i])) / 5 for i in range(5, 200)])
    assert metrics.trailing_consistency(df).first()[0] == pytest.approx(want)
    assert metrics.trailing_consistency(df.limit(0)).first()[0] == 1.0


def test_reports_of_predictions(spark):
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (3, 0)]
    df = spark.createDataFrame(rows, "target int, regime int")
    got = {r["class"]: (r.support, r.precision, r.recall) for r in metrics.prediction_report(df).collect()}
    assert got[0] == (3, pytest.approx(2 / 3), pytest.approx(2 / 3)) and got[3] == (1, 0.0, 0.0) and got[2] == (1, 0.5, 1.0)
    one = metrics.prediction_summary(metrics.prediction_report(df)).first()
    assert one.accuracy == pytest.approx(4 / 7)


def test_evaluation_of_nothing_and_of_one_label(spark):
    df = series_frame(spark, x=[1.0, 2.0, 3.0], y=[1.0, 1.0, 2.0], regime=[0, 0, 0])
    one = metrics.evaluated(df, ["x", "y"]).first()
    assert one.silhouette == 0 and one.davies_bouldin is None and one.persistence == 1
    assert metrics.cluster_quality(df.limit(0), ["x", "y"]).first().separation is None


def test_global_statistics_leave_no_window(spark):
    df = series_frame(spark, x=[1.0, 2.0, None, 40.0])
    plan = clean.clipped(clean.scaled(df, ["x"], "minmax"), ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert [r.x for r in clean.scaled(df, ["x"], "minmax").orderBy("ts").collect()] == [0.0, pytest.approx(1 / 39), None, 1.0]
    assert clean.scaled(df.limit(0), ["x"], "robust").count() == 0


def test_members_share_their_clusters(spark, sf, monkeypatch):
    df = models.prepared(spark, sf)
    runs, clustered = [], classify.clustered
    monkeypatch.setattr(classify, "clustered", lambda *a: runs.append(a[2:4]) or clustered(*a))
    made = lambda: [classify.Detector("logistic", models.FEATURES, seed=s, maxIter=5) for s in (42, 42, 7)]
    shared = classify.fitted(df, made())
    assert [r[1] for r in runs] == [42, 7]
    alone = made()[0].fit(df)
    said = lambda d: {(r.symbol, r.ts): r.regime for r in d.transform(df).select("symbol", "ts", "regime").collect()}
    a, b, c = said(shared[0]), said(shared[1]), said(alone)
    assert a == b and a.keys() == c.keys() and sum(a[x] == c[x] for x in a) >= 0.99 * len(a)
    told = classify.fitted(df.withColumn("t", (F.col("vol") > 0.01).cast("int")), [classify.Detector("logistic", models.FEATURES, maxIter=5)], "t")
    assert len(runs) == 3 and set(said(told[0]).values()) <= {0, 1}


def test_machines_tell_margins_and_probabilities(spark, sf):
    df = models.prepared(spark, sf)
    d = classify.Detector("svm_linear", models.FEATURES, calibrated=True, maxIter=5).fit(df)
    got = d.transform(df)
    rows = got.select("regime", "regime_p", "regime_margins").collect()
    assert all(len(r.regime_margins) == 3 and sum(r.regime_p) == pytest.approx(1) for r in rows)
    assert np.mean([int(np.argmax(r.regime_p)) == r.regime for r in rows]) > 0.9
    assert 0 < d.support(df).count() < got.count()
    again = d.copy(k=2)
    assert again.k == 2 and again.params()["maxIter"] == 5
    with pytest.raises(ValueError):
        classify.Detector("logistic", ["a", "a"])
    assert classify.model_errors(k=1, seed=-1, covariance="round", features=["a"], rows=3) and not classify.model_errors(rows=30)


def test_members_weights(spark, sf):
    df, _ = models.prepared(spark, sf), None
    df = df.withColumn("target", (F.col("vol") > 1).cast("int"))
    w = classify.weights_of(df, [classify.Detector("logistic", models.FEATURES), classify.Detector("logistic", ["log_volume"])], "target")
    assert sum(w) == pytest.approx(1) and w[0] >= w[1] > 0


def test_files_with_odd_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,O,H,L,C\n2024-01-01 00:00:00,1,2,0.5,1.5\n2024-01-01 00:00:00,1,3,0.5,x\nnever,1,2,3,4\n2024-01-02 00:00:00,2,2,2,2\n")
    got = files.bar_files(spark, str(tmp_path / "a.csv"), "S", "D").orderBy("ts").collect()
    assert [(r.high, r.close, r.volume) for r in got] == [(3.0, None, 0.0), (2.0, 2.0, 0.0)]
    assert files.bar_files(spark, str(tmp_path / "a.csv"), "S", "D", last=1).count() == 1
    assert files.bar_files(spark, str(tmp_path / "a.csv"), "S", "D", until="2024-01-01").count() == 1
    with pytest.raises(ValueError):
        files.bar_files(spark, str(tmp_path / "a.csv"), kind="xls")


def test_of_equal_times_the_largest_order_stays(spark):
    raw = spark.createDataFrame([("S", "D", "2024-01-01", 1.0, 2.0, 0.5, 1.5, 7), ("S", "D", "2024-01-01", 1.0, 2.0, 0.5, 1.7, 3)], "symbol string, timeframe string, date string, open double, high double, low double, close double, at int")
    assert bars.standardized(raw, order=F.col("at")).first().close == 1.5
    assert bars.standardized(raw, order=-F.col("at")).first().close == 1.7


def test_calls_keep_their_distance():
    import time

    seen = []
    f = service.spaced(0.05)(lambda: seen.append(time.monotonic()))
    for _ in range(3):
        f()
    assert all(b - a >= 0.045 for a, b in zip(seen, seen[1:]))
