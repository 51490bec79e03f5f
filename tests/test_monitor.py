"""The monitor against one pass over the whole series: out of order, over restarts, with symbols that fall silent."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import features as X
from tidegauge.functions import recursive as R
from tidegauge.streaming import monitor as M

RULE = M.by_cuts("vol", (0.01, 0.03))


def series(n, symbol, start="2024-01-01", seed=0):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, np.where(np.arange(n) % 60 < 30, 0.005, 0.05))))
    return pd.DataFrame({"symbol": symbol, "ts": pd.date_range(start, periods=n, freq="h"), "close": close})


def feed(spark, folder, frame):
    spark.createDataFrame(frame.assign(ts=frame.ts.astype(str))).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, tmp_path, **options):
    """Runs the stream over what lies in folder and isn't read yet, a file a batch; the rows so far and the query's progress."""
    own = M.own_session(spark)
    stream = own.readStream.schema("symbol string, ts timestamp, close double").option("maxFilesPerTrigger", 1).parquet(folder)
    q = M.monitor(stream, RULE, **options).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(M.OUT).parquet(f"{tmp_path}/out").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True), q.recentProgress


def same(got, want):
    pd.testing.assert_frame_equal(got[want.columns].reset_index(drop=True), want.reset_index(drop=True), check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def whole():
    return pd.concat([series(200, "a", seed=1), series(120, "b", "2024-01-03", seed=2)])


def test_equals_batch_out_of_order_and_over_restarts(spark, tmp_path, whole):
    """Bars come shuffled within two hours, in six batches, the query is stopped after three."""
    folder, late = f"{tmp_path}/bars", pd.Timedelta("3h")
    rng = np.random.default_rng(5)
    mixed = whole.iloc[np.argsort((whole.ts + pd.to_timedelta(rng.uniform(0, 2, len(whole)), unit="h")).to_numpy())]
    parts = [mixed.iloc[i : i + 55] for i in range(0, len(mixed), 55)]
    for p in parts[:3]:
        feed(spark, folder, p)
    first, _ = run(spark, folder, tmp_path, late="3 hours", silent="365 days")
    for p in parts[3:]:
        feed(spark, folder, p)
    got, _ = run(spark, folder, tmp_path, late="3 hours", silent="365 days")
    assert 0 < len(first) < len(got)
    bars = spark.createDataFrame(whole.assign(ts=whole.ts.astype(str))).withColumn("ts", F.col("ts").cast("timestamp"))
    want = M.batch(bars, RULE).toPandas().sort_values(["symbol", "ts"])
    same(got, want[want.ts <= whole.ts.max() - late])
    assert set(got.event) == {"bar", "change"}


def test_batch_equals_window_features(spark, whole):
    """What one pass gives is what windows and the recursions of a series give."""
    bars = spark.createDataFrame(whole.assign(ts=whole.ts.astype(str))).withColumns({"ts": F.col("ts").cast("timestamp"), "timeframe": F.lit("H1")})
    df = X.with_returns(bars).withColumn("vol", X.volatility("returns", 20))
    want = R.ewm(R.ewm(df, "close", span=12, adjust=False, out="fast"), "close", span=26, adjust=False, out="slow").toPandas().sort_values(["symbol", "ts"])
    got = M.batch(bars, RULE).toPandas().sort_values(["symbol", "ts"])
    same(got, want[["symbol", "ts", "close", "returns", "vol", "fast", "slow"]])
    for symbol, own in got.groupby("symbol"):
        r, v = own.returns.to_numpy()[1:], 1e-4
        for i, x in enumerate(r):
            assert own.garch_vol.iloc[i + 1] == pytest.approx(np.sqrt(v))
            v = 1e-5 + 0.1 * x * x + 0.85 * v
        change = own.regime.diff().fillna(0) != 0
        assert (change == (own.event == "change")).all() and (own.before[1:].astype(int) == own.regime[:-1].to_numpy()).all()


def test_silent_symbols_lose_their_state(spark, tmp_path):
    folder = f"{tmp_path}/bars"
    early, long = series(30, "early", seed=3), series(200, "long", seed=4)
    feed(spark, folder, pd.concat([early, long[:40]]))
    feed(spark, folder, long[40:120])
    feed(spark, folder, long[120:])
    got, progress = run(spark, folder, tmp_path, late="1 hour", silent="48 hours")
    silent = got[got.event == "silent"]
    assert silent.symbol.tolist() == ["early"] and silent.ts.iloc[0] == early.ts.max()
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert totals[-1] < max(totals)
    # It comes back: with its past gone it begins anew.
    feed(spark, folder, series(60, "early", "2024-01-12", seed=6))
    got, _ = run(spark, folder, tmp_path, late="1 hour", silent="48 hours")
    again = got[(got.symbol == "early") & (got.ts >= "2024-01-12") & (got.event != "silent")]
    assert len(again) and np.isnan(again.returns.iloc[0]) and again.vol[:20].isna().all()


def test_processing_time_with_ttl_and_odd_rows(spark, tmp_path):
    """State that hasn't been written to for a while is gone: bars that come later begin anew."""
    folder, own = f"{tmp_path}/bars", M.own_session(spark)
    frame = series(40, "a", seed=7)
    odd = pd.DataFrame({"symbol": ["a", None, "a"], "ts": [frame.ts[5], frame.ts[0], frame.ts[39]], "close": [float("nan"), 3.0, 1e9]})
    feed(spark, folder, pd.concat([frame[:25], odd[:2]]))
    stream = own.readStream.schema("symbol string, ts timestamp, close double").parquet(folder)
    q = M.monitor(stream, RULE, ttl="15 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(processingTime="500 milliseconds").start()

    def read(n):
        until = time.monotonic() + 60
        while sum(p["numInputRows"] for p in q.recentProgress) < n and q.isActive and time.monotonic() < until:
            time.sleep(0.3)

    try:
        read(27)
        feed(spark, folder, pd.concat([frame[20:], odd[2:]]))
        read(48)
        time.sleep(16)
        feed(spark, folder, series(30, "a", "2024-02-01", seed=8))
        read(78)
    finally:
        q.stop()
    got = spark.read.schema(M.OUT).parquet(f"{tmp_path}/out").toPandas().sort_values(["symbol", "ts"])
    own = got[(got.symbol == "a")].reset_index(drop=True)
    bars = lambda f: spark.createDataFrame(f.assign(ts=f.ts.astype(str))).withColumn("ts", F.col("ts").cast("timestamp"))
    want = [M.batch(bars(f), RULE).toPandas().sort_values("ts") for f in (frame, series(30, "a", "2024-02-01", seed=8))]
    same(own, pd.concat(want))
    assert got.symbol.isna().sum() == 1


def test_rules():
    f = pd.DataFrame({"vol": [np.nan, 0.5, 1.5, 9.0], "x": [0.0, 0.0, 3.0, 10.0]})
    regime, sure = M.by_cuts("vol", (1.0, 3.0))(f)
    assert regime.tolist() == [0, 0, 1, 2] and sure.tolist() == [0, 0.5, 0.5, 1]
    regime, sure = M.by_centres(["vol", "x"], np.array([[0.5, 0.0], [9.0, 10.0]]))(f)
    assert regime.tolist() == [-1, 0, 0, 1] and sure[0] == 0 and sure[1] == 1 and 0.5 < sure[2] < 1
