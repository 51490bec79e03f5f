"""Streams in append mode: late ticks, closed bars, state that goes."""

from pyspark.sql import functions as F

from tidegauge.streaming import bars as S


def ticks(spark, folder, batch, rows):
    df = spark.createDataFrame(rows, "symbol string, at string, price double").select("symbol", F.col("at").cast("timestamp").alias("ts"), "price")
    df.coalesce(1).write.mode("append").parquet(folder)
    return batch


def run(df, tmp_path, name):
    """One file a batch, to the end; returns rows and the last progress with state."""
    q = df.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/{name}"), q.recentProgress


def test_late_ticks_are_dropped_and_state_goes(spark, tmp_path):
    folder = f"{tmp_path}/ticks"
    ticks(spark, folder, 0, [("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 2.0), ("b", "2024-01-01 00:20:00", 9.0)])
    ticks(spark, folder, 1, [("a", "2024-01-01 03:30:00", 5.0)])
    ticks(spark, folder, 2, [("a", "2024-01-01 03:31:00", 5.0)])
    # The watermark, which drops ticks a batch after it has moved, stands at 03:20 now: a tick of 00:55 is too late, one of 03:25 isn't.
    ticks(spark, folder, 3, [("a", "2024-01-01 00:55:00", 99.0), ("a", "2024-01-01 03:25:00", 4.0), ("a", "2024-01-01 09:00:00", 7.0)])
    stream = spark.readStream.schema("symbol string, ts timestamp, price double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    got, progress = run(S.bars(stream, symbol="symbol", ts="ts", price="price"), tmp_path, "bars")
    rows = sorted((r.symbol, r.ts.hour, r.open, r.high, r.low, r.close, r.volume) for r in got.collect())
    assert rows == [("a", 0, 1.0, 2.0, 1.0, 2.0, 2.0), ("a", 3, 4.0, 5.0, 4.0, 5.0, 3.0), ("b", 0, 9.0, 9.0, 9.0, 9.0, 1.0)]
    states = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in states) >= 1
    assert states[-1]["numRowsTotal"] == 1  # the open bar of 09:00


def test_sessions_close_after_their_pause(spark, tmp_path):
    folder = f"{tmp_path}/ticks"
    ticks(spark, folder, 0, [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:20:00", 1.0), ("a", "2024-01-01 02:00:00", 1.0)])
    ticks(spark, folder, 1, [("a", "2024-01-01 08:00:00", 1.0)])
    stream = spark.readStream.schema("symbol string, ts timestamp, price double").option("maxFilesPerTrigger", 1).parquet(folder)
    got, _ = run(S.sessions(stream, symbol="symbol", ts="ts", price="price"), tmp_path, "sessions")
    assert sorted((r.start.hour, r.stop.minute, r.ticks) for r in got.collect()) == [(0, 50, 2), (2, 30, 1)]
