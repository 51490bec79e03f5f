"""WARC records written and read back."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import warc as W

BIG = "é" * 600


def test_round_trip(spark):
    rows = [(1, "http://a", BIG), (2, None, BIG), (3, "http://c", BIG + "x"), (4, "http://d", "small"), (5, "http://e", "small"), (6, "http://f", None), (7, "http://g", ""), (8, "http://h", "y" * 300_000), (8, "http://h", "y" * 300_000), (9, "\r\nbad", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "first": F.lit(1), "payload": F.lit(0)})
    got = W.read_warc(spark, W.write_warc(pages.repartition(3), file_bytes=1500))
    have = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect())
    largest = {}
    for i, _, t in rows:
        if len((t or "").encode()) >= 1000:
            largest[t] = max(largest.get(t, i), i)
    want = sorted((i, len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest(), *(("response", None) if largest.get(t, i) == i else ("revisit", largest[t]))) for i, _, t in rows)
    assert have == want
    assert {bytes(r.payload).decode() for r in got.where("record_type = 'response'").collect()} == {t or "" for _, _, t in rows}
    assert W.read_warc(spark, W.write_warc(pages.limit(0))).count() == 0


def test_hot_payload_is_dealt_out(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit(BIG)).otherwise(F.concat(F.lit(BIG), (F.col("id") % 1500).cast("string"))).alias("html"))
    got = W.read_warc(spark, W.write_warc(pages))
    assert got.where("record_type = 'revisit' AND refers_to = 2997").count() == 999
    assert got.where("record_type = 'response'").count() == 1001


def test_members_and_framing():
    a, b = W.record(1, "u", b"hello"), W.record(2, None, b"w" * 200_000)
    assert [r.payload for r in W.records(io.BytesIO(a + b))] == [b"hello", b"w" * 200_000]
    assert gzip.decompress(a).startswith(b"WARC/1.1\r\nWARC-Type: response")
    with pytest.raises(ValueError):
        list(W.records(io.BytesIO((a + b)[:-20])))


def test_wrong_digest_and_length():
    raw = gzip.decompress(W.record(1, "u", b"hello"))
    for bad in (raw.replace(b"hello", b"hallo"), raw.replace(b"hello", b"hello!")):
        with pytest.raises(ValueError):
            list(W.records(io.BytesIO(gzip.compress(bad))))


def test_broken_off_revisit_keeps_length():
    (r,) = W.records(io.BytesIO(W.record(5, "u", b"z" * 1234, 9, True)))
    assert r.headers["WARC-Type"] == "revisit" and b"Content-Length: 1234" in r.http and r.payload == b""
