"""Resampling against a plain version over whole features, with tries begun anew, and odd rows."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import queries
from tidegauge.llm import resampling as R


def features(text, n):
    said = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return said, [" ".join(said[i : i + k]) for k in range(1, n + 1) for i in range(len(said) - k + 1)]


def plain(docs, target, n=1, buckets=10_000, percent=10, least=20):
    of = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for text in texts for f in features(text, n)[1]) for texts in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out, able = {}, []
    for i, text in docs:
        said, own = features(text, n)
        weight = sum(gain(of(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(own), weight, score, None]
        if len(said) >= least:
            able.append((-score, i))
    for rank, (_, i) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[i][3] = rank
    return {i: tuple(v) for i, v in out.items()}


def test_equals_plain_version(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_resampling"](spark, sf).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got == plain(docs, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])


@pytest.mark.parametrize("nodes", [R.NODES, 5])
def test_longer_runs_and_small_tries(spark, monkeypatch, nodes):
    monkeypatch.setattr(R, "NODES", nodes)
    docs = [(i, " ".join(f"W{(i * j) % 23}" for j in range(i % 60))) for i in range(200)] + [(500, "é Ünder x-y_z 3.14 " * 40), (501, None), (502, ""), (503, "...")]
    target = ["w1 w2 w3 w4 w5 x y z", None, "3 14 é"]
    # One process counts and walks, so that the limit holds for its tries.
    trie, totals = R.Trie(3), R.np.zeros(97, R.np.int64)
    for _, text in docs:
        trie.count(R.words(text.encode() if text else None), totals)
    trie.into(totals)
    want = Counter(crc32(f.encode()) % 97 for _, text in docs for f in features(text, 3)[1])
    assert {i: int(v) for i, v in enumerate(totals) if v} == dict(want)
    walk = R.Trie(2, list(range(97)))
    for _, text in docs:
        own = features(text, 2)[1]
        assert walk.gain(R.words(text.encode() if text else None)) == (len(own), sum(crc32(f.encode()) % 97 for f in own))
    of = lambda rows, c: spark.createDataFrame(rows, f"{c} text string")
    rows = R.drawn(R.scored(of(docs, "doc_id long,"), of([(t,) for t in target], ""), n=3, buckets=97), percent=30, least=5)
    assert {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in rows.collect()} == plain(docs, target, 3, 97, 30, 5)


def test_odd_rows(spark):
    text = "some words of a text that is drawn or not " * 3
    docs = spark.createDataFrame([(1, text)] * 300 + [(None, text)] * 200 + [(i, text) for i in range(2, 102)] + [(900, None), (901, "Ab " * 50_000)], "doc_id long, text string")
    docs = docs.withColumns({"rank": F.lit("clash"), "sc": F.lit(1), "c": F.lit(2), "bucket": F.lit(3)})
    target = spark.createDataFrame([("a text",)], "text string")
    got = R.drawn(R.scored(docs, target)).toPandas()
    assert len(got) == 602 and got[got.doc_id.isna()].score.isna().all() and got[got.doc_id.isna()]["rank"].isna().all()
    assert sorted(got["rank"].dropna()) == list(range(1, 40 + 1))  # 10 % of 401 rows
    assert R.drawn(R.scored(docs.limit(0), target)).count() == 0
    assert R.drawn(R.scored(docs, target.limit(0))).count() == 602
    assert R.drawn(R.scored(docs, target), least=10**9).where("rank IS NOT NULL").count() == 0
