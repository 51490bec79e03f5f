"""The pipeline's stages against plain versions, and the queries' contracts."""

import hashlib
import re

import numpy as np
import regex
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_near_dup import plain_similar
from tidegauge.llm import common, queries, repetition


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = common.settled(stage(spark, kept, sf), "test-stage")
        assert kept.columns == docs.columns, name
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert after < before
        rows = [r for r in docs.collect() if r.doc_id in before]
        if stage is P.clean:
            hit = plain_contaminated([r.text for r in rows], [r.text for r in common.table(spark, sf, "benchmark").collect()])
            assert after == {r.doc_id for i, r in enumerate(rows) if i not in hit}
        if stage is P.mix:
            assert after == plain_mixed(rows)
        if stage is P.quality:
            for i in before:
                n, *_, n_repeat, covered, longest, _ = repetition.measure([texts[i].encode()])[0].tolist()
                assert (i in after) == (n >= 50 and 2 * n_repeat <= n and covered <= 0.4 * n and longest <= 60)
        if stage is P.dedup:
            ids = sorted(before)
            comp = plain_similar([texts[i] for i in ids])
            first = {ids[c] for c in comp}
            assert after >= first and len(after) - len(first) <= 0.1 * (len(before) - len(first))
    out = P.tokens(spark, kept, sf)
    assert {r.doc_id for r in out.collect()} == after


def plain_words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def plain_contaminated(texts, items):
    """Which texts hold, at some place, 0.8 of a window of 13 words of an item (of all its words, if it has fewer; under 5: none), in place."""
    numbers = {}
    number = lambda w: numbers.setdefault(w, len(numbers) + 1)
    docs = [[number(w) for w in plain_words(t)] for t in texts]
    flat = np.array([x for d in docs for x in [*d, *[0] * 13]])
    of = np.array([i for i, d in enumerate(docs) for _ in range(len(d) + 13)])
    out = set()
    for item in items:
        v = [number(w) for w in plain_words(item)]
        width = min(13, len(v))
        for j in range(len(v) - width + 1 if width >= 5 else 0):
            same = sum((flat[k : len(flat) - 13 + k] == v[j + k]).astype(int) for k in range(width))
            whole = of[: len(same)] == of[width - 1 : len(same) + width - 1]
            whole &= flat[width - 1 : len(same) + width - 1] > 0
            out |= set(of[: len(same)][(same >= 0.8 * width) & whole].tolist())
    return out


def plain_mixed(rows):
    """doc_ids that are sampled, by raking in plain Python."""
    def told(r):
        t = r.text or ""
        topic = "license" if "icense" in t else "contact" if "@" in t or "+1 (" in t else "table" if "|" in t else "prose"
        return r.source or "(none)", r.lang or "(none)", topic, len(re.findall("[^ \t-\r]+", t))

    cells = {}
    for r in rows:
        *cell, n = told(r)
        cells[tuple(cell)] = cells.get(tuple(cell), 0) + n
    weight, total = dict.fromkeys(cells, 1.0), sum(cells.values())
    aims = []
    for k in range(3):
        own = {}
        for c, n in cells.items():
            own[c[k]] = own.get(c[k], 0) + n
        power = {v: (x / total) ** 0.9 if x else 0.0 for v, x in own.items()}
        aims.append({v: x / sum(power.values()) * total for v, x in power.items()})
    for _ in range(8):
        for k in range(3):
            now = {}
            for c, n in cells.items():
                now[c[k]] = now.get(c[k], 0) + n * weight[c]
            weight = {c: w * aims[k][c[k]] / now[c[k]] if now[c[k]] else w for c, w in weight.items()}
    most = max(weight.values())
    draw = lambda i: int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) / 16**13
    return {r.doc_id for r in rows if draw(r.doc_id) < weight[told(r)[:3]] / most}


def odd(spark, columns):
    """Rows with nulls anywhere, repeated rows and ids, and columns named like working ones."""
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long, "en", "a", 5), (1, long, "en", "a", 5), (1, long + " more", None, None, None), (None, long.upper(), "en", None, 1), (None, None, None, None, None), (2, "", "en", "a", 0), (3, " ".join(f"v{i}" for i in range(90)), "de", "b", 9), (4, "z " * 30_000, "de", "b", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("mine") for c in columns})


WORKING = ("m", "_m", "measured", "doc", "digest", "_d", "_id", "gone", "text_hash", "cell", "_cell", "_k", "_hk", "weight", "topic_of", "source_of", "row", "key", "n", "comp")


def test_odd_rows_in_every_stage(spark, sf):
    docs = odd(spark, WORKING)
    shown = lambda df: sorted((r.doc_id or 0, (r.text or "")[:4], r.gone) for r in df.collect())
    kept = P.quality(spark, docs, sf)
    assert kept.columns == docs.columns and shown(kept) == [(0, "W0 W", "mine"), (1, "w0 w", "mine"), (1, "w0 w", "mine"), (1, "w0 w", "mine"), (3, "v0 v", "mine")]
    one = P.dedup(spark, docs, sf)
    assert one.columns == docs.columns and shown(one) == [(1, "w0 w", "mine"), (2, "", "mine"), (3, "v0 v", "mine"), (4, "z z ", "mine")]
    left = P.clean(spark, docs, sf)
    assert left.columns == docs.columns and left.count() == docs.count()
    sample = P.mix(spark, docs, sf)
    assert sample.columns == docs.columns and sample.count() <= docs.count()
    out = P.tokens(spark, docs, sf).collect()
    assert len(out) == docs.count() and sorted(r.n_tokens for r in out)[:2] == [1, 1]
    empty = docs.limit(0)
    assert all(f(spark, empty, sf).count() == 0 for _, f in P.STAGES)


def test_run_equals_its_stages(spark, sf):
    got = P.run(spark, sf).collect()
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    assert all(a[0] + a[1] == b[0] and a[2] < b[2] for a, b in zip(starts, starts[1:]))


def test_queries_and_their_columns():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_lookup_ways_agree(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 900).cast("string")).alias("k"))
    table = rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("v"))
    got = common.lookup(rows, table, "k", "n", F.monotonically_increasing_id(), 5000)
    want = rows.join(table.drop("n"), "k", "left").select("id", "k", "v")
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)
