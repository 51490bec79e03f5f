"""The network's gradient against differences, its windows, what it says of held-out texts, and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import language as L
from tidegauge.llm import queries


def test_gradient_equals_differences():
    k, hidden = 3, 4
    flat = L.first_weights(k, hidden).astype(np.float64)
    data, start, length, text = L.windows([b"hello world this", b"guten tag", b"", b"a"], 8)
    x, live = L.laid_out(data, start, length)
    y = np.array([0, 1, 2, 2])[text]
    _, g = L.loss_gradient(flat, k, x, live, y, hidden)
    for i in [*np.random.default_rng(1).choice(len(flat), 300, replace=False), *range(len(flat) - 30, len(flat))]:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert (L.loss_gradient(up, k, x, live, y, hidden)[0] - L.loss_gradient(down, k, x, live, y, hidden)[0]) / 2e-6 == pytest.approx(g[i], abs=1e-7)


def test_probabilities_by_position():
    """All windows at once give what each gives alone, byte by byte."""
    model = L.Model(["a", "b", "c"], L.first_weights(3, seed=5))
    w, texts = L.unpacked(model.weights, 3), [bytes(range(256)) * 2 + b"xyz", b"", b"q", b"text " * 60]

    def alone(window):
        states = {}
        for d, order in (("f", window), ("b", window[::-1])):
            h, states[d] = np.zeros(L.HIDDEN), []
            for b in order:
                z, r = (np.clip(w[f"E{g}{d}"][b] + h @ w[f"U{g}{d}"], 0, 1) for g in "zr")
                h = h + z * (np.tanh(w[f"Ec{d}"][b] + r * (h @ w[f"Uc{d}"])) - h)
                states[d].append(h)
        e = np.exp(np.array(states["f"]) @ w["Of"] + np.array(states["b"])[::-1] @ w["Ob"] + w["bias"])
        return e / e.sum(1, keepdims=True)

    got, labels = L.pooled(model, texts, True)
    want = [np.concatenate([alone(t[a : a + L.WINDOW]) for a in range(0, len(t), L.WINDOW)]) if t else np.zeros((0, 3)) for t in texts]
    assert np.allclose(got, [p.mean(0) if len(p) else np.zeros(3) for p in want], atol=1e-5)
    assert (labels == np.concatenate([p.argmax(1) for p in want])).mean() > 0.999


def test_held_out_texts(spark, sf):
    got = queries.QUERIES["op11_language_id"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    both = got.merge(docs, on="doc_id")
    both = both[both.held_out & both.lang.notna() & (both.lang_pred != "und")]
    assert len(both) > 30 and (both.lang_pred == both.lang).mean() > 0.9
    lettered = {i for i, t in zip(docs.doc_id, docs.text) if t is not None and any(c.isalpha() for c in t)}
    assert set(got[got.lang_pred != "und"].doc_id) == lettered


def test_odd_rows_and_spans(spark):
    en, de = "the cat and the dog that were with this thing ", "der hund und die katze sind nicht ein ding "
    rows = [(i, en * (i % 3 + 1), "en", "x") for i in range(60)] + [(i, de * (i % 3 + 1), "de", "x") for i in range(60, 120)] * 2
    rows += [(None, en, None, None), (200, None, "en", "x"), (201, "", "de", "x"), (202, "12 34 !?", None, "x"), (203, en * 3000, None, "x"), (204, "é", None, "x"), (205, de * 4 + en * 4, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").withColumns({"got": F.lit(1), "h": F.lit(2), "nth": F.lit(0)})
    model = L.fitted(df, rounds=4)
    assert model.languages == ["de", "en"]
    out = L.predicted(df, model, spans=True)
    assert set(out.columns) == {*df.columns, "lang_pred", "spans"}
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].lang_pred for i in (None, 0, 60, 203)] == ["en", "en", "de", "en"]
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].spans == [] for i in (200, 201, 202))
    spans = got[205].spans
    assert spans[0].start == 0 and spans[-1].stop == len(de * 4 + en * 4) and all(a.stop == b.start for a, b in zip(spans, spans[1:]))
    assert spans[0].lang == "de" and spans[-1].lang == "en"
    assert L.fitted(df.limit(0)) is None and {r.lang_pred for r in L.predicted(df, None, spans=True).collect()} == {"und"}
    assert L.document_languages(df.limit(0)).count() == 0


def test_sample_is_bounded_and_covers_each_language(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 1000 == 0, "rare").when(F.col("id") > 5, "hot").alias("lang"))
    got = L.sample(df, "text", "lang", texts=50).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"rare": 3, "hot": 50}
