"""Decontamination against sliding the whole benchmark over each text."""

import random
import re

from pyspark.sql import functions as F

from tidegauge.llm import decontaminate as D

random.seed(5)
WORDS = [f"w{i}" for i in range(300)]


def passage(n):
    return [random.choice(WORDS) for _ in range(n)]


ITEMS = [(i, passage(random.randint(13, 40))) for i in range(12)] + [(90, ["tiny", "item", "of", "four"]), (91, [])]
ITEMS.append((50, ITEMS[0][1]))


def changed(words, every):
    return [w if (k + 1) % every else "zz" for k, w in enumerate(words)]


def rows():
    out = []
    for k in range(60):
        body = passage(random.randint(0, 60))
        if k % 3 == 0:
            body += ITEMS[k % 12][1]
        if k % 3 == 1:
            body += changed(ITEMS[k % 12][1], 7)
        out.append((k, ". ".join(x.capitalize() for x in body + passage(5))))
    return out + [(100, None), (101, ""), (102, "tiny item of four"), (103, " ".join(ITEMS[1][1][:12])), (104, " ".join(passage(20_000) + ITEMS[2][1]))]


def plain(text, item):
    w = [x for x in re.split(r"[^\w]+", (text or "").lower()) if x]
    m = min(13, len(item))
    best = 0
    for i in range(len(w) - m + 1):
        for j in range(len(item) - m + 1):
            best = max(best, sum(a == b for a, b in zip(w[i : i + m], item[j : j + m])))
    return best


def test_against_sliding(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").withColumns({"key": F.lit(1), "w": F.lit("clash"), "item_id": F.lit(2)})
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in ITEMS] + [(None, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in D.contaminated(docs, bench).collect()}
    items = [(i, w) for i, w in ITEMS if i != 50 and w]
    want = {(d, i): best for d, t in rows() for i, w in items if len(t or "") < 5000 and (best := plain(t, w)) >= 0.8 * min(13, len(w))}
    assert {k: v for k, v in got.items() if k[0] != 104} == want
    assert (104, 2) in got
    left = sorted(r.doc_id for r in D.without(docs, D.contaminated(docs, bench)).collect())
    assert left == sorted({d for d, _ in rows()} - {d for d, _ in got})


def test_shuffled_seeds_and_empty_tables(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in ITEMS], "item_id long, text string")
    want = sorted(D.contaminated(docs, bench).collect())
    assert sorted(D.contaminated(docs, bench, broadcast_seeds=0).collect()) == want
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert D.contaminated(docs, bench.limit(0)).count() == 0


def test_clean_judges_row_by_row(spark):
    item = " ".join(ITEMS[0][1])
    rows_ = [(1, "quite other words than those"), (1, f"before {item} after"), (None, item), (None, None), (2, ""), (2, "")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string").withColumns({"gone": F.lit(1), "text_hash": F.lit(2)})
    bench = spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string")
    left = D.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (1, rows_[0][1]), (2, ""), (2, "")]
    assert D.clean(docs, bench.limit(0)).count() == 6 and D.clean(docs.limit(0), bench).count() == 0


def test_tolerates_substitutions_at_ignored_places():
    for m in D.MASKS:
        assert m[0] == m[-1] == "1" and "0" in m


def test_masks_leave_a_seed_for_every_allowed_substitution():
    from itertools import combinations
    from math import ceil

    for n in range(1, D.WINDOW + 1):
        masks = D.masks_of(n)
        for gone in combinations(range(n), n - ceil(0.8 * n)):
            assert any(all(at + k not in gone for k, bit in enumerate(m) if bit == "1") for m in masks for at in range(n - len(m) + 1)), (n, gone)
    assert D.masks_of(40, 0.5)[-1] == "1"


def test_short_items_against_sliding(spark):
    random.seed(7)
    items = [(1, ["rare"])] + [(n, passage(n)) for n in range(2, 14)]
    texts = [[], ["w1"], ["rare"]]
    for n, w in items:
        for gone in range(min(n, 3)):
            for _ in range(6):
                out = random.sample(range(n), gone)
                texts.append(passage(random.randint(0, 9)) + ["zz" if k in out else x for k, x in enumerate(w)] + passage(3))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in D.contaminated(docs, bench).collect()}
    want = {(d, i): best for d, t in enumerate(texts) for i, w in items if (best := plain(" ".join(t), w)) >= 0.8 * len(w)}
    assert got == want


def test_shortest_item_is_a_parameter(spark):
    docs = spark.createDataFrame([(1, "The cat sat down."), (2, "the cat sat up"), (3, "cat"), (4, "the CAT sat down and slept")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the cat sat down"), (2, "cat")], "item_id long, text string")
    found = lambda n: sorted((r.doc_id, r.item_id) for r in D.contaminated(docs, bench, shortest=n).collect())
    assert found(1) == [(1, 1), (1, 2), (2, 2), (3, 2), (4, 1), (4, 2)]
    assert found(2) == [(1, 1), (4, 1)] and found(5) == []
    assert D.clean(docs, bench).count() == 4
    assert sorted(r.doc_id for r in D.clean(docs, bench, shortest=4).collect()) == [2, 3]


def test_common_phrase_long_text_and_nameless_rows(spark, monkeypatch):
    """An item that most texts hold, a text of several stretches, copies and rows without id, by each way of joining."""
    phrase, tail = passage(8), passage(20)
    rows_ = [(k, " ".join(["a", *phrase, "b"])) for k in range(80)] + [(200, " ".join((phrase + ["x"]) * 700 + tail))] * 3 + [(None, " ".join(tail)), (None, " ".join(phrase)), (300, "none of it")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(phrase)), (2, " ".join(tail))], "item_id long, text string")
    want = {(d, i): best for d, t in dict.fromkeys(rows_) for i, w in ((1, phrase), (2, tail)) if (best := plain(t, w)) >= 0.8 * min(13, len(w))}
    monkeypatch.setattr(D, "STRETCH", 512)
    got = lambda **more: {(r.doc_id, r.item_id): (r.matched, r.doc_start) for r in D.contaminated(docs, bench, **more).collect()}
    first = got()
    assert {k: v[0] for k, v in first.items()} == want and first[200, 1][1] == 0 and first[200, 2][1] == 6300
    assert got(broadcast_words=0, broadcast_seeds=0) == first
    monkeypatch.setattr(D, "FEW", 0)
    assert got() == first
