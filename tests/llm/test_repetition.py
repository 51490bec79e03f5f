"""Quality rules against comparing all pairs of positions."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.llm import repetition as R


def brute(text: bytes, least: int):
    w = text.split()
    n = len(w)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    cover = lambda size: len({k for i in range(n) for k in range(i, i + size(best[i]))})
    return [n, cover(lambda b: 3 if b >= 3 else 0), cover(lambda b: b if b >= least else 0), max(best, default=0)]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30).map(b" ".join), max_size=6))
def test_spans_equal_all_pairs(texts):
    got = R.measure(texts, 4) if texts else np.zeros((0, 8))
    assert [[r[0], r[4], r[5], r[6]] for r in got.tolist()] == [brute(t, 4) for t in texts]


def test_lines_symbols_and_characters():
    (got,) = R.measure(["é a\n\né a\n # b|\n \né a".encode()]).tolist()
    assert got[:4] == [8, 9, 2, 2]


def test_rules_and_odd_rows(spark):
    clean = " ".join(f"w{i}" for i in range(80))
    looped = " ".join([" ".join(f"w{i}" for i in range(65))] * 2 + [f"x{i}" for i in range(900)])
    rows = [(1, clean), (2, looped), (3, None), (4, ""), (5, "short text"), (6, "a " * 200_000), (7, clean), (7, clean)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"kept": F.lit("clash"), "_m": F.lit(0)}).drop("_m")
    got = R.quality_rules(docs).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [True, False, False, False, False, False, True, True]
    assert [r.base_failed for r in got] == [False, False, True, True, True, True, False, False]
    assert got[1].longest_repeat == 65 and got[5].n_words == 200_000
    assert R.quality_rules(docs.limit(0)).count() == 0
