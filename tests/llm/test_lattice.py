"""LM scoring against sums over all segmentations and plain counts."""

import math
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.llm import lattice as L

FIRST = {b"": 1.0, b"th": 3.0, b"the": 5.0, b"a": 2.0, "é".encode(): 1.0}
INNER = {b"e": 2.0, b"he": 1.0, b"th": 1.0, b"a": 1.0, b"ab": 4.0, "é".encode(): 1.0}
MODEL = L.model_of(FIRST, INNER, [0.05] * 256, 6.0)


def brute(w: bytes) -> float:
    def rest(i):
        if i == len(w):
            return math.exp(MODEL.stop)
        total = math.exp(MODEL.single[w[i]]) * rest(i + 1)
        if w[i] & 0xC0 != 0x80:
            total += sum(math.exp(MODEL.inner[p]) * rest(i + len(p)) for p in INNER if w.startswith(p, i))
        return total

    return math.exp(MODEL.first[b""]) * rest(0) + sum(math.exp(MODEL.first[p]) * rest(len(p)) for p in FIRST if p and w.startswith(p))


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet="theaébx", min_size=1, max_size=9))
def test_marginal_sums_over_all_segmentations(word):
    assert L.log_marginal(word.encode(), MODEL) == pytest.approx(math.log(brute(word.encode())))


@settings(deadline=None, max_examples=100)
@given(st.text(alphabet="theaéb", min_size=1, max_size=9))
def test_expected_pieces_cover_the_word(word):
    own = L.Expectation(MODEL)
    own.add(word.encode())
    assert sum(n * (1 if kind == 2 else len(piece)) for kind, piece, n in own.found()) == pytest.approx(len(word.encode()))
    assert sum(n for kind, _, n in own.found() if kind == 0) == pytest.approx(1)


def test_words_of_all_lengths_sum_to_one_at_most():
    words = [bytes([a]) for a in b"theab"] + [bytes([a, b]) for a in b"theab" for b in b"theab"]
    assert sum(math.exp(L.log_marginal(w, MODEL)) for w in words) < 1


ROWS = [(1, "the the cat"), (2, "The CAT sat"), (3, None), (4, ""), (5, " \t\n"), (6, "unseenword the"), (7, "x" * 3000), (8, "the " * 5000), (9, "the the cat"), (9, "the the cat"), (None, "the dog")] + [(i, "a cat and the dog é ▁ 日本") for i in range(10, 40)]


def test_counts_and_base_by_hand(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = L.lm_scores(docs.repartition(3)).collect()
    assert len(got) == len(ROWS)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    low = lambda t: (t or "").encode().lower().split()
    counts, texts = Counter(), 0
    for i, t in ROWS:
        if not held(i):
            counts.update(low(t))
            texts += 1
    n, v = sum(counts.values()) + texts, len(counts) + 1
    want = sorted(((i is None, i or 0), held(i), len(low(t)) + 1, sum(w in counts for w in low(t)) + 1, n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in low(t)) + math.log10((texts + 1) / (n + v + 1)), 5)) for i, t in ROWS)
    have = sorted(((r.doc_id is None, r.doc_id or 0), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got)
    assert have == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[3].score == by[4].score == by[5].score
    assert by[1].score > by[6].score


def plain_probability(word, model):
    """The sum over all segmentations, of probabilities, not their logs."""
    from functools import cache

    alive = lambda d: {p: math.exp(v) for p, v in d.items() if v is not None}
    first, inner, single, stop = alive(model.first), alive(model.inner), [math.exp(v) for v in model.single], math.exp(model.stop)

    @cache
    def rest(i):
        if i == len(word):
            return stop
        total = single[word[i]] * rest(i + 1)
        if word[i] & 0xC0 != 0x80:
            total += sum(inner.get(word[i:j], 0.0) * rest(j) for j in range(i + 1, len(word) + 1))
        return total

    return sum(first.get(word[:j], 0.0) * rest(j) for j in range(len(word) + 1))


def test_scores_of_whole_texts_by_plain_sums(spark):
    """score is the sum over words of log10((c - discount) / N + spared * P(word)), and the end's, on a small corpus of short words."""
    rows = [(i, t) for i, t in ROWS if t is None or len(t) < 100]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = L.is_held_out(F.col("doc_id"))
    trained = L.train(docs, ~held)
    model = L.fit(trained, L.default_path("piece_bpe_32k.model"))
    got = sorted((str(r.doc_id), round(r.score, 7)) for r in L.scores(docs, trained, model, held).collect())
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts, texts = Counter(), 0
    for i, t in rows:
        if not out(i):
            counts.update((t or "").encode().lower().split())
            texts += 1
    n, kinds = sum(counts.values()) + texts, len(counts) + 1
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = (once + 0.5) / (once + 2 * twice + 1)
    assert trained.discount == pytest.approx(discount)

    def word(w):
        ways = plain_probability(w, model) * discount * (kinds - 1) / n
        return math.log10(max(0.0, counts[w] - discount) / n + ways) if counts[w] else math.log10(ways)

    want = sorted((str(i), round(sum(map(word, (t or "").encode().lower().split())) + math.log10(texts / n), 7)) for i, t in rows)
    assert [a for a, _ in got] == [a for a, _ in want] and [b for _, b in got] == pytest.approx([b for _, b in want], abs=2e-6)


def test_first_scores_fall_with_the_rank():
    first, inner = L.vocabulary(L.default_path("piece_bpe_32k.model"))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=L.default_path("piece_bpe_32k.model"))
    own = [(sp.get_score(i), sp.id_to_piece(i)) for i in (300, 5000, 20_000)]
    weights = [(inner if not p.startswith(L.BOUNDARY) else first)[p.removeprefix(L.BOUNDARY).encode().lower()] for _, p in own]
    assert all(v > 0 for v in (*first.values(), *inner.values())) and weights[0] > weights[2]


def test_frequent_words_change_no_score(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    held = L.is_held_out(F.col("doc_id"))
    trained = L.train(docs, ~held)
    model = L.fit(trained, L.default_path("piece_bpe_32k.model"), 1)
    a, b = (sorted((str(r.doc_id), r.n_known, round(r.score, 6), round(r.base_score, 6)) for r in L.scores(docs, trained, model, held, frequent=k).collect()) for k in (1, 1000))
    assert a == b


def test_empty_table(spark):
    assert L.lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
