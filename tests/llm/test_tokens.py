"""Token counts and files against the library on whole texts."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm import public_vocab as V
from tidegauge.llm import token_counts as C
from tidegauge.llm import token_files as T

PATH = V.default_path("word_bpe_49k.json")
PIECES = ["the", "The.", "É", "é,", "İ", "ß", "<|endoftext|>", "a<|startoftext|>b", "́x", "don't", "x's", "'S", "1st", "日本", "\xa0", "\x85", "Σ", "...", ",", "a.,", "ŉ", "\x1c", "ﬁ", "👍", "a̸=", "a×b", " ", "\n"]


def library(text: str) -> list[int]:
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


WHOLE = Tokenizer.from_file(PATH)


@settings(deadline=None, max_examples=400)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=10).map("".join))
def test_words_give_the_librarys_ids(text):
    ids = V.word_ids(PATH)
    words = ids.words(text.encode("utf-8", "replace"))
    ids.fill(set(words))
    assert np.frombuffer(b"".join(map(ids.__getitem__, words)), ids.dtype).tolist() == WHOLE.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(V, "CACHE_WORDS", 50)
    ids = V.WordIds(PATH)
    for k in range(10):
        words = {b"w%d" % i for i in range(20 * k, 20 * k + 30)}
        ids.fill(words)
        assert words <= ids.keys() and len(ids) + len(ids.old) <= 130


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_stream_round_trip(values):
    control, data = T.encode_stream(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert T.decode_stream(control, data, len(values)).tolist() == values


ROWS = [(5, "five five"), (1, "The cat, sat."), (3, None), (2, ""), (9, "long " * 30_000), (None, "no id"), (7, "same"), (7, "same"), (4, "<|endoftext|> é")]


def test_counts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"n_tokens": F.lit("clash"), "lang": F.lit("en")})
    got = C.token_counts(docs)
    assert {"lang", "n_bytes", "over_limit"} <= set(got.columns)
    want = sorted((str(i), len((t or "").encode()), len(library(t or "")), len(library(t or "")) > 2048) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert C.token_counts(docs, table_words=1).agg(F.sum("n_tokens")).first()[0] == sum(w[2] for w in want)
    assert C.token_counts(docs.limit(0)).count() == 0


def test_lists_are_added_up_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(C, "FAN_IN", 2)
    docs = spark.range(4000).select(F.concat_ws(" ", F.lit("the the"), F.concat(F.lit("w"), F.col("id") % 50), F.concat(F.lit("rare"), "id")).alias("text")).repartition(9)
    got = C.frequent_words(docs, "text", PATH, 60)
    assert len(got) <= 60 and {b"the", *(b"w%d" % k for k in range(50))} <= set(got)
    assert C.frequent_words(docs.limit(0), "text", PATH) == []


def test_equal_ids_are_dealt_to_several_tasks(spark):
    docs = spark.range(3000).select(F.lit(5).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    files = T.write_tokens(docs, shards=4, file_ids=100_000)
    assert spark.read.parquet(files.files).select(F.split_part("name", F.lit("-"), F.lit(1))).distinct().count() > 1
    got = sorted((r.start, r.n_tokens) for r in T.read_tokens(spark, files).select("start", "n_tokens").collect())
    assert len(got) == 3000 and all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:]))


def test_files_round_trip(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    files = T.write_tokens(docs, shards=3, file_ids=1000)
    got = T.read_tokens(spark, files).orderBy("start").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    assert [r.doc_id for r in got] == [r[0] for r in order]
    for r, (_, t) in zip(got, order):
        ids = library(t or "") + [1]
        assert (r.start, r.n_tokens) == (start, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    index = {r.doc_id: r.ids_crc32 for r in T.token_index(T.read_tokens(spark, files)).collect()}
    assert index[1] == zlib.crc32(np.array(library("The cat, sat.") + [1], "<u4").tobytes())


def test_no_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.read_tokens(spark, T.write_tokens(empty)).collect() == []


def test_damaged_file():
    file = T.pack(np.array([1], "<i8").tobytes(), np.array([2], "<u4").tobytes(), np.array([5, 700], np.uint32))
    assert T.unpack(file)[2].tolist() == [5, 700]
    with pytest.raises(ValueError):
        T.unpack(file + b"x")
    with pytest.raises(ValueError):
        T.unpack(b"y" + file[1:])
