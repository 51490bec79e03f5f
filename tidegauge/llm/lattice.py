"""Operator 1, LM scoring: probability of a text under a unigram model over subwords, summed over all segmentations.

The pieces and their first scores are those of a public vocabulary: log probabilities as they stand, or, where a file has
ranks of merges, probabilities that fall with the rank by Zipf's law. One pass over the training texts' words re-estimates
them by how often the words' segmentations hold each piece in expectation. A word is a lattice
of pieces: the first is marked with the word boundary, others follow until the word stops. A word that training knows has
one more edge, itself as a whole, with its discounted count; what discounting frees weights the ways through pieces. A
forward recursion in log space sums over all ways. No edge crosses a boundary, so a text's lattice is a chain of its
words' lattices and one end, and the probabilities of all texts sum to one at most.

Word counts of all training texts are a table, shuffled by word. The most frequent words, a bounded number, are broadcast;
other words of a text meet the table in a join by word, where none of them is hot.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import settled
from .public_vocab import default_path

#: Words whose counts are broadcast. Words that a task holds before it hands on their counts.
FREQUENT, HELD = 100_000, 300_000
#: Added to each piece's expected count; rounds of expectation-maximisation; ranks added to a merge's in Zipf's law; a
#: single byte's first part of the pieces that follow.
SMOOTHING, ROUNDS, RANKS, BYTE = 0.1, 1, 10.0, 1e-5
BOUNDARY = "▁"


class Model(NamedTuple):
    """Natural log probabilities. first: pieces that begin a word (and b"", the boundary alone); inner: pieces that follow;
    None for a beginning of a longer piece that is no piece. single: bytes that follow; stop: that no piece follows."""

    first: dict[bytes, float | None]
    inner: dict[bytes, float | None]
    single: list[float]
    stop: float


class Trained(NamedTuple):
    """counts: word, c over the training texts; texts: their number; tokens, distinct: with the ends; discount of a word's count."""

    counts: DataFrame
    texts: int
    tokens: int
    distinct: int
    discount: float

    def end(self) -> float:
        """Log10 probability of a text's end."""
        return math.log10(self.texts / self.tokens) if self.texts else math.log10(0.5)

    def spared(self) -> float:
        """Log10 of what discounting leaves for words as ways through pieces."""
        return math.log10(self.discount * (self.distinct - 1) / self.tokens) if self.distinct > 1 else math.log10(0.5)


def vocabulary(path: str) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """Weights of the pieces of a sentencepiece file that begin a word, without their mark, and of those that don't; ASCII in lower case.

    Pieces that fall together in lower case add up. Whole-numbered scores are ranks of merges.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    score = np.array([sp.get_score(i) for i in own])
    weight = 1 / (RANKS - score) if (score == np.round(score)).all() else np.exp(score)
    first, inner = {b"": float(weight.min())}, {}
    for i, w in zip(own, weight.tolist()):
        piece = sp.id_to_piece(i)
        body = piece.removeprefix(BOUNDARY)
        if body and BOUNDARY not in body:
            of, key = (first if piece != body else inner), body.encode().lower()
            of[key] = of.get(key, 0.0) + w
    return first, inner


def _with_beginnings(scores: dict[bytes, float]) -> dict[bytes, float | None]:
    return {p[:k]: None for p in scores for k in range(1, len(p))} | scores


def model_of(first: dict[bytes, float], inner: dict[bytes, float], single: list[float], words: float) -> Model:
    """The model of expected counts of pieces and bytes in that many words."""
    start, after = sum(first.values()), sum(inner.values()) + sum(single) + words
    log = math.log
    return Model(_with_beginnings({p: log(n / start) for p, n in first.items()}), _with_beginnings({p: log(n / after) for p, n in inner.items()}), [log(n / after) for n in single], log(words / after))


def forward(word: bytes, model: Model) -> list[float]:
    """For each position in a word: log of the summed probability of all ways to it through pieces that end there.

    Pieces begin and end between characters; single bytes are always possible, so every position is reached.
    """
    n, exp, log1p = len(word), math.exp, math.log1p
    a: list = [None] * (n + 1)
    a[0] = model.first[b""]
    get = model.first.get
    for j in range(1, n + 1):
        p = get(word[:j], 0)
        if p == 0:
            break
        a[j] = p
    get, single = model.inner.get, model.single
    for i in range(n):
        now = a[i]
        v, w = now + single[word[i]], a[i + 1]
        a[i + 1] = v if w is None else w + log1p(exp(v - w)) if v < w else v + log1p(exp(w - v))
        if word[i] & 0xC0 != 0x80:
            for j in range(i + 1, n + 1):
                p = get(word[i:j], 0)
                if p is None:
                    continue
                if p == 0:
                    break
                v, w = now + p, a[j]
                a[j] = v if w is None else w + log1p(exp(v - w)) if v < w else v + log1p(exp(w - v))
    return a


def log_marginal(word: bytes, model: Model) -> float:
    """Natural log of the probability of a word over all its ways through pieces."""
    return forward(word, model)[-1] + model.stop


class Expectation:
    """How often words hold each piece in expectation under a model, added up over add()."""

    def __init__(self, model: Model):
        self.model = model
        self.names = [(0, p) for p, v in model.first.items() if v is not None] + [(1, p) for p, v in model.inner.items() if v is not None] + [(2, bytes([k])) for k in range(256)]
        place = {n: i for i, n in enumerate(self.names)}
        self.first, self.inner = ({p: None if v is None else (v, place[kind, p]) for p, v in own.items()} for kind, own in ((0, model.first), (1, model.inner)))
        self.single = [(v, place[2, bytes([k])]) for k, v in enumerate(model.single)]
        self.counts = [0.0] * len(self.names)

    def add(self, word: bytes) -> None:
        n, exp, log1p, counts = len(word), math.exp, math.log1p, self.counts
        a: list = [None] * (n + 1)
        a[0], nothing = self.first[b""]
        begins = [(0, a[0], nothing)]
        get = self.first.get
        for j in range(1, n + 1):
            if (found := get(word[:j], 0)) is not None:
                if found == 0:
                    break
                a[j] = found[0]
                begins.append((j, *found))
        get, single, edges = self.inner.get, self.single, []
        for i in range(n):
            now, (p, k) = a[i], single[word[i]]
            v, w = now + p, a[i + 1]
            a[i + 1] = v if w is None else w + log1p(exp(v - w)) if v < w else v + log1p(exp(w - v))
            edges.append((i, i + 1, p, k))
            if word[i] & 0xC0 != 0x80:
                for j in range(i + 1, n + 1):
                    found = get(word[i:j], 0)
                    if found is None:
                        continue
                    if found == 0:
                        break
                    p, k = found
                    v, w = now + p, a[j]
                    a[j] = v if w is None else w + log1p(exp(v - w)) if v < w else v + log1p(exp(w - v))
                    edges.append((i, j, p, k))
        b: list = [None] * n + [0.0]
        z = a[n]
        for i, j, p, k in reversed(edges):
            v, w = p + b[j], b[i]
            counts[k] += exp(a[i] - z + v)
            b[i] = v if w is None else w + log1p(exp(v - w)) if v < w else v + log1p(exp(w - v))
        for j, p, k in begins:
            counts[k] += exp(p + b[j] - z)

    def found(self) -> list[tuple[int, bytes, float]]:
        """(kind, piece, count) of what was held: kind 0 for first pieces, 1 for those that follow, 2 for bytes."""
        return [(*n, c) for n, c in zip(self.names, self.counts) if c]


def is_held_out(doc_id: Column) -> Column:
    """A seventh of the documents by the CRC-32 of their id; a row without id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c (how often in rows whose second column is true) of a table (text, binary; boolean); a task adds up what it holds before it hands it on."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        others: set[bytes] = set()

        def out() -> pa.RecordBatch:
            more = [w for w in others if w not in held]
            return pa.RecordBatch.from_arrays([pa.array([*held, *more], pa.binary()), pa.array([*held.values(), *[0] * len(more)], pa.int64())], names=["word", "c"])

        for b in batches:
            for t, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (held if counts else others).update((t or b"").lower().split())
                if len(held) + len(others) > HELD:
                    yield out()
                    held.clear()
                    others.clear()
        yield out()

    return texts.mapInArrow(counted, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def train(docs: DataFrame, learns: Column, text: str = "text") -> Trained:
    """Word counts of the rows of docs for which learns is true; counts has every word of docs, those of others with 0."""
    counts = settled(word_counts(docs.select(F.col(text).cast("binary"), learns.alias("learns"))), "word-counts")
    n, distinct, once, twice = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    texts = docs.where(learns).count()
    return Trained(counts, texts, n + texts, distinct + (texts > 0), (once + 0.5) / (once + 2 * twice + 1))


def fit(trained: Trained, path: str, rounds: int = ROUNDS) -> Model:
    """Scores of the vocabulary's pieces: its own, then by expectation-maximisation over the distinct training words.

    Each task sends one number a piece.
    """
    spark = trained.counts.sparkSession
    first, inner = vocabulary(path)
    total = sum(inner.values())
    model = model_of(first, inner, [BYTE * total] * 256, total)
    words = trained.counts.where("c > 0").select("word").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def counted(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Expectation(sent.value)
            for b in batches:
                for w in b.column(0).to_pylist():
                    own.add(w)
            kind, piece, n = zip(*own.found()) if own.found() else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(piece, pa.binary()), pa.array(n, pa.float64())], names=["kind", "piece", "n"])

        rows = words.mapInArrow(counted, "kind int, piece binary, n double").groupBy("kind", "piece").agg(F.sum("n").alias("n")).collect()
        n = {(r.kind, bytes(r.piece)): r.n for r in rows}
        got = lambda kind, piece: n.get((kind, piece), 0.0) + SMOOTHING
        model = model_of({p: got(0, p) for p in first}, {p: got(1, p) for p in inner}, [got(2, bytes([k])) for k in range(256)], max(1.0, trained.distinct - 1.0))
    return model


class Frequent:
    """A worker's table of frequent words: log10 of their base and model probabilities."""

    def __init__(self, words: bytes, base: bytes, score: bytes):
        own = words.split(b"\n") if base else []
        self.base, self.score = dict(zip(own, np.frombuffer(base).tolist())), dict(zip(own, np.frombuffer(score).tolist()))

    def of(self, text: bytes) -> tuple[int, int, float, float, list[bytes]]:
        """(words, those in the table, the base score and score of these, the other words)."""
        words = text.lower().split()
        got = list(map(self.base.get, words))
        rare = [w for w, v in zip(words, got) if v is None]
        score = map(self.score.get, words)
        return len(words), len(words) - len(rare), math.fsum(v for v in got if v is not None), math.fsum(v for v in score if v is not None), rare


_frequent: dict[str, Frequent] = common.held({})


def word_scores(trained: Trained, model: Model) -> DataFrame:
    """word, c, base and score of each word of trained.counts: log10 of its base and model probability."""
    spark = trained.counts.sparkSession
    sent, spared = spark.sparkContext.broadcast(model), trained.spared()

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ways = [log_marginal(w, sent.value) / math.log(10) + spared for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ways, pa.float64())], names=["word", "c", "way"])

    dealt = trained.counts.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    whole = (F.col("c") - F.lit(trained.discount)) / F.lit(float(max(trained.tokens, 1)))
    score = F.when(F.col("c") > 0, F.log10(whole + F.pow(F.lit(10.0), "way"))).otherwise(F.col("way"))
    base = F.log10((F.col("c") + 1) / F.lit(float(trained.tokens + trained.distinct + 1)))
    return dealt.mapInArrow(marginals, "word binary, c bigint, way double").select("word", "c", base.alias("base"), score.alias("score"))


def scores(docs: DataFrame, trained: Trained, model: Model, held_out: Column, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs, which train() had too.

    Tokens are a text's words and one end. n_known: tokens found in training; base_score: log10 probability by add-one
    counts; score: by the model. Null and empty texts are the end alone. Rows of equal doc_id are scored apart. Any text
    is scored whole; log space knows no underflow. Without training texts the pieces' first scores hold.
    """
    spark = docs.sparkSession
    words = settled(word_scores(trained, model), "word-scores")
    often = common.frequent(trained.counts, "c", frequent)
    top = words.where(often).collect()
    sent, key = spark.sparkContext.broadcast((b"\n".join(bytes(r.word) for r in top), np.array([r.base for r in top]).tobytes(), np.array([r.score for r in top]).tobytes())), uuid.uuid4().hex

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _frequent:
            _frequent.clear()
            _frequent[key] = Frequent(*sent.value)
        table = _frequent[key]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                n, known, base, score, rare = zip(*[table.of(t or b"") for t in part.column(3).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(rare, pa.list_(pa.binary()))], names=["row", "doc_id", "held_out", "n", "known", "base", "score", "rare"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("binary").alias("t"))
    rows = settled(rows.mapInArrow(scored, f"row bigint, doc_id {kind}, held_out boolean, n bigint, known bigint, base double, score double, rare array<binary>"), "scored")
    own = rows.select("row", F.struct("doc_id", "held_out", "n").alias("of"), "known", "base", "score")
    others = rows.select("row", F.explode("rare").alias("word")).join(words.where(~often), "word")
    others = others.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    both = own.unionByName(others, allowMissingColumns=True).groupBy("row").agg(F.first("of", ignorenulls=True).alias("of"), *[F.sum(x).alias(x) for x in ("known", "base", "score")])
    end = math.log10((trained.texts + 1) / (trained.tokens + trained.distinct + 1))
    return both.select("of.doc_id", "of.held_out", (F.col("of.n") + 1).alias("n_tokens"), (F.col("known") + int(trained.texts > 0)).alias("n_known"), F.lit(trained.tokens).cast("long").alias("train_tokens"), (F.col("base") + end).alias("base_score"), (F.col("score") + trained.end()).alias("score"))


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, path: str | None = None) -> DataFrame:
    """scores() of all rows of docs by a model learned from those that is_held_out() leaves; see there for odd rows."""
    held_out = is_held_out(F.col(doc_id))
    trained = train(docs, ~held_out, text)
    return scores(docs, trained, fit(trained, path or default_path("piece_bpe_32k.model")), held_out, doc_id, text)
