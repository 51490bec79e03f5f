"""Operator 13, importance resampling: documents drawn by how much likelier a target's word runs are than the corpus's.

Features are all runs of 1 to n consecutive words, joined by a space, counted in as many buckets as are asked for, by CRC-32.
A partition puts its words into a trie: a node is a run, holds how often it was met and the CRC of its bytes, which a child
carries on from its parent's, so that no run is ever written out. Tries stay where they are: a partition hands on its
buckets' totals, which Spark adds up; the driver holds a number a bucket. Documents are then scored by walking their
words' paths through a trie whose nodes carry their bucket's gain from the first visit on. A trie of over NODES nodes is
added to the totals, or given up, and begun anew: memory is bounded, results don't change.

The rank of a drawn document is the number of candidates of greater score, from a table with a row a score (scores are
thousandths of logarithms, some ten thousand of them), and its place among those of the same score by doc_id: no sort passes
through one task.

Null and empty texts have no word: they have weight 0, count for nothing and are no candidates unless least is 0. A row
without doc_id has no score and is never drawn. Rows are rows: one that repeats counts and can be drawn as often as it is
there; equal doc_ids tie in any order where texts are equal too. An empty corpus gives an empty table, an empty target gains
that only tell rare from frequent. Columns of any other name are kept; results replace columns of their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import attrgetter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, settled, unused

BUCKETS, RUN, SEED, LEAST, PERCENT = 10_000, 1, 2024, 20, 10
#: Nodes of a trie before it is begun anew, and words that are put into it at once.
NODES, AT_ONCE = 200_000, 50_000
#: Bytes of words: digits, a-z and all beyond ASCII, capitals made small; any other is a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return re.findall(rb"[^ ]+", text.translate(LETTERS)) if text else []


class Node(dict):
    """A run of words: its children by the next word, the CRC of its bytes (None at the root), how often it was met, its gain."""

    __slots__ = ("crc", "gain", "met", "trie")

    def __init__(self, trie: Trie, crc: int | None):
        self.trie, self.crc, self.met = trie, crc, 0
        self.gain = trie.gains[crc % len(trie.gains)] if crc is not None and trie.gains else 0
        trie.nodes.append(self)

    def __missing__(self, word: bytes) -> Node:
        child = self[word] = Node(self.trie, crc32(word) if self.crc is None else crc32(word, crc32(b" ", self.crc)))
        return child


class Trie:
    """Runs of 1 to n words, with the gains of buckets if given."""

    def __init__(self, n: int, gains: list[int] | None = None):
        self.n, self.gains = n, gains
        self.begin()

    def begin(self) -> None:
        self.nodes: list[Node] = []
        self.root = Node(self, None)

    def levels(self, said: list[bytes], a: int, b: int) -> Iterator[list[Node]]:
        """The nodes of the runs of 1 word, of 2 and so on that start at a word of a..b."""
        level = [self.root[w] for w in said[a:b]]
        yield level
        for k in range(1, self.n):
            level = [node[w] for node, w in zip(level, said[a + k : b + k])]
            yield level

    def count(self, said: list[bytes], totals: np.ndarray) -> None:
        for a in range(0, len(said), AT_ONCE):
            for level in self.levels(said, a, a + AT_ONCE):
                for node in level:
                    node.met += 1
            if len(self.nodes) > NODES:
                self.into(totals)

    def into(self, totals: np.ndarray) -> None:
        """Adds the counts of all nodes to their buckets' totals, and begins anew."""
        met, crc = (np.array([getattr(x, f) for x in self.nodes[1:]], np.int64) for f in ("met", "crc"))
        np.add.at(totals, crc % len(totals), met)
        self.begin()

    def gain(self, said: list[bytes]) -> tuple[int, int]:
        """How many runs there are, and the sum of their gains."""
        n = total = 0
        for a in range(0, len(said), AT_ONCE):
            for level in self.levels(said, a, a + AT_ONCE):
                n += len(level)
                total += sum(map(attrgetter("gain"), level))
            if len(self.nodes) > NODES:
                self.begin()
        return n, total


def bucket_totals(texts: DataFrame, text: str = "text", n: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """bucket and met: how many features of all texts it has; buckets without one have no row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        trie, totals = Trie(n), np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                trie.count(words(t), totals)
        trie.into(totals)
        own = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(totals[own])], ["bucket", "met"])

    parts = texts.where(F.col(text).isNotNull()).select(F.col(text).cast("binary")).mapInArrow(counted, "bucket int, met long")
    return parts.groupBy("bucket").agg(F.sum("met").alias("met"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of B buckets, from bucket totals of the corpus (s, in all S) and the target (t, in all T)."""
    s, t = ([0] * buckets for _ in range(2))
    for into, totals in ((s, corpus), (t, target)):
        for r in totals.collect():  # a row a bucket at most
            into[r.bucket] = r.met
    above, below = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((b + 1) * above / ((a + 1) * below))) for a, b in zip(s, t)]


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel draw in thousandths, by a hash of seed and doc_id; null without doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, text: str = "text", id_: str = "doc_id", n: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs with n_words, n_features, weight (the floored mean of their features' gains) and score (weight and a Gumbel draw)."""
    gain = gains(bucket_totals(docs, text, n, buckets), bucket_totals(target, text, n, buckets), buckets)
    docs = docs.drop("n_words", "n_features", "weight", "score", "rank")

    @F.pandas_udf("n_words long, n_features long, weight long")
    def walked(x: pd.Series) -> pd.DataFrame:
        forget()
        trie, out = Trie(n, gain), []
        for t in x:
            said = words(t)
            k, total = trie.gain(said)
            out.append((len(said), k, total // k if k else 0))
        return pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    (c,) = unused(docs, "c")
    docs = docs.withColumn(c, walked(F.col(text).cast("binary")))
    docs = docs.withColumns({f: F.col(f"{c}.{f}") for f in ("n_words", "n_features", "weight")}).drop(c)
    return docs.withColumn("score", F.col("weight") + noise(F.col(id_), seed))


def drawn(rows: DataFrame, id_: str = "doc_id", percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """Scored rows with rank, from 1, of the floor(percent / 100 of N) highest scores of the N rows of at least that many words; null for others."""
    rows = settled(rows, "scored")
    candidate = (F.col("n_words") >= least) & F.col("score").isNotNull()
    counts = rows.where(candidate).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score")).collect()  # a row a score
    wanted = percent * sum(r.n for r in counts) // 100
    before, above = [], 0
    for r in counts:
        if above >= wanted:
            break
        before.append((r.score, above))
        above += r.n
    if not before:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    sc, ab = unused(rows, "sc", "ab")
    table = rows.sparkSession.createDataFrame(before, f"{sc} long, {ab} long")
    high = F.coalesce(candidate & (F.col("score") >= before[-1][0]), F.lit(False))
    nth = F.col(ab) + F.row_number().over(Window.partitionBy("score").orderBy(id_))
    got = rows.where(high).join(F.broadcast(table), F.col("score") == F.col(sc)).withColumn("rank", nth.cast("long")).drop(sc, ab)
    got = got.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return got.unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long")))
