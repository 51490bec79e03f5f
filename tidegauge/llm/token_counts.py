"""Operator 4, token counts: two tiers of pre-token lengths on the map side, no pre-token shuffle.

The first pass sums up each task's texts in a bounded list of its most frequent white-space separated words. A list is one
packed row; lists are added up in a tree, some tens in a task that reads them in place, until one is left for the driver.
The lengths of the most frequent words are broadcast as one packed table: the first tier. The second pass adds up lengths
text by text; words outside the table go to the worker's bounded cache, and only words that are new there go to the
tokenizer, a batch at a time. Which words are frequent changes the speed, never a count.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, settled
from .public_vocab import default_path, word_ids

#: Words in the broadcast table, and in each list on its way there: its size has that bound at any input.
FREQUENT = 20_000
#: Lists that one task adds up.
FAN_IN = 32
#: Bytes of a word from which it isn't tabled.
LONGEST_WORD = 64
#: Words in a worker's cache, the second tier.
CACHE_WORDS = 200_000

def _listed(counts: Counter[bytes], most: int) -> pa.RecordBatch:
    own = [(w, c) for w, c in counts.most_common(most) if len(w) < LONGEST_WORD and c > 1]
    return pa.RecordBatch.from_arrays([pa.array([b"\n".join(w for w, _ in own)], pa.binary()), pa.array([np.array([c for _, c in own], "<i8").tobytes()], pa.binary())], names=["words", "counts"])


def _added(counts: Counter[bytes], words: bytes, times: bytes, most: int) -> Counter[bytes]:
    if times:
        counts.update(dict(zip(words.split(b"\n"), np.frombuffer(times, "<i8").tolist())))
    return Counter(dict(counts.most_common(most))) if len(counts) > 8 * most else counts


def frequent_words(docs: DataFrame, text: str, path: str, most: int = FREQUENT) -> list[bytes]:
    """At most `most` of the words found most often, by lists of at most `most` words from each task."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        ids = word_ids(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                for t in b.column(0).slice(at, 500).to_pylist():
                    counts.update(ids.words(t or b""))
                if len(counts) > 8 * most:
                    counts = Counter(dict(counts.most_common(most)))
        yield _listed(counts, most)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for b in batches:
            for words, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts = _added(counts, words, times, most)
        yield _listed(counts, most)

    kind = "words binary, counts binary"
    lists = settled(docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(listed, kind), "word-lists")
    while (n := lists.count()) > 1:
        lists = settled(lists.coalesce(-(-n // FAN_IN)).mapInArrow(merged, kind), "word-lists")
    counts: Counter[bytes] = Counter()
    for r in lists.collect():  # a row at most
        counts = _added(counts, bytes(r.words), bytes(r.counts), most)
    return sorted(w for w, _ in counts.most_common(most))


class Lengths(dict):
    """word -> tokens: the broadcast table first, then what this worker has met, up to CACHE_WORDS words."""

    def __init__(self, path: str, words: bytes, lengths: bytes):
        super().__init__(zip(words.split(b"\n"), np.frombuffer(lengths, np.uint8).tolist()) if words else ())
        self.path, self.second = path, {}

    def of(self, texts: list[bytes]) -> list[int]:
        ids = word_ids(self.path)
        own = [ids.words(t) for t in texts]
        new = {w for w in set().union(*own) if w not in self and w not in self.second}
        if new:
            if len(self.second) + len(new) > CACHE_WORDS:
                self.second = {}
                new = {w for w in set().union(*own) if w not in self}
            ids.fill(new)
            size = ids.dtype.itemsize
            self.second.update((w, len(ids[w]) // size) for w in new)
            ids.clear()  # lengths are what is kept here
            ids.old = {}
        return [sum(map(self.__getitem__, w)) for w in own]

    def __missing__(self, w: bytes) -> int:
        return self.second[w]


_lengths: dict[str, Lengths] = held({})


def token_counts(docs: DataFrame, text: str = "text", *, path: str | None = None, limit: int = 2048, table_words: int = FREQUENT) -> DataFrame:
    """docs with n_bytes (of the UTF-8), n_tokens and over_limit (n_tokens > limit); columns of docs so named give way.

    Token counts are those of the library for the file at path, without added special tokens; special strings inside
    a text count as the library's default has it. Null texts count as empty: no byte, no token. A text of any length
    is taken whole. Repeated rows and an empty table need nothing special.
    """
    path = path or default_path("word_bpe_49k.json")
    spark = docs.sparkSession
    words = frequent_words(docs, text, path, table_words)
    table = Lengths(path, b"", b"")
    counts = [n for at in range(0, len(words), 5000) for n in table.of(words[at : at + 5000])]
    short = [(w, c) for w, c in zip(words, counts) if c < 256]
    packed = spark.sparkContext.broadcast((b"\n".join(w for w, _ in short), np.array([c for _, c in short], np.uint8).tobytes()))

    key = uuid.uuid4().hex

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _lengths:
            _lengths.clear()
            _lengths[key] = Lengths(path, *packed.value)
        lengths = _lengths[key]
        for b in batches:
            n, size = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for at in range(0, b.num_rows, 500):
                texts = [t or b"" for t in b.column(b.num_columns - 1).slice(at, 500).to_pylist()]
                n[at : at + 500], size[at : at + 500] = lengths.of(texts), [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size), pa.array(n), pa.array(n > limit)], schema=pa.schema([*list(b.schema)[:-1], pa.field("n_bytes", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("over_limit", pa.bool_())]))

    added = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in docs.columns if c not in added]
    rows = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    schema = docs.select(*keep).withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long"), "over_limit": F.lit(False)}).schema
    return rows.mapInArrow(counted, schema)

