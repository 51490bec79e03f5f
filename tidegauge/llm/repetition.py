"""Operator 2, quality rules: repetition inside a text, from a suffix array over its words.

A batch of texts is laid end to end as one array of word numbers. Prefix doubling sorts all its suffixes at once (a
suffix ends with its text), re-sorting only groups that are still tied; the ranks kept from each doubling give the
longest common prefix of neighbours. A suffix's longest match with a neighbour is the depth of the deepest
longest-common-prefix interval that holds it: the union of those spans is what all maximal repeated substrings cover.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import forget, small_batches, unused

#: Words of a maximal repeated substring from which it counts; the largest part of the words that such spans may cover,
#: and the longest of them that a kept text may have.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 8, 0.4, 60
#: Words sorted at once; a longer text is sorted alone.
BATCH_WORDS = 200_000

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "n_repeats")
SCHEMA = StructType([StructField(c, LongType()) for c in COUNTS])


def suffix_ranks(doc: np.ndarray, word: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words; the last array is a permutation. doc does not fall; end: where each suffix's text ends."""
    n = len(word)
    key = doc.astype(np.int64) * (int(word.max(initial=0)) + 1) + word
    order = np.argsort(key, kind="stable")
    head = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, step = [rank], 1
    tied = order[~(head & np.r_[head[1:], True])]
    while len(tied):
        nxt = tied + step
        second = np.where(nxt < end[tied], rank[np.minimum(nxt, n - 1)], -1)
        by = np.lexsort((second, rank[tied]))
        tied, second, first = tied[by], second[by], rank[tied][by]
        group = np.r_[True, first[1:] != first[:-1]]
        head = group | np.r_[True, second[1:] != second[:-1]]
        at = np.arange(len(tied))
        rank = rank.copy()
        rank[tied] = first + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank)
        tied = tied[~(head & np.r_[head[1:], True])]
        step *= 2
    return levels


def neighbour_lcp(levels: list[np.ndarray], end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the longest common prefix of each suffix with its predecessor (0 for the first)."""
    n = len(end)
    sa = np.empty(n, np.int64)
    sa[levels[-1]] = np.arange(n)
    a, b = sa[1:].copy(), sa[:-1].copy()
    at = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b, found = a[at], b[at], np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < end[sa[1:][at]]) & (b < end[sa[:-1][at]])
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        a, b, found = a + (same << k), b + (same << k), found + (same << k)
    lcp = np.zeros(n, np.int64)
    lcp[at + 1] = found
    return sa, lcp


def longest_matches(lengths: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For each word position of texts laid end to end: words of the longest substring from there that its text has twice or more."""
    if not len(word):
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    sa, lcp = neighbour_lcp(suffix_ranks(doc, word, end), end)
    best = np.empty(len(word), np.int64)
    best[sa] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return best


def _covered(start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    edge = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(start + size, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0


def _per_text(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values)]
    stop = np.cumsum(lengths)
    return total[stop] - total[stop - lengths]


def measure(texts: list[bytes], min_repeat: int = MIN_REPEAT) -> np.ndarray:
    """A row of COUNTS for each text."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    words: list[np.ndarray] = []
    for i, t in enumerate(texts):
        own = t.split()
        words.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
        lines = [x for x in t.split(b"\n") if x.strip(_SPACE)]
        out[i, :4] = len(own), len(t.translate(None, _SPACE + _CONTINUATION)), len(t) - len(t.translate(None, _SYMBOLS)), len(lines) - len(set(lines))
    lengths, word = out[:, 0], np.concatenate([*words, np.zeros(0, np.int64)])
    best = longest_matches(lengths, word)
    n = len(word)
    three = np.flatnonzero(best >= 3)
    out[:, 4] = _per_text(_covered(three, np.full(len(three), 3), n), lengths)
    # A match that the one a word before it holds is no maximal repeat's own start; leaving it out changes no union.
    begins = np.r_[True, best[:-1] != best[1:] + 1] if n else np.zeros(0, bool)
    begins[np.cumsum(lengths)[lengths > 0][:-1]] = True
    long = np.flatnonzero((best >= min_repeat) & begins)
    out[:, 5] = _per_text(_covered(long, best[long], n), lengths)
    some = lengths > 0
    if some.any():
        out[some, 6] = np.maximum.reduceat(best, (np.cumsum(lengths) - lengths)[some])
    out[:, 7] = _per_text(np.bincount(long, minlength=n) if n else np.zeros(0, np.int64), lengths)
    return out


def _chunks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    own, size = [], 0
    for t in texts:
        n = len(t) // 2 + 1 if len(t) < 64 else t.count(b" ") + t.count(b"\n") + 1
        if own and size + n > BATCH_WORDS:
            yield own
            own, size = [], 0
        own.append(t)
        size += n
    if own:
        yield own


def repetition(text: Column, min_repeat: int = MIN_REPEAT) -> Column:
    """A struct of COUNTS for a string or binary column; null counts as the empty text."""

    @F.pandas_udf(SCHEMA)
    def counted(x: pd.Series) -> pd.DataFrame:
        forget()
        rows = [measure(c, min_repeat) for c in _chunks(bytes(t) if t is not None else b"" for t in x)]
        return pd.DataFrame(np.concatenate([np.zeros((0, len(COUNTS)), np.int64), *rows]), columns=list(COUNTS))

    return counted(text.cast("binary"))


def quality_rules(docs: DataFrame, text: str = "text", *, min_words: int = 50, max_repeat_words_pct: int = 50, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """docs with COUNTS, base_failed, covered_fraction and kept; a column of docs of the same name gives way.

    Sets small_batches() for the session. Null texts count as empty: no word, base_failed. A text is kept if the base rules hold, spans of maximal repeated
    substrings of min_repeat words or more cover at most max_covered of its words, and the longest repeat has at most
    max_longest words. Repeated rows each get their own row; an empty table gives an empty result.
    """
    if text not in docs.columns:
        raise ValueError(f"no column {text!r}")
    small_batches(docs.sparkSession)
    (name,) = unused(docs, "measured")
    m = F.col(name)
    out = docs.withColumn(name, repetition(F.col(text), min_repeat))
    failed = (m.n_words < min_words) | (100 * m.n_repeat_words > max_repeat_words_pct * m.n_words)
    covered = F.when(m.n_words > 0, m.covered_words / m.n_words).otherwise(F.lit(0.0))
    added = {c: m[c] for c in COUNTS} | {"base_failed": failed, "covered_fraction": covered, "kept": ~failed & (covered <= max_covered) & (m.longest_repeat <= max_longest)}
    return out.withColumns(added).drop(name)
