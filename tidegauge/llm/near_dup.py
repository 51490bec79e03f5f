"""Operator 9, SimHash near-duplicates: BK-trees over fingerprints in shards.

Fingerprints that differ in few bits agree on some choice of the others. A shard is one choice of bits and their values, so
that fingerprints that link meet in a shard; it holds distinct fingerprints only. In each shard a BK-tree is built, children
keyed by the integer Hamming distance to the parent, and each fingerprint follows only edges within the radius of its own
distance. All trees of a task are built and searched together, level by level, as arrays. A shard hands on a spanning star
of each of its components, never its pairs; a shard of more than SHARD_ROWS fingerprints is dealt out as pairs of pieces of
bounded size. Stars of all shards are joined to components by alternating large and small stars.

near_duplicates() links fingerprints; its shards are those of the pigeonhole principle, which lose no link. similar_groups()
links texts by the shared part of their shingles: a wide search by sampled bits of two fingerprints finds groups that may
hold links, and inside these groups, block by block, shingles themselves are compared. A wide group so large that most of
its texts are only chained together is taken apart into what shards brought together, so that a corpus whose wide groups
grow into one costs what its shards hold, not the square of its texts. What no mask brings together is then found by the
first of each text's shingles, rare ones first: two texts that link share one of these, so no link is left out.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, NUMBERS_AT_ONCE, TEXTS_AT_ONCE, checkpointed, few, forget, lookup, settled

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Blocks of a fingerprint; a shard's key has all but RADIUS of them.
BLOCKS = 6
#: Shingles hashed, tree nodes built, and (query, node) pairs looked at, at once.
BATCH_SHINGLES, BATCH_NODES, BATCH_PAIRS = 100_000, 100_000, 400_000
#: Fingerprints of a shard that one task holds; a larger shard is dealt out in pieces of half as many.
SHARD_ROWS = 200_000
#: For links by shingles: words of a shingle, their least shared part (Jaccard), the radius of the search in one
#: fingerprint, the bits that two fingerprints may differ in together, and the part of pairs at that radius that the sampled
#: masks of one fingerprint must bring together.
SIMILAR_SHINGLE, SIMILARITY, WIDE, WIDE_BOTH, AT_WIDE = 5, 0.8, 13, 30, 0.4
#: Texts whose shingles are compared by one task at once: two blocks of this size.
BLOCK_TEXTS = 200
#: A text in so many tells which shingles are common, those that so many of these texts hold; of them no more than COMMON, the most common ones, are set apart.
COMMON_OF, COMMON_IN, COMMON = 8, 3, 20_000
#: First shingles beyond one that texts must share to be compared, where the firsts hold so many.
SPARE = 4
#: Files, at most, into which a round of components() over few edges is written.
FEW_PARTS = 12
#: Texts of a wide group beyond which its texts meet shard by shard instead, where that compares less.
WHOLE_TEXTS = 2000


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _hashes(words: list[bytes], n: int) -> list[int]:
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    stop = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    start = [0, *(x + 1 for x in stop[:-n])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(start, stop[n - 1 :])]


def _mixed(h: np.ndarray, family: int) -> np.ndarray:
    """Another 64-bit hash of each hash, one for each family; family 0 is the hash itself."""
    if family:
        h = (h ^ (h >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * family + 1)) & ((1 << 64) - 1))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def simhashes(texts: Iterable[list[int]], size_of: int, families: int = 1) -> np.ndarray:
    """For size_of texts, whose shingles' hashes come one text after the other: a row of signed 64-bit fingerprints, one a family, for each: a bit is 1 if over half of the text's shingles have it; 0 without words."""
    out = np.zeros((size_of, families), np.uint64)
    held: list[list[int]] = []
    at: list[int] = []
    size = 0

    def close() -> None:
        counts = np.array([len(x) for x in held])
        hashes = np.array([h for x in held for h in x], "<u8")
        for k in range(families):
            bits = np.unpackbits(_mixed(hashes, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, np.cumsum(counts) - counts, axis=0, dtype=np.int64)
            out[at, k] = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8")[:, 0]

    for i, own in enumerate(texts):
        if own:
            held.append(own)
            at.append(i)
            size += len(own)
        if size >= BATCH_SHINGLES:
            close()
            held, at, size = [], [], 0
    if held:
        close()
    return out.view(np.int64)


def _each(x: pd.Series) -> Iterator[list[bytes]]:
    """The words of each text of a series; null has none."""
    return (_words(bytes(t)) if t is not None else [] for t in x)


def fingerprint(text: Column, n: int = SHINGLE) -> Column:
    """The signed 64-bit fingerprint of a string or binary column; null counts as the empty text."""

    @F.pandas_udf("bigint")
    def hashed(x: pd.Series) -> pd.Series:
        forget()
        return pd.Series(simhashes((_hashes(words, n) for words in _each(x)), len(x))[:, 0])

    return hashed(text.cast("binary"))


def shard_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Masks of 64 bits: `radius` differing bits spoil at most that many blocks, so two fingerprints agree under one of these."""
    edge = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(blocks)]
    return [sum(block[k] for k in c) for c in combinations(range(blocks), blocks - radius)]


def sampled_masks(bits: int, radius: int = WIDE, found: float = AT_WIDE) -> list[int]:
    """Masks of that many bits drawn with a fixed seed, as many as bring the part `found` of pairs at that radius together, more of the nearer ones."""
    together = math.comb(64 - radius, bits) / math.comb(64, bits)
    draw = random.Random(bits)
    return [sum(1 << b for b in draw.sample(range(64), bits)) for _ in range(math.ceil(math.log(1 - found) / math.log(1 - together)))]


def _roots(a: np.ndarray) -> np.ndarray:
    while (b := a[a]).tobytes() != a.tobytes():
        a = b
    return a


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root after joining each a with b; a root is the smallest position of its component."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        root = root.copy()
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        root = _roots(root)


def forest(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of runs of equal shard: each position's root, and the children as (65 * parent + distance, child), sorted."""
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    root = np.repeat(first, np.diff(np.r_[first, len(fp)]))
    at, parent = np.arange(len(fp)), root
    at, parent = at[at != root], parent[at != root]
    keys, children = [], []
    while len(at):
        key = 65 * parent + np.bitwise_count(fp[at] ^ fp[parent])
        edge, one, back = np.unique(key, return_index=True, return_inverse=True)
        child = at[one]
        keys.append(edge)
        children.append(child)
        parent = child[back]
        rest = at != parent
        at, parent = at[rest], parent[rest]
    if not keys:
        return root, np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    by = np.argsort(key)
    return root, key[by], child[by]


def linked(shard: np.ndarray, fp: np.ndarray, radius: int = RADIUS, other: np.ndarray | None = None, both: int = 0) -> np.ndarray:
    """For distinct fingerprints in runs of equal shard: the position that stands for the component of each within its run.

    Fingerprints within radius bits link; given a second fingerprint of each, only if they differ in `both` bits at most in all.
    """
    root, key, child = forest(shard, fp)
    comp = np.arange(len(fp))
    size = np.bincount(root, minlength=len(fp))[root]
    todo = [np.flatnonzero(size > 1)]
    todo = [(part, root[part]) for q in todo for part in np.array_split(q, max(1, -(-len(q) // 20_000)))]
    while todo:
        q, node = todo.pop()
        if len(q) > BATCH_PAIRS:
            half = len(q) // 2
            todo += [(q[:half], node[:half]), (q[half:], node[half:])]
            continue
        d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
        hit = (d <= radius) & (node < q)
        if other is not None:
            hit[hit] = d[hit] + np.bitwise_count(other[q[hit]] ^ other[node[hit]]) <= both
        comp = _union(comp, q[hit], node[hit])
        low = np.searchsorted(key, 65 * node + np.maximum(d - radius, 0), "left")
        n = np.searchsorted(key, 65 * node + np.minimum(d + radius, 64), "right") - low
        total = int(n.sum())
        if total:
            within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            todo.append((np.repeat(q, n), child[np.repeat(low, n) + within]))
    return comp


def _stars(batches: Iterator[pa.RecordBatch], radius: int, both: int, limit: int | None) -> Iterator[pa.RecordBatch]:
    """From rows (key..., fp, other) sorted by all: rows (key..., fp, other, to, to_other) from each fingerprint to the one that stands for its component in its run of equal keys.

    Of a run of over `limit` rows nothing is searched: all its rows are handed on without an end.
    """
    held: list[np.ndarray] = []
    n = 0
    names: list[str] = []
    passing: np.ndarray | None = None

    def out(rows: np.ndarray, to: np.ndarray | None) -> pa.RecordBatch:
        ends = [pa.nulls(len(rows), pa.int64())] * 2 if to is None else [pa.array(to[:, 0]), pa.array(to[:, 1])]
        return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(rows[:, k])) for k in range(rows.shape[1])], *ends], names=[*names, "to", "to_other"])

    def searched(rows: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (rows[1:, :-2] != rows[:-1, :-2]).any(axis=1)]
        fp, other = rows[:, -2].view(np.uint64), rows[:, -1].view(np.uint64)
        comp = linked(np.cumsum(new), np.ascontiguousarray(fp), radius, np.ascontiguousarray(other) if both else None, both)
        of = np.flatnonzero(comp != np.arange(len(comp)))
        return out(rows[of], rows[comp[of], -2:])

    def run_start(rows: np.ndarray) -> int:
        """Where the last run of rows begins."""
        return int(np.flatnonzero((rows[:, :-2] == rows[-1, :-2]).all(axis=1))[0])

    for b in batches:
        names = b.schema.names
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
        if passing is not None:
            more = int((rows[:, :-2] == passing).all(axis=1).sum())
            if more:
                yield out(rows[:more], None)
                rows = rows[more:]
            if not len(rows):
                continue
            passing = None
        held.append(rows)
        n += len(rows)
        if n >= BATCH_NODES:
            rows = np.concatenate(held)
            at = run_start(rows)
            if at:
                yield from _whole(rows[:at], limit, searched, out)
            rows = rows[at:]
            if limit and len(rows) > limit:
                yield out(rows, None)
                passing, rows = rows[-1, :-2].copy(), rows[:0]
            held, n = [rows], len(rows) if at else 0
    rows = np.concatenate(held) if held else np.zeros((0, 3), np.int64)
    if len(rows):
        yield from _whole(rows, limit, searched, out)


def _whole(rows: np.ndarray, limit: int | None, searched, out) -> Iterator[pa.RecordBatch]:
    """Whole runs: those of over `limit` rows handed on, the others searched."""
    if limit and len(rows) > limit:
        first = np.flatnonzero(np.r_[True, (rows[1:, :-2] != rows[:-1, :-2]).any(axis=1)])
        size = np.repeat(np.diff(np.r_[first, len(rows)]), np.diff(np.r_[first, len(rows)]))
        if (size > limit).any():
            yield out(rows[size > limit], None)
            rows = rows[size <= limit]
    if len(rows):
        yield searched(rows)


def _edges(rows: DataFrame, masks: list[int], radius: int, both: int = 0, limit: int = SHARD_ROWS) -> DataFrame:
    """Stars of rows (shard, fp, other), shard being the number of a mask: shard, fp, other, to, to_other. A shard's key, the masked fingerprint, is made where it is needed."""
    kinds, names = "fp bigint, other bigint, to bigint, to_other bigint", ["shard", "key", "fp", "other"]
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*map(F.lit, masks)), F.col("shard") + 1))
    dealt = rows.repartition("shard", key).withColumn("key", key).select(*names).sortWithinPartitions(*names)
    found = settled(dealt.mapInArrow(lambda b: _stars(b, radius, both, limit), f"shard bigint, key bigint, {kinds}"), "stars", NUMBERS_AT_ONCE)
    large = found.where("to IS NULL").select(*names)
    if large.take(1):
        # Each pair of pieces of a large shard is one group; a piece has a quarter of a task's rows.
        n = large.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n")).withColumn("pieces", F.ceil(F.col("n") / F.lit(max(1, limit // 4))).cast("int")).drop("n")
        own = large.join(F.broadcast(n) if few(n) else n, ["shard", "key"]).withColumn("piece", F.pmod(F.xxhash64("fp", "other"), F.col("pieces")).cast("int"))
        pairs = own.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("to_piece")).select("shard", "key", F.least("piece", "to_piece").alias("i"), F.greatest("piece", "to_piece").alias("j"), "fp", "other")
        split = pairs.repartition("shard", "key", "i", "j").sortWithinPartitions("shard", "key", "i", "j", "fp", "other")
        pieces = split.mapInArrow(lambda b: _stars(b, radius, both, None), f"shard bigint, key bigint, i bigint, j bigint, {kinds}")
        found = found.unionByName(settled(pieces.drop("i", "j"), "piece-stars", NUMBERS_AT_ONCE))
    return found.where("to IS NOT NULL").drop("key")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for all nodes that edges name.

    Edges that are few are joined by windows, three shuffles a round; of more, a node with many edges would be a hot key,
    whose least neighbours lookup() broadcasts.
    """

    def told(now: DataFrame) -> tuple:
        return tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, state = None, told(now)
    while state != before:
        size = state[0]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if size <= FEW:
            least = F.min("b").over(Window.partitionBy("a"))
            large = both.select("a", "b", F.least("a", least).alias("m")).where("b > a OR b = m").select(F.greatest("a", "b").alias("a"), F.col("m").alias("b"))
            # Of a node's neighbours the least one takes the node, the others go to the least one.
            small = large.select("a", "b", least.alias("m")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        else:
            low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
            large = lookup(both.where("b > a"), low, "a", "n", F.col("b"), 2 * size).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()
            large = checkpointed(large)
            low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
            small = lookup(large, low, "a", "n", F.col("b"), size).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")
        now = checkpointed(small.distinct().coalesce(FEW_PARTS) if size <= FEW else small.distinct())
        before, state = state, told(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs.

    Fingerprints link within radius bits; a component's id is its smallest doc_id. Null and empty texts, and those of
    white space only, have fingerprint zero and link like others; rows of equal texts share a fingerprint, so any number of
    copies costs one tree node. Null doc_ids are passed over as component ids unless a component has no other. Columns of
    docs besides these two aren't read. An empty table gives an empty result.
    """
    rows = settled(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")), "fingerprints", TEXTS_AT_ONCE)
    marks = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "marks")
    masks = [_signed(m) for m in shard_masks(radius, blocks)]
    shards = marks.select(F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("shard"), "fp", F.lit(0).cast("long").alias("other"))
    comps = components(_edges(shards, masks, radius).select(F.col("fp").alias("a"), F.col("to").alias("b")))
    named = marks.join(comps, F.col("fp") == F.col("node"), "left")
    firsts = named.where("component is not null").groupBy("component").agg(F.min("first").alias("smallest"))
    named = named.join(firsts, "component", "left").select("fp", F.when(F.col("component").isNotNull(), F.col("smallest")).otherwise(F.col("first")).alias("component_id"), "n")
    named = named.select(_hex("fp").alias("fingerprint"), "component_id", "n")
    rows = rows.select("doc_id", _hex("fp").alias("fingerprint"))
    return lookup(rows, named, "fingerprint", "n", F.monotonically_increasing_id(), rows.count())


def _hex(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _set(hashes: list[int]) -> np.ndarray:
    """The distinct hashes, sorted; texts without words share one shingle of their own."""
    return np.unique(np.array(hashes or [0], np.uint64)).view(np.int64)


def _least(size: int, similarity: float) -> int:
    """Shingles that a text of so many shares with any that links to it, at least."""
    return max(1, math.ceil(similarity * size - 1e-6))


def _firsts(own: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """Of a set the first shingles, as many as hold one of those that any linked text shares: all that aren't common come before the common ones (sorted, with their ranks)."""
    n = len(own) - _least(len(own), similarity) + 1
    at = np.minimum(np.searchsorted(common, own), max(0, len(common) - 1))
    often = common[at] == own if len(common) else np.zeros(len(own), bool)
    rare = own[~often][:n]
    return rare if len(rare) == n else np.r_[rare, own[often][np.argsort(rank[at[often]])][: n - len(rare)]]


def _fingerprints(text: Column, n: int, similarity: float, common: np.ndarray) -> Column:
    """A struct of two fingerprints of a text by different hashes, how many shingles it has, and the first of these. common: shingles from the rarest on."""
    rank = np.argsort(common)
    sorted_ = common[rank]

    @F.pandas_udf("fp bigint, fp2 bigint, size int, firsts array<bigint>")
    def both(x: pd.Series) -> pd.DataFrame:
        forget()
        sets: list[np.ndarray] = []

        def hashed() -> Iterator[list[int]]:
            for words in _each(x):
                hashes = _hashes(words, n)
                sets.append(_set(hashes))
                yield hashes

        out = pd.DataFrame(simhashes(hashed(), len(x), 2), columns=["fp", "fp2"])
        return out.assign(size=[len(own) for own in sets], firsts=[_firsts(own, sorted_, rank, similarity) for own in sets])

    return both(text.cast("binary"))


def _shingle_sets(text: Column, n: int) -> Column:
    @F.pandas_udf("array<bigint>")
    def sets(x: pd.Series) -> pd.Series:
        forget()
        return pd.Series([_set(_hashes(words, n)) for words in _each(x)])

    return sets(text.cast("binary"))


def _common(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """Shingles that many texts hold, from the rarest on, told by the texts of one in COMMON_OF digests. They only set an order, so that any choice is right and the common ones bring fewer texts together."""
    some = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64(digest(F.col("text"))), F.lit(COMMON_OF)) == 0)
    counts = some.select(F.explode(_shingle_sets(F.col("text"), n)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_IN)
    most = counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()  # COMMON pairs of numbers at most
    return np.array([r.h for r in reversed(most)], np.int64)


def _shared(first: list[np.ndarray], second: list[np.ndarray] | None, similarity: float) -> Iterator[tuple[int, int]]:
    """Places in the first list and in the second (within the first if there is none) of sets that share enough; of those that are linked within a list, only the first link is sought.

    For each set of the first list one pass over all words of the second counts what they share.
    """
    both = [*first, *(second or [])]
    size = np.array([len(x) for x in both])
    _, place = np.unique(np.concatenate(both), return_inverse=True)
    stop = np.cumsum(size)
    flag = np.zeros(int(place.max(initial=-1)) + 1, bool)
    low = len(first) if second is not None else 0
    inside = place[stop[low] - size[low] :]
    begin = (stop - size)[low:] - (stop[low] - size[low])
    for i in range(len(first)):
        own = place[stop[i] - size[i] : stop[i]]
        flag[own] = True
        n = np.add.reduceat(flag[inside], begin)
        flag[own] = False
        hit = n >= similarity * (size[i] + size[low:] - n)
        for j in np.flatnonzero(hit):
            if second is not None or j > i:
                yield i, int(j)


def _links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """From rows (comp, i, j, piece, digest, set) sorted by comp, i and j: links (a, b) of digests, a forest of those in a group."""
    held: list[tuple[str, int, np.ndarray]] = []
    key = None

    def close() -> pa.RecordBatch:
        _, i, j = key
        first = [x for x in held if x[1] == i]
        second = [x for x in held if x[1] == j] if i != j else None
        a, b, root = [], [], {}

        def top(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        if first and (second or i == j):
            for p, q in _shared([x[2] for x in first], [x[2] for x in second] if second is not None else None, similarity):
                x, y = first[p][0], (second if second is not None else first)[q][0]
                u, v = top(x), top(y)
                if u != v:
                    root[u] = v
                    a.append(x)
                    b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    for batch in batches:
        comp, i, j, piece, digest = (batch.column(k).to_pylist() for k in range(5))
        sets = batch.column(5)
        for r, own in enumerate(zip(comp, i, j)):
            if own != key:
                if len(held) > 1:
                    yield close()
                held, key = [], own
            values = sets[r].values
            held.append((digest[r], piece[r], values.to_numpy(zero_copy_only=False).copy() if values is not None else np.zeros(0, np.int64)))
    if len(held) > 1:
        yield close()


def digest(text: Column) -> Column:
    """What tells a text from others; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, radius: int = WIDE, both: int = WIDE_BOTH, found: float = AT_WIDE, block: int = BLOCK_TEXTS, whole: int = WHOLE_TEXTS) -> DataFrame:
    """digest, component (a digest), doc_id and first: a row for each distinct text of docs, with its group's smallest doc_id and that row's digest.

    Texts link if their sets of shingles share `similarity` of their union. A text of fewer words than a shingle is one
    shingle, one without words links to its likes only. Links are sought between texts of which one fingerprint differs in
    radius bits at most, both together in `both`, and that agree under one of the sampled masks, whose length grows slowly
    with the number of texts. Groups of such texts are then compared block by block by their shingles, so what links is
    exact. A group of more than `whole` texts is compared by its shards' own groups, which hold every pair that a mask
    brought together, where these have less to compare than the group as one. Links that the search does not bring together
    are found by _missed(), so none is lost. docs is read four times: some of it for common shingles, then for fingerprints
    and first shingles, and for the shingles of candidates of either search.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest"), _fingerprints(F.col(text), shingle, similarity, _common(docs, text, shingle)).alias("m")).select("doc_id", "digest", "m.*")
    rows = settled(rows, "fingerprints", TEXTS_AT_ONCE)
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id"))
    texts = settled(rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("fp", "fp2", "size", "firsts")], smallest.alias("smallest")), "texts")
    prints = settled(texts.select("fp", "fp2").distinct(), "prints")
    masks = [_signed(m) for m in sampled_masks(min(40, 12 + int(math.log2(max(2, prints.count()))) // 4), radius, found)]
    # Even shards look at the first fingerprint, odd ones at the second.
    ways = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(x).alias("fp"), F.col(y).alias("other")) for f, (x, y) in enumerate((("fp", "fp2"), ("fp2", "fp")))])).alias("w")
    shards = prints.select(ways).select("w.*", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("m")).select((2 * F.col("m") + F.col("f")).alias("shard"), "fp", "other")
    stars = _edges(shards, [m for m in masks for _ in range(2)], radius, both)
    swapped = F.col("shard") % 2 == 1
    node = lambda a, b: F.xxhash64(a, b)
    ends = [F.when(swapped, node(y, x)).otherwise(node(x, y)) for x, y in (("fp", "other"), ("to", "to_other"))]
    wide = components(stars.select(ends[0].alias("a"), ends[1].alias("b")))
    placed = texts.select("digest", "smallest.doc_id", node("fp", "fp2").alias("node")).join(wide, "node", "left").select("digest", "doc_id", "node", F.coalesce("component", "node").alias("comp"))
    n = placed.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("pieces", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    touched = lookup(placed, n, "comp", "n", F.xxhash64("digest"), texts.count()).where("pieces IS NOT NULL")
    touched = settled(touched.select("node", "comp", F.array(F.struct("comp", "pieces")).alias("meets"), F.col("digest").alias("_d"), F.col("doc_id").alias("_id")), "touched")
    if n.where(F.col("n") > whole).take(1):
        touched = settled(_apart(touched, stars.select("shard", ends[0].alias("node"), ends[1].alias("to")), block, whole), "apart")
    repeated = bool(_repeated(rows).take(1))

    def sets_of(table: DataFrame, *names: str) -> DataFrame:
        """digest, names and set of the texts of table (_d, _id, names), once each."""
        sets = _meeting(docs.select(digest(F.col(text)).alias("digest"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), table.select(*names, "_d", "_id"), "inner")
        sets = sets.select("digest", *names, _shingle_sets(F.col("text"), shingle).alias("set"))
        return sets.dropDuplicates(["digest"]) if repeated else sets

    sets = sets_of(touched, "meets")
    own = sets.select("digest", "set", F.explode("meets").alias("w")).select("digest", "set", "w.*").withColumn("piece", F.pmod(F.xxhash64("digest"), F.col("pieces")).cast("int"))
    pairs = own.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("to")).select("comp", F.least("piece", "to").alias("i"), F.greatest("piece", "to").alias("j"), "piece", "digest", "set")
    links = pairs.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(lambda b: _links(b, similarity), "a string, b string")
    comps = components(settled(links, "links", TEXTS_AT_ONCE))
    named = texts.select("digest", "smallest").join(comps, F.col("digest") == F.col("node"), "left")
    named = settled(named.select("digest", F.coalesce("component", "digest").alias("component"), F.struct("smallest.absent", "smallest.doc_id", "digest").alias("smallest")), "named")
    if (missed := _missed(texts, named, sets_of, similarity)) is not None:
        over = components(missed).select(F.col("node").alias("component"), F.col("component").alias("over"))
        named = settled(named.join(F.broadcast(over) if few(over) else over, "component", "left").select("digest", F.coalesce("over", "component").alias("component"), "smallest"), "named")
    firsts = named.groupBy("component").agg(F.min("smallest").alias("s"), F.count(F.lit(1)).alias("n"))
    return lookup(named.select("digest", "component"), firsts, "component", "n", F.col("digest"), named.count()).select("digest", "component", "s.doc_id", F.col("s.digest").alias("first"))


def _apart(touched: DataFrame, stars: DataFrame, block: int, whole: int) -> DataFrame:
    """touched (node, comp, meets, ...) where texts of components of over `whole` texts meet in the groups of stars (shard, node, to), if these have less to compare than the component.

    A component costs a row for each of its texts and blocks. Groups of the same nodes, found by several masks, count and
    meet once. A node meets in one group a shard, or one for each pair of pieces of a large shard.
    """
    cost = lambda n: n * F.ceil(n / F.lit(block))
    nodes = touched.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("texts"))
    sized = nodes.groupBy("comp").agg(F.sum("texts").alias("n")).where(F.col("n") > whole).select("comp", cost(F.col("n")).alias("together"))
    nodes = settled(nodes.join(F.broadcast(sized) if few(sized) else sized, "comp"), "large-nodes")
    members = stars.select(F.xxhash64("shard", "to").alias("group"), F.explode(F.array("node", "to")).alias("node")).distinct()
    members = settled(members.join(nodes, "node"), "members")
    groups = members.groupBy("comp", "together", "group").agg(F.sum("texts").alias("n"), F.count(F.lit(1)).alias("of"), F.bit_xor(F.xxhash64("node")).alias("all"))
    groups = settled(groups.groupBy("comp", "together", "n", "of", "all").agg(F.min("group").alias("group")), "groups-apart")
    less = groups.groupBy("comp", "together").agg(F.sum(cost(F.col("n"))).alias("apart")).where("apart < together").select("comp")
    groups = groups.join(F.broadcast(less) if few(less) else less, "comp").select("group", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("pieces"))
    met = members.select("group", "node", "texts").join(groups, "group").groupBy("node").agg(F.max("texts").alias("texts"), F.collect_list(F.struct(F.col("group").alias("comp"), "pieces")).alias("groups"))
    rows = lookup(touched, met, "node", "texts", F.xxhash64("_d"), touched.count())
    return rows.withColumn("meets", F.coalesce("groups", "meets")).drop("groups")


def _missed(texts: DataFrame, named: DataFrame, sets_of: Callable[..., DataFrame], similarity: float) -> DataFrame | None:
    """Links (a, b) between components of named (digest, component, smallest) that hold texts (digest, size, firsts) which link; None if there are none.

    Whatever the order of shingles, two linked texts share `need` of them at least, and fewer than `behind` of these can
    have fewer than `behind` shingles left in either text; so more than need - behind have more, and those are among the
    firsts of both. Pairs that have so many and lie in different components are compared by their whole sets, once each.
    """
    same_shingle = Window.partitionBy("h")
    node = F.xxhash64("digest")
    firsts = texts.select(node.alias("node"), "size", F.posexplode("firsts").alias("at", "h"))
    firsts = firsts.withColumns({"low": F.min("node").over(same_shingle), "high": F.max("node").over(same_shingle)})
    firsts = settled(firsts.where("low < high").drop("low", "high"), "firsts")
    placed = settled(firsts.join(named.select(node.alias("node"), F.xxhash64("component").alias("comp")), "node"), "placed")
    a, b = (placed.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "at", "comp")]) for x in "ab")
    at_least = lambda part, n: F.ceil(F.lit(part) * n - F.lit(1e-6))
    need = at_least(similarity / (1 + similarity), F.col("size_a") + F.col("size_b"))
    behind = F.greatest(need - SPARE, at_least(similarity, F.col("size_a")), at_least(similarity, F.col("size_b")))
    left = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    met = a.join(b, "h").where((F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & (left >= behind))
    met = met.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), (need - behind).alias("most")).agg(F.count(F.lit(1)).alias("n"))
    pairs = settled(met.where("n > most").select("a", "b"), "pairs")
    if not pairs.take(1):
        return None
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = settled(named.withColumn("node", node).join(nodes, "node").select("node", "component", F.col("digest").alias("_d"), F.col("smallest.doc_id").alias("_id")), "asked")
    sets = settled(sets_of(asked, "node", "component"), "sets", TEXTS_AT_ONCE)
    a, b = (sets.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"), F.col("set").alias(f"set_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    links = pairs.join(a, "a").join(b, "b").withColumn("shared", shared).where(F.col("shared") >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - F.col("shared")))
    links = settled(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct(), "missed")
    return links if links.take(1) else None


def _meeting(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """rows (digest, doc_id, ...) joined with table (_d, _id, ...) by both, null ids being alike; broadcast where the table is small. The pair spreads copies of a text over tasks."""
    on = (F.col("digest") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return rows.join(F.broadcast(table) if few(table) else table, on, how)


def _repeated(rows: DataFrame) -> DataFrame:
    """_d and _id of texts that rows (digest, doc_id) hold more than once under one doc_id."""
    return rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("_d"), F.col("doc_id").alias("_id"))


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id, the smallest doc_id of its similar_groups(), for each row of docs; null where a group has no doc_id."""
    groups = settled(similar_groups(docs, doc_id, text, shingle=shingle, similarity=similarity), "groups")
    rows = settled(docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest")), "digests")
    n = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    table = groups.select("digest", F.col("doc_id").alias("component_id")).join(n, "digest")
    return lookup(rows, table, "digest", "n", F.monotonically_increasing_id(), rows.count()).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each of its similar_groups(): that of the smallest doc_id.

    Rows are told apart by id and text, so equal doc_ids with different texts, and rows without doc_id, are judged by their
    texts; of rows with both alike one stays. Null and empty texts, and those of white space only, are one group. Columns of
    any name are kept. An empty table stays empty. Only ids and digests are shuffled, unless the rows that go are too many
    to be broadcast, or rows repeat, which are then shuffled themselves.
    """
    rows = docs.select(F.struct("*").alias("doc")).withColumns({"doc_id": F.col(f"doc.`{doc_id}`"), "text": F.col(f"doc.`{text}`")})
    groups = similar_groups(rows, shingle=shingle, similarity=similarity)
    marked = rows.select("doc", "doc_id", digest(F.col("text")).alias("digest"))
    pairs = settled(marked.select("digest", "doc_id"), "digests")
    kept = settled(groups.select(F.col("first").alias("_d"), F.col("doc_id").alias("_id")).distinct(), "kept")
    gone = settled(pairs.distinct().join(kept, (F.col("digest") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(F.col("digest").alias("_d"), F.col("doc_id").alias("_id")), "gone")
    left = _meeting(marked, gone, "left_anti")
    again = _repeated(pairs)
    if again.take(1):
        again = settled(again, "repeated")
        left = _meeting(left, again, "left_anti").unionByName(_meeting(left, again, "left_semi").dropDuplicates(["digest", "doc_id"]))
    return left.select("doc.*")
