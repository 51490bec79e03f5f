"""Operator 10, benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask such as 110101011 picks positions of a window of words; words at the other positions may differ. Hashes of the
picked words of every window of the benchmark meet those of every window of the documents. A hit fixes how the two texts
lie side by side, and only those alignments are verified: over some window, enough words must be equal in place. An item's
masks hang on its length, so that every set of differing words that verification allows leaves a hit.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW, few, settled, unused

#: Fixed masks; 1: the word counts, 0: it may differ.
MASKS = ("110101011", "111001101")
#: Words of a verified overlap (the whole item where it is shorter), and the part of them that must be equal in place.
WINDOW, MATCH = 13, 0.8
#: Items with fewer words are passed over; by default none is. Of up to four words all must be equal, as MATCH leaves none to differ.
SHORTEST = 1
#: Of fewer words than this no item takes a document out in clean(), unless asked for: so short a run of words is common language.
REMOVING = 5
#: Words that added masks pick at most, and the sets of differing words up to which masks are searched for.
PICKED, MOST_SETS = 6, 1000
#: Seeds of the benchmark up to which they are broadcast (24 bytes each); more are joined by a shuffle, in which each has
#: SALTS copies, so that a common phrase of the documents is not one task.
BROADCAST_SEEDS, SALTS = 1_000_000, 32
#: Words of all items up to which they are broadcast; more are joined by a salted shuffle too.
BROADCAST_WORDS = 500_000
#: Alignments that start within so many words of a text are verified together.
STRETCH = 65_536


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _escapes(mask: str, width: int, differing: tuple[int, ...]) -> bool:
    """Whether mask has a place among width words where none that it picks differs."""
    return any(all(not 0 <= d - at < len(mask) or mask[d - at] == "0" for d in differing) for at in range(width - len(mask) + 1))


def masks_of(width: int, match: float = MATCH, masks: tuple[str, ...] = MASKS) -> tuple[str, ...]:
    """masks, those that fit into width words, and as many more as leave a seed whichever words verification lets differ."""
    out = [m for m in masks if len(m) <= width]
    differ = width - max(1, ceil(match * width - 1e-9))
    run = ceil((width - differ) / (differ + 1))
    if comb(width, differ) > MOST_SETS:
        return (*out, "1" * run)
    left = [d for d in combinations(range(width), differ) if not any(_escapes(m, width, d) for m in out)]
    n = min(PICKED, width - differ)
    every = [m for size in range(n, width + 1) for inner in combinations(range(1, size - 1), max(0, n - 2)) for m in ["".join("1" if i in (0, size - 1, *inner) else "0" for i in range(size))] if m.count("1") == n]
    while left:
        best = max(every, key=lambda m: sum(_escapes(m, width, d) for d in left))
        rest = [d for d in left if not _escapes(best, width, d)]
        if len(rest) == len(left):
            return (*out, "1" * run)
        out.append(best)
        left = rest
    return tuple(out)


def seeds(w: Column, masks: tuple[str, ...] = MASKS) -> Column:
    """For each mask one array: the hash of the picked words of the window from each position of the words w."""

    def hashed(mask: str) -> Column:
        at = [i for i, bit in enumerate(mask) if bit == "1"]
        windows = F.size(w) - len(mask) + 1
        each = F.transform(F.sequence(F.lit(0), windows - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in at]))
        return F.when(windows > 0, each).otherwise(F.array().cast("array<bigint>"))

    return F.array(*[hashed(m) for m in masks])


def _by_seed(rows: DataFrame, masks: tuple[str, ...], at: str) -> DataFrame:
    """Of rows (key, words w): key, mask, seed and its position."""
    each = rows.where(F.size("w") >= min(map(len, masks), default=0)).select("key", F.posexplode(seeds(F.col("w"), masks)).alias("mask", "seeds"))
    return each.select("key", "mask", F.posexplode("seeds").alias(at, "seed"))


def _own(width: Column, of: dict[int, tuple[str, ...]], every: tuple[str, ...]) -> Column:
    """Whether the mask numbered `mask` is one for items of width words."""
    out = F.lit(False)
    for w, masks in of.items():
        out = out | ((width == w) & F.col("mask").isin(*[every.index(m) for m in masks]))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", *, masks: tuple[str, ...] = MASKS, window: int = WINDOW, match: float = MATCH, broadcast_seeds: int = BROADCAST_SEEDS, broadcast_words: int = BROADCAST_WORDS, shortest: int = SHORTEST) -> DataFrame:
    """A row for each document and benchmark item of which it holds a passage: doc_id, item_id, matched, window, doc_start, item_start.

    matched of window words are equal in place, match * window at least; the best such place is given, the first of
    equals. Items with equal words count as one, under their smallest item_id. Null and empty texts hold no word and match
    nothing, nor do items with fewer than `shortest` words; a short item must stand in the text whole, so one that is a
    common word is found in every text that has it. Repeated rows of docs give their row once, and rows without doc_id
    count as one document, whose doc_id is null; texts of any length are taken whole. Other columns of docs and benchmark
    aren't read.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("w")).groupBy("w").agg(F.min("item_id").alias("item_id")).where(F.size("w") >= max(1, shortest)).withColumn("key", F.monotonically_increasing_id())
    items = settled(items, "items")
    width = F.least(F.size("w"), F.lit(window))
    of = {r.n: masks_of(r.n, match, masks) for r in items.select(width.alias("n")).distinct().orderBy(F.desc("n")).collect()}  # window rows at most
    masks = tuple(dict.fromkeys(m for x in of.values() for m in x)) or masks
    sizes = items.select(F.col("key").alias("_key"), width.alias("_width"), F.size("w").alias("n_item"))
    wanted = settled(_by_seed(items, masks, "item_at").join(sizes, F.col("key") == F.col("_key")).where(_own(F.col("_width"), of, masks)).select("mask", "seed", F.col("key").alias("item"), "item_at", "n_item"), "seeds")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("key"))
    each = _by_seed(rows.select("key", words(F.col("text")).alias("w")), masks, "doc_at")
    if few(wanted, broadcast_seeds):
        hits = each.join(F.broadcast(wanted), ["mask", "seed"])
    else:
        salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = each.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["mask", "seed", "salt"])
    shift = F.col("doc_at") - F.col("item_at")
    found = hits.select("key", "item", "n_item", shift.alias("shift")).distinct()
    stretch = F.floor(F.col("shift") / STRETCH)
    lines = settled(found.groupBy("key", stretch.alias("stretch")).agg(F.collect_set(F.struct("item", "n_item", "shift")).alias("lines")), "alignments")
    names = items.select(F.col("key").alias("item"), F.col("w").alias("v"), "item_id")
    return _verified(_met(_cut(rows, lines), names, broadcast_words), window, match)


def _cut(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, item, shift and the words u of the text that lie beside the item, for each alignment of lines (key, lines): no text goes further than this.

    Copies of a row are put together before they are shuffled; large sets of keys are joined in salted copies.
    """
    keys = lines.select("key").distinct()
    if few(keys, FEW):
        hit = rows.join(F.broadcast(keys), "key", "left_semi")
    else:
        salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left_semi")
    texts = hit.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    # The planner may look at places that where() leaves out, so no argument is ever out of range.
    beside = lambda w, x: F.slice(w, F.greatest(x["shift"], F.lit(0)) + 1, F.greatest(x["n_item"] + F.least(x["shift"], F.lit(0)), F.lit(0)))
    each = texts.join(lines, "key").select("doc_id", "lines", words(F.col("text")).alias("w"))
    cut = F.transform("lines", lambda x: F.struct(x["item"].alias("item"), x["shift"].alias("shift"), beside(F.col("w"), x).alias("u")))
    return each.select("doc_id", F.explode(cut).alias("line")).select("doc_id", "line.*")


def _met(cut: DataFrame, names: DataFrame, broadcast_words: int) -> DataFrame:
    """cut with the words v and the item_id of names; many items are shuffled in salted copies, so that an item that is a common phrase is not one task."""
    if (names.agg(F.sum(F.size("v"))).first()[0] or 0) <= broadcast_words:
        return cut.join(F.broadcast(names), "item")
    salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "shift"), F.lit(SALTS)).cast("int")).join(salted, ["item", "salt"]).drop("salt")


def _verified(both: DataFrame, window: int, match: float) -> DataFrame:
    """both has doc_id, item_id, its words v, shift, the position in the text of v's first word, and u, the text's words beside those of v."""
    at_w, at_v = F.greatest("shift", F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    size = F.least(F.size("u"), F.greatest(F.size("v") - at_v, F.lit(0)))
    width = F.least(F.lit(window), F.size("v"))
    equal = F.zip_with(F.slice("u", 1, F.col("size")), F.slice("v", at_v + 1, F.col("size")), lambda a, b: (a == b).cast("int"))
    long = both.withColumns({"at_w": at_w, "at_v": at_v, "size": size, "width": width}).where("size >= width").withColumn("equal", equal)
    sums = F.transform(F.sequence(F.lit(0), F.greatest(F.col("size") - F.col("width"), F.lit(0))), lambda i: F.struct(F.aggregate(F.slice("equal", i + 1, F.col("width")), F.lit(0), lambda a, b: a + b).alias("matched"), (-i).alias("minus")))
    best = long.withColumn("best", F.array_max(sums)).where(F.col("best.matched") >= F.lit(match) * F.col("width"))
    place = F.struct(F.col("best.matched").alias("matched"), F.col("width").alias("window"), (-(F.col("at_w") - F.col("best.minus"))).alias("w"), (-(F.col("at_v") - F.col("best.minus"))).alias("v"))
    top = best.groupBy("doc_id", "item_id").agg(F.max(place).alias("p"))
    return top.select("doc_id", "item_id", F.col("p.matched").alias("matched"), F.col("p.window").alias("window"), (-F.col("p.w")).alias("doc_start"), (-F.col("p.v")).alias("item_start"))


def without(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose doc_id isn't in found, all rows of an id going with it; those without doc_id stay."""
    gone = settled(found.select(F.col("doc_id").alias("gone")).where("gone IS NOT NULL").distinct(), "gone")
    (name,) = unused(docs, "gone")
    gone = gone.withColumnRenamed("gone", name)
    return docs.join(F.broadcast(gone) if few(gone) else gone, F.col(doc_id) == F.col(name), "left_anti")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", *, shortest: int = REMOVING) -> DataFrame:
    """The rows of docs without a passage of the benchmark, judged row by row, whatever their ids; contaminated() says what a passage is. Items of fewer than `shortest` words are passed over; 1 takes all.

    Repeated rows go or stay together; null and empty texts stay. An empty table, or an empty benchmark, leaves docs as they are.
    """
    own, name = unused(docs, "text_hash", "gone")
    found = contaminated(docs.select(F.xxhash64(text).alias("doc_id"), F.col(text).alias("text")), benchmark, item_id=item_id, item_text=item_text, shortest=shortest)
    gone = settled(found.select(F.col("doc_id").alias(name)).distinct(), "gone")
    rows = docs.withColumn(own, F.xxhash64(text))
    return rows.join(F.broadcast(gone) if few(gone) else gone, F.col(own) == F.col(name), "left_anti").drop(own)
