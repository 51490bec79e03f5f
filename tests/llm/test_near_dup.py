"""SimHash near-duplicates against comparing all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidegauge.llm import near_dup as N


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_every_link_has_a_shard():
    random.seed(1)
    masks = N.shard_masks()
    for _ in range(2000):
        diff = sum(1 << b for b in random.sample(range(64), 4))
        assert any(not diff & m for m in masks)
    assert len(masks) == 15


def test_forest_finds_all_links():
    random.seed(2)
    centres = [random.getrandbits(64) for _ in range(20)]
    fps = sorted({c ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 5))) for c in centres for _ in range(15)})
    shard = np.zeros(len(fps), np.int64)
    got = N.linked(shard, np.array(fps, np.uint64))
    want = plain_components(fps)
    assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)] + [(200, x) for x in range(201, 240)]
    got = dict(N.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 240)}
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0


def texts():
    random.seed(3)
    base = [" ".join(random.choice("abcdefgh") * random.randint(1, 3) for _ in range(random.randint(30, 300))) for _ in range(25)]
    rows = [base[0]] * 40 + base
    for t in base[:10]:
        for _ in range(4):
            w = t.split()
            w[random.randrange(len(w))] = "zz"
            rows.append(" ".join(w))
    return [*rows, None, "", "  \n", "one", "ONE", "one two three", "long " * 20_000]


def test_against_all_pairs(spark):
    rows = list(enumerate(texts(), 10))
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "component_id": F.lit("clash")})
    got = N.near_duplicates(docs.repartition(5)).collect()
    assert len(got) == len(rows)
    rows.sort()
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(fps)
    want = {i: (f"{f:016x}", rows[c][0]) for (i, _), f, c in zip(rows, fps, comp)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


def test_odd_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "quite another text here")], "doc_id long, text string")
    found = N.near_duplicates(docs)
    assert sorted((r.doc_id or -1, r.component_id) for r in found.where("component_id IS NOT NULL").collect()) == [(-1, 4), (-1, 4), (4, 4), (4, 4)]
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_large_shards_are_dealt_in_pieces(spark):
    """All fingerprints in one shard, far over the limit: the same components as by one task."""
    random.seed(4)
    centres = [random.getrandbits(63) for _ in range(30)]
    fps = sorted({c ^ sum(1 << b for b in random.sample(range(63), random.randint(0, 4))) for c in centres for _ in range(20)})
    shards = spark.createDataFrame([(j, x, 0) for j in range(2) for x in fps], "shard int, fp long, other long")
    want = plain_components(fps)
    for limit in (1, 40, 10_000):
        got = dict(N.components(N._edges(shards, [0, -1], 4, limit=limit).select(F.col("fp").alias("a"), F.col("to").alias("b"))).collect())
        assert {(got.get(x, x), fps[c]) for x, c in zip(fps, want)} == {(fps[c], fps[c]) for c in want}


def test_a_run_over_the_limit_passes_through(monkeypatch):
    """Rows of a run that goes on over several batches are handed on as they are; runs around it are searched."""
    import pyarrow as pa

    monkeypatch.setattr(N, "BATCH_NODES", 10)
    rows = [(0, 1, x, 0) for x in (3, 7)] + [(0, 2, x, 0) for x in range(100, 160)] + [(0, 3, x, 0) for x in (8, 9)]
    names = ["shard", "key", "fp", "other"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 7])], names=names) for at in range(0, len(rows), 7)]
    got = [r for b in N._stars(iter(batches), 4, 0, 15) for r in b.to_pylist()]
    passed = sorted(r["fp"] for r in got if r["to"] is None)
    assert passed == list(range(100, 160)) and {(r["fp"], r["to"]) for r in got if r["to"] is not None} == {(7, 3), (9, 8)}


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_similar(texts):
    """For each text the first place of its component, linking texts that share 0.8 of their shingles; those without words are one."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if not both or len(sets[i] & sets[j]) >= 0.8 * both:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def edited(text, edits):
    w = text.split()
    for _ in range(edits):
        w[random.randrange(len(w))] = random.choice("pqrstuvw") * 4
    return " ".join(w)


def similar_texts():
    random.seed(5)
    base = [" ".join("".join(random.choice("abcdefgh") for _ in range(4)) for _ in range(random.randint(60, 300))) for _ in range(40)]
    near = [edited(t, random.randint(1, max(1, len(t.split()) // 60))) for t in base[:20] for _ in range(3)]
    far = [edited(t, len(t.split()) // 5) for t in base[20:30]]
    return [*base, *near, *far, base[3], base[3].upper(), None, "", " \n", "one", "One ", "one two three", "long " * 20_000]


def test_similar_against_all_pairs(spark):
    """Every found link is one; of those that compare all pairs, over nine tenths are found. A block's size changes nothing."""
    texts = similar_texts()
    want = plain_similar(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in N.similar(docs).collect()}
    assert len(got) == len(texts)
    groups = {}
    for i, c in got.items():
        groups.setdefault(c, set()).add(want[i])
        assert c <= i
    assert all(len(x) == 1 for x in groups.values())
    assert len(groups) - len(set(want)) <= 0.1 * (len(texts) - len(set(want)))
    a, b, apart = ({(r.digest, r.component) for r in N.similar_groups(docs, block=k, whole=w).collect()} for k, w in ((400, 2000), (3, 2000), (1, 1)))
    pairs = lambda found: {frozenset(d for d, c in found if c == x) for _, x in found}
    assert pairs(a) == pairs(b)
    # Compared by what shards brought together, groups are parts of those before, and over nine tenths are still found.
    assert all(any(x <= y for y in pairs(a)) for x in pairs(apart))
    assert len(pairs(apart)) - len(set(want)) <= 0.1 * (len(texts) - len(set(want)))


def test_chains_are_taken_apart(spark):
    """Ends of a star still meet, groups of the same nodes meet once, and what costs less as one, or is small, stays one."""
    chain = [(k, k, k + 1) for k in range(11)] + [(50, 0, 1), (51, 3, 5), (51, 4, 5)]
    dense = [(k, 20 + a, 20) for k in range(9) for a in range(1, 4 + k % 2)]
    small = [(0, 31, 30)]
    texts = [(n, 0 if n < 20 else 20 if n < 30 else 30, f"d{n}-{k}", n) for n in [*range(12), *range(20, 25), 30, 31] for k in range(5 if n == 7 else 1)]
    touched = spark.createDataFrame(texts, "node long, comp long, _d string, _id long").withColumn("meets", F.expr("array(struct(comp, -1 AS pieces))"))
    stars = spark.createDataFrame(chain + dense + small, "shard long, node long, to long")
    rows = N._apart(touched, stars, 2, 2).collect()
    assert sorted((r.node, r._d) for r in rows) == sorted((n, d) for n, _, d, _ in texts)
    met = {r._d: {w.comp: w.pieces for w in r.meets} for r in rows}
    at = lambda n: met[f"d{n}-0"]
    for k in range(11):
        assert set(at(k)) & set(at(k + 1))
    assert set(at(3)) & set(at(4)) & set(at(5)) and len(set(at(0)) & set(at(1))) == 1 and not set(at(0)) & set(at(2))
    assert all(met[f"d7-{k}"] == at(7) and set(at(7).values()) == {3} for k in range(5))
    assert all(at(n) == {20: -1} for n in range(20, 25)) and at(30) == at(31) == {30: -1}


def test_one_row_of_each_group_stays(spark):
    t = [edited("w" + " v w x y z" * 12, 30) for _ in range(3)]
    rows = [(0, t[0]), (1, t[0]), (1, t[1]), (1, t[1]), (None, t[1]), (None, t[2]), (None, t[2]), (7, None), (8, ""), (9, t[0].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component": F.lit("clash"), "_d": F.lit(1), "digest": F.lit(2), "doc": F.lit(3)})
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(False, 0, t[0]), (False, 1, t[1]), (True, 0, t[2]), (False, 7, "")])
    assert N.one_of_each(docs.limit(0)).count() == 0


def close_texts():
    """Pairs of texts that share just 0.8 of their shingles or just less, half of them with a passage that all those have; and copies of white space and of a few words."""
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(40)]
    out = []
    for k in range(160):
        w = [word() for _ in range(random.randint(60, 120))] + passage * (k % 2)
        # m words replaced well apart from each other take 5 m of n shingles: (n - 5 m) / (n + 5 m) is 0.8 at m = n / 45.
        m = (len(w) - 4) // 45 + (k % 8 == 0)
        other = list(w)
        for place in random.sample(range(1, len(w) // 6), m):
            other[6 * place] = word()
        out += [" ".join(w), " ".join(other)]
    return [*out, "one two", "ONE  two", None, " ", "one two three"]


def test_no_link_is_left_out(spark, monkeypatch):
    """All links of brute force at 0.8 are found, and no other, whatever shingles are held to be common and however little the wide search finds."""
    texts = close_texts()
    want = plain_similar(texts)
    assert 100 < len(texts) - len(set(want)) < 160
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, texts[0]), (900, texts[0]), (901, texts[1])], "doc_id long, text string").repartition(3)
    want = {i: c for i, c in enumerate(want)} | {900: want[0], 901: want[1]}
    assert {r.doc_id: r.component_id for r in N.similar(docs).collect()} == want
    for of, at_least in ((1, 2), (1, 100)):
        monkeypatch.setattr(N, "COMMON_OF", of)
        monkeypatch.setattr(N, "COMMON_IN", at_least)
        groups = {r.digest: r.doc_id for r in N.similar_groups(docs, radius=1, both=1).collect()}
        got = docs.select("doc_id", N.digest(F.col("text")).alias("d")).collect()
        assert {r.doc_id: groups[r.d] for r in got} == want


def test_first_shingles_hold_a_shared_one():
    """Two sets that share 0.8 of their union have a first shingle in common, with any shingles held to be common."""
    rng = np.random.default_rng(7)
    for _ in range(300):
        size = int(rng.integers(1, 60))
        pool = rng.integers(-(2**63), 2**63, 2 * size)
        a = pool[:size]
        b = np.r_[a[int(rng.integers(0, size // 5 + 1)) :], pool[size : size + int(rng.integers(0, size // 5 + 1))]]
        x, y = N._set(a.view(np.uint64).tolist()), N._set(b.view(np.uint64).tolist())
        common = np.unique(rng.choice(pool, int(rng.integers(0, size + 1))))
        rank = rng.permutation(len(common))
        firsts = [N._firsts(s, common, rank, 0.8) for s in (x, y)]
        if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
            assert len(np.intersect1d(*firsts))
        assert len(firsts[0]) == len(x) - N._least(len(x), 0.8) + 1 and set(firsts[0].tolist()) <= set(x.tolist())
