"""Operator 11, language ID: a bidirectional gated recurrent network over the bytes of a text.

A text is read whole, in windows of WINDOW bytes. In each window a network reads forwards and another backwards, one byte a
step from a state of zeros, and both states of a position give its languages' probabilities; a text's are the mean over all
its positions. A step: z = clip(Ez[byte] + h Uz), r = clip(Er[byte] + h Ur), c = tanh(Ec[byte] + r * (h Uc)),
h = h + z * (c - h), with gates clipped to 0..1. All windows of a batch go through a step together, as numpy arrays.

It is trained by backpropagation through time, in numpy, on a bounded sample: TEXTS texts of each language, drawn by a hash
of the row, PIECES windows of each. The sample is dealt into SHARDS; in each of ROUNDS a task a shard takes
STEPS steps of Adam over windows drawn from its own, starting from the mean of what all tasks had reached. Only these means, whose size hangs on the number
of languages, reach the driver. Languages are drawn alike often, so that a rare one counts like a frequent one.

Languages are the non-null values of lang; each is a class of the model. Rows without lang or text teach nothing. A text that
is null or has no letter (Unicode L), and any text where there was nothing to learn from, is `und` with score 0. Empty
tables, repeated rows, ties (the first language in order of names) and null ids are rows like any other. Columns of any
other name are kept; lang_pred, score and spans replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, settled, unused

#: Bytes of a window, numbers in a state, and windows that go through the network at once.
WINDOW, HIDDEN, AT_ONCE = 128, 8, 4096
#: The bound of the sample, in texts a language, and windows taken from a text.
TEXTS, PIECES = 1000, 8
#: Tasks that train apart, rounds after which their weights are averaged, steps of Adam a round, windows a step, and its rate.
SHARDS, ROUNDS, STEPS, BATCH, RATE = 4, 4, 48, 64, 0.01
UNKNOWN = "und"


def shapes(k: int, hidden: int = HIDDEN) -> dict[str, tuple[int, ...]]:
    """The network's weights: tables by byte (with the biases) and recurrent matrices of z, r and c in both directions, and the layer of k classes."""
    way = {f"{kind}{gate}{d}": ((256, hidden) if kind == "E" else (hidden, hidden)) for d in "fb" for gate in "zrc" for kind in "EU"}
    return way | {"Of": (hidden, k), "Ob": (hidden, k), "bias": (k,)}


def unpacked(flat: np.ndarray, k: int, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Views of a flat vector by the names of the weights."""
    out, at = {}, 0
    for name, shape in shapes(k, hidden).items():
        out[name] = flat[at : at + int(np.prod(shape))].reshape(shape)
        at += int(np.prod(shape))
    return out


def first_weights(k: int, hidden: int = HIDDEN, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = rng.normal(0, 0.2, sum(int(np.prod(s)) for s in shapes(k, hidden).values())).astype(np.float32)
    w = unpacked(flat, k, hidden)
    for name in ("Ezf", "Erf", "Ezb", "Erb"):
        w[name] += 0.5  # gates half open
    w["bias"][:] = 0
    return flat


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray
    hidden: int = HIDDEN


# Windows of texts.


def windows(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the texts, and start, length and text of each window, the longest windows first."""
    size = np.array([len(t) for t in texts], np.int64)
    count = -(-size // window)
    text = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(window, size[text] - nth * window)
    start = (np.cumsum(size) - size)[text] + nth * window
    order = np.argsort(-length, kind="stable")
    return np.frombuffer(b"".join(texts), np.uint8), start[order], length[order], text[order]


def laid_out(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by step and window, and how many windows, the first ones, reach each step."""
    steps = np.arange(length[0])
    at = np.minimum(start[None, :] + steps[:, None], len(data) - 1)
    return data[at].astype(np.intp), (length[None, :] > steps[:, None]).sum(1)


def _step(w: dict[str, np.ndarray], d: str, x: np.ndarray, h: np.ndarray) -> np.ndarray:
    z, r = w[f"Ez{d}"].take(x, 0), w[f"Er{d}"].take(x, 0)
    z += h @ w[f"Uz{d}"]
    r += h @ w[f"Ur{d}"]
    c = h @ w[f"Uc{d}"]
    c *= r.clip(0, 1, r)
    c += w[f"Ec{d}"].take(x, 0)
    np.tanh(c, c)
    c -= h
    c *= z.clip(0, 1, z)
    c += h
    return c


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(-1, keepdims=True)
    np.exp(x, x)
    x /= x.sum(-1, keepdims=True)
    return x


def probabilities(model: Model, x: np.ndarray, live: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Steps from the last to the first, each with the probabilities of its position in all windows that reach it."""
    w = unpacked(model.weights, len(model.languages), model.hidden)
    h, told = np.zeros((x.shape[1], model.hidden), np.float32), []
    for t, n in enumerate(live):
        h = _step(w, "f", x[t, :n], h[:n])
        told.append(h @ w["Of"] + w["bias"])
    h = np.zeros((0, model.hidden), np.float32)
    for t in range(len(live) - 1, -1, -1):
        if len(h) < live[t]:
            h = np.concatenate([h, np.zeros((live[t] - len(h), model.hidden), np.float32)])
        h = _step(w, "b", x[t, : live[t]], h)
        yield t, _softmax(told.pop() + h @ w["Ob"])


def pooled(model: Model, texts: list[bytes], labels: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Mean probabilities of each text (0 without bytes) and, if asked for, the most likely class of each byte, text after text."""
    total, k = np.zeros((len(texts), len(model.languages))), len(model.languages)
    data, start, length, text = windows(texts)
    found = np.zeros(len(data), np.int32) if labels else None
    for a in range(0, len(start), AT_ONCE):
        s, of = start[a : a + AT_ONCE], text[a : a + AT_ONCE]
        own = np.zeros((len(s), k), np.float32)
        for t, p in probabilities(model, *laid_out(data, s, length[a : a + AT_ONCE])):
            own[: len(p)] += p
            if labels:
                found[s[: len(p)] + t] = p.argmax(1)
        for j in range(k):
            total[:, j] += np.bincount(of, own[:, j], len(texts))
    return total / np.maximum([len(t) for t in texts], 1)[:, None], found


# Training.


def loss_gradient(flat: np.ndarray, k: int, x: np.ndarray, live: np.ndarray, y: np.ndarray, hidden: int = HIDDEN) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of all positions and its gradient, by backpropagation through time in both directions."""
    w, grad = unpacked(flat, k, hidden), np.zeros_like(flat)
    g, steps, n_all = unpacked(grad, k, hidden), range(len(live)), int(live.sum())
    after: dict[str, list] = {}
    held: dict[str, list] = {}
    for d, order in (("f", steps), ("b", reversed(steps))):
        h, after[d], held[d] = np.zeros((x.shape[1], hidden), flat.dtype), [None] * len(live), [None] * len(live)
        for t in order:
            n = live[t]
            b, before = x[t, :n], h[:n]
            z, r, q = w[f"Ez{d}"][b] + before @ w[f"Uz{d}"], w[f"Er{d}"][b] + before @ w[f"Ur{d}"], before @ w[f"Uc{d}"]
            zc, rc = z.clip(0, 1), r.clip(0, 1)
            c = np.tanh(w[f"Ec{d}"][b] + rc * q)
            held[d][t] = (before.copy(), (z > 0) & (z < 1), (r > 0) & (r < 1), q, zc, rc, c)
            h = h.copy()
            h[:n] = before + zc * (c - before)
            after[d][t] = h[:n]
    loss, told = 0.0, []
    for t in steps:
        p = _softmax(after["f"][t] @ w["Of"] + after["b"][t] @ w["Ob"] + w["bias"])
        at = (np.arange(live[t]), y[: live[t]])
        loss -= float(np.log(np.maximum(p[at], 1e-30)).sum())
        p[at] -= 1
        p /= n_all
        told.append(p)
        g["Of"] += after["f"][t].T @ p
        g["Ob"] += after["b"][t].T @ p
        g["bias"] += p.sum(0)
    for d, order in (("f", reversed(steps)), ("b", steps)):
        carried = np.zeros((x.shape[1], hidden), flat.dtype)
        rows: dict[str, list] = {gate: [] for gate in "zrc"}
        seen = []
        for t in order:
            n, (before, z_in, r_in, q, z, r, c) = live[t], held[d][t]
            dh = carried[:n] + told[t] @ w[f"O{d}"].T
            dc = dh * z * (1 - c * c)
            dz, dr, dq = dh * (c - before) * z_in, dc * q * r_in, dc * r
            for gate, v in (("z", dz), ("r", dr), ("c", dq)):
                g[f"U{gate}{d}"] += before.T @ v
            carried[:n] = dh * (1 - z) + dz @ w[f"Uz{d}"].T + dr @ w[f"Ur{d}"].T + dq @ w[f"Uc{d}"].T
            seen.append(x[t, :n])
            for gate, v in (("z", dz), ("r", dr), ("c", dc)):
                rows[gate].append(v)
        byte = np.concatenate(seen)
        for gate, parts in rows.items():
            v = np.concatenate(parts)
            for j in range(hidden):
                g[f"E{gate}{d}"][:, j] += np.bincount(byte, v[:, j], 256)
    return loss / n_all, grad


def trained(state: np.ndarray, k: int, pieces: list[bytes], y: np.ndarray, seed: int, hidden: int = HIDDEN) -> np.ndarray:
    """state (weights, and Adam's two moments and number of steps) after STEPS steps over pieces, drawn so that classes come alike often."""
    state, rng = state.copy(), np.random.default_rng(seed)
    w, m, v = state[:-1].reshape(3, -1)
    steps, share = int(state[-1]), 1 / np.bincount(y)[y]
    share /= share.sum()
    for _ in range(STEPS):
        at = rng.choice(len(pieces), BATCH, p=share)
        data, start, length, text = windows([pieces[i] for i in at])
        if not len(start):
            continue
        _, g = loss_gradient(w, k, *laid_out(data, start, length), y[at][text], hidden)
        g *= min(1.0, 1.0 / (float(np.sqrt((g * g).sum())) + 1e-9))
        steps += 1
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)
    state[-1] = steps
    return state


def sample(rows: DataFrame, text: str, lang: str, texts: int = TEXTS, pieces: int = PIECES, seed: int = 0) -> DataFrame:
    """shard, lang and pieces of `texts` rows of each language at most, those with the least hashes; all rows can be drawn."""
    rows = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # a row a language
    if not counts:
        return rows.sparkSession.createDataFrame([], "shard int, lang string, pieces array<binary>")
    spark = rows.sparkSession
    # A hash below this share of all hashes: some twice as many rows as are wanted, so that few rows are shuffled.
    rate = spark.createDataFrame([(c, min(1.0, (2.0 * texts + 100) / n)) for c, n in counts.items()], "lang string, rate double")
    other = [c for c, kind in rows.dtypes if c not in (text, lang) and kind in ("bigint", "int", "string")]
    drawn = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("b"), F.xxhash64(text, *other, F.lit(seed)).alias("h"))
    drawn = drawn.join(F.broadcast(rate), "lang").where(F.shiftrightunsigned("h", 11) / float(1 << 53) < F.col("rate"))
    length = F.octet_length("b")
    cut = lambda i: F.substring(F.col("b"), (F.pmod(F.xxhash64("h", F.lit(i)), F.greatest(length - WINDOW + 1, F.lit(1))) + 1).cast("int"), F.lit(WINDOW))
    drawn = drawn.select("lang", "h", F.array(*map(cut, range(pieces))).alias("pieces"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return drawn.withColumn("nth", nth).where(F.col("nth") <= texts).select((F.col("nth") % SHARDS).cast("int").alias("shard"), "lang", "pieces")


def fitted(rows: DataFrame, text: str = "text", lang: str = "lang", texts: int = TEXTS, rounds: int = ROUNDS, seed: int = 0) -> Model | None:
    """A model of the languages of rows; None where no row has both text and language."""
    drawn = settled(sample(rows, text, lang, texts, seed=seed), "languages")
    languages = sorted(r[0] for r in drawn.select("lang").distinct().collect())  # the classes of the model
    if not languages:
        return None
    k, of = len(languages), {c: i for i, c in enumerate(languages)}
    weights = first_weights(k, HIDDEN, seed)
    state = np.concatenate([weights, np.zeros(2 * len(weights) + 1, np.float32)])

    def round_from(state: np.ndarray, nth: int):
        def go(data: pd.DataFrame) -> pd.DataFrame:
            data = data.sort_values("lang", kind="stable")
            pieces = [bytes(p) for each in data["pieces"] for p in each]
            y = np.repeat(data["lang"].map(of).to_numpy(np.int64), data["pieces"].map(len).to_numpy())
            return pd.DataFrame({"n": [len(pieces)], "state": [trained(state, k, pieces, y, seed + nth).tobytes()]})

        return go

    for nth in range(rounds):
        got = drawn.groupBy("shard").applyInPandas(round_from(state, nth), "n long, state binary").collect()  # SHARDS rows
        total = sum(r.n for r in got)
        state = reduce(np.add, (np.frombuffer(r.state, np.float32) * np.float32(r.n / total) for r in got))
    return Model(languages, state[: len(weights)].copy())


# Prediction.

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("lang", T.StringType())]))


def predicted(df: DataFrame, model: Model | None, text: str = "text", spans: bool = False) -> DataFrame:
    """df with lang_pred and score, its mean probability and, if asked for, spans: runs of bytes [start, stop) whose most likely language is the same."""
    df = df.drop("lang_pred", "score", "spans")
    letters = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    (got,) = unused(df, "got")
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())] + [T.StructField("spans", SPANS)] * spans)
    if model is None:
        out = df.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
        return out.withColumn("spans", F.array().cast(SPANS)) if spans else out

    @F.pandas_udf(kind)
    def told(x: pd.Series) -> pd.DataFrame:
        forget()
        texts = [b"" if t is None else bytes(t) for t in x]
        p, labels = pooled(model, texts, spans)
        best = p.argmax(1)
        out = pd.DataFrame({"lang": [model.languages[i] for i in best], "score": p[np.arange(len(best)), best].clip(0, 1)})
        if spans:
            ends = np.cumsum([len(t) for t in texts])
            out["spans"] = [_runs(labels[e - len(t) : e], model.languages) for t, e in zip(texts, ends)]
        return out

    known = lambda c, otherwise: F.when(letters, F.col(f"{got}.{c}")).otherwise(otherwise)
    out = df.withColumn(got, told(F.when(letters, F.col(text).cast("binary"))))
    more = {"spans": known("spans", F.array().cast(SPANS))} if spans else {}
    return out.withColumns({"lang_pred": known("lang", F.lit(UNKNOWN)), "score": known("score", F.lit(0.0))} | more).drop(got)


def _runs(labels: np.ndarray, languages: list[str]) -> list[dict]:
    if not len(labels):
        return []
    edge = np.flatnonzero(np.diff(labels, prepend=labels[0] - 1))
    return [{"start": int(a), "stop": int(b), "lang": languages[labels[a]]} for a, b in zip(edge, [*edge[1:], len(labels)])]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def document_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, by a model of those that aren't held out. A null doc_id is no number to be held out by: such rows are predicted, and not learned from."""
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(True))
    model = fitted(docs.where(~out).select("doc_id", "text", "lang"))
    return predicted(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")
