"""Operator 12, embedding whitening: an exact scatter by residues, then eigenvectors.

An entry c becomes the whole number x = floor(64 c) + 1000000. The fit list is each distinct vector of x once. A partition
takes its vectors modulo some primes and multiplies matrices of residues, in doubles that hold every sum exactly; residues are
summed over partitions by Spark. The driver, which holds d x d numbers a prime for vectors of d entries, puts them together by
the Chinese remainder theorem: sums and scatter are exact whole numbers, however far from zero the vectors lie, so centring
n * sum(x y) - sum(x) * sum(y) loses nothing. Its eigenvectors are found in double precision.

As many primes are taken as n times the largest product needs, so any entry that fits a long is exact. Entries beyond that
count as the least or the largest long. Rows whose vector is null or has null or non-finite entries have no result. Neither
have rows whose vector's length isn't the most common one among distinct vectors (of several, the longest): they lie in
another space. Repeated rows are fitted once and whitened each. Where the covariance has rank r, directions from r + 1 on
have no length: whitened is null there and explained 0, and identity_error is that of the others. An empty table has an empty
result. Columns of any other name are kept; whitened and deviation replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, settled, unused

SCALE, SHIFT = 64, 1_000_000
#: Entries that are made to numbers at once, and vectors of residues that are multiplied at once: so many products of two
#: residues under 2^20 add up to less than 2^53.
ENTRIES, ROWS = 2_000_000, 8192
LARGEST, LEAST = 2**63 - 1, -(2**63)


def primes(least: int) -> list[int]:
    """The largest primes under 2^20, as many as have a product over least."""
    out: list[int] = []
    p = 2**20
    while not out or prod(out) <= least:
        p = next(q for q in range(p - 1, 1, -1) if all(q % f for f in range(2, int(q**0.5) + 1)))
        out.append(p)
    return out


def quantized(values: np.ndarray) -> np.ndarray:
    """x of each entry, as longs."""
    with np.errstate(over="ignore"):
        y = np.floor(SCALE * values.astype(np.float64)).clip(-(2.0**64), 2.0**64)
    if (np.abs(y) < 2.0**62).all():
        return y.astype(np.int64) + SHIFT
    return np.array([min(max(int(v) + SHIFT, LEAST), LARGEST) for v in y.ravel()], np.int64).reshape(y.shape)


def vectors(x: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and x-vectors of the rows of a list array that have only finite entries, those of a length together, bounded numbers at once."""
    length = pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(x.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    start = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    for d in np.unique(length[length >= 0]):
        rows, step = np.flatnonzero(length == d), max(1, ENTRIES // max(int(d), 1))
        for a in range(0, len(rows), step):
            at = rows[a : a + step]
            v = flat[start[at][:, None] + np.arange(d)]
            sound = np.isfinite(v).all(1)
            yield at[sound], quantized(v[sound])


# Each distinct vector once.

CODE = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("code", T.BinaryType())])


def coded(x: pa.Array) -> pa.Array:
    """dim, width and code of each vector: x - SHIFT in the least whole bytes that hold all of them; null where there is none."""
    dim, width, code = np.zeros(len(x), np.int32), np.zeros(len(x), np.int32), [None] * len(x)
    for at, v in vectors(x):
        with np.errstate(over="ignore"):
            y = v - SHIFT  # may wrap around; decoded() wraps it back
        low, high = (y.min(1), y.max(1)) if y.shape[1] else (np.zeros(len(y)), np.zeros(len(y)))
        w = np.select([(low >= -(2 ** (8 * b - 1))) & (high < 2 ** (8 * b - 1)) for b in (1, 2, 4)], [1, 2, 4], 8)
        dim[at], width[at] = y.shape[1], w
        for b in np.unique(w):
            for i, row in zip(at[w == b], y[w == b].astype(f"<i{b}")):
                code[i] = row.tobytes()
    null = pa.array([c is None for c in code], pa.bool_())
    return pa.StructArray.from_arrays([pa.array(dim), pa.array(width), pa.array(code, pa.binary())], ["dim", "width", "code"], mask=null)


def decoded(codes: list[bytes], width: int, dim: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.frombuffer(b"".join(codes), f"<i{width}").reshape(len(codes), dim).astype(np.int64) + SHIFT


def fit_list(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """dim, width and code of each distinct vector; the codes, a byte an entry for entries within 2, are what is shuffled."""

    @F.arrow_udf(CODE)
    def code(x: pa.Array) -> pa.Array:
        forget()
        return coded(x)

    return df.select(code(F.col(embedding)).alias("c")).where("c IS NOT NULL").select("c.*").distinct()


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """x-vectors of rows of a fit list, ROWS at once at most."""
    for batch in batches:
        width = batch.column("width").to_numpy()
        code = batch.column("code").to_pylist()
        for w in np.unique(width):
            own = [code[i] for i in np.flatnonzero(width == w)]
            step = max(1, min(ROWS, ENTRIES // max(dim, 1)))
            for a in range(0, len(own), step):
                yield decoded(own[a : a + step], int(w), dim)


def residues(points: DataFrame, dim: int, moduli: list[int]) -> DataFrame:
    """k, i, j and r: sums of products of entries i <= j modulo the prime k, and of entries i alone (j = -1), over all points."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scatter, total = np.zeros((len(moduli), dim, dim), np.int64), np.zeros((len(moduli), dim), np.int64)
        for x in _matrices(batches, dim):
            for k, p in enumerate(moduli):
                r = (x % p).astype(np.float64)
                scatter[k] = (scatter[k] + (r.T @ r).astype(np.int64)) % p
                total[k] = (total[k] + r.sum(0).astype(np.int64)) % p
        i, j = np.triu_indices(dim)
        for k in range(len(moduli)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i) + dim, k, np.int32)), pa.array(np.append(i, np.arange(dim)).astype(np.int32)), pa.array(np.append(j, np.full(dim, -1)).astype(np.int32)), pa.array(np.append(scatter[k][i, j], total[k]))], ["k", "i", "j", "r"])

    return points.mapInArrow(of, "k int, i int, j int, r long").groupBy("k", "i", "j").agg(F.sum("r").alias("r"))


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, their exact sums, and of the components, by falling eigenvalue, vectors (columns), eigenvalues, shares of the trace, and how many have a length."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    rank: int
    largest: int
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: longs, or whole numbers of Python where longs don't hold them."""
        if self.n * self.largest + max(map(abs, self.sums)) < LARGEST:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ (self.components[:, : self.rank] / np.sqrt(self.values[: self.rank]))


def _squares(centred: np.ndarray) -> list[int]:
    """The sum of squares of each row, exactly."""
    most = int(np.abs(centred).max(initial=0))
    if centred.shape[1] * most * most < LARGEST:
        return (centred * centred).sum(1).tolist()
    return (centred.astype(object) ** 2).sum(1).tolist()


def _identity_error(points: DataFrame, dim: int, w: Whitening) -> float:
    """The largest entry, by size, of the covariance of the fit list's whitened vectors minus the identity, measured over all of them."""
    if not w.rank:
        return 0.0

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total, scatter = np.zeros(w.rank), np.zeros((w.rank, w.rank))
        for x in _matrices(batches, dim):
            v = w.project(w.centred(x))
            total += v.sum(0)
            scatter += v.T @ v
        i, j = np.triu_indices(w.rank)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, np.arange(w.rank)).astype(np.int32)), pa.array(np.append(j, np.full(w.rank, -1)).astype(np.int32)), pa.array(np.append(scatter[i, j], total))], ["i", "j", "v"])

    got = {(r.i, r.j): r.v / w.n for r in points.mapInArrow(of, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}  # rank^2 rows at most
    return max(abs(v - got[i, -1] * got[j, -1] - (i == j)) for (i, j), v in got.items() if j >= 0)


def fitted(df: DataFrame, embedding: str = "embedding", components: int = 16) -> Whitening | None:
    """The whitening of df's vectors by their first components; None where there is no vector, or only empty ones."""
    points = settled(fit_list(df, embedding), "vectors")
    shape = points.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("width")).orderBy(F.desc("n"), F.desc("dim")).first()
    if shape is None or not shape.dim:
        return None
    dim, n, largest = shape.dim, shape.n, SHIFT + 2 ** (8 * shape.width - 1)
    points, moduli = points.where(F.col("dim") == dim), primes(2 * n * largest * largest)
    got = residues(points, dim, moduli).toPandas()  # d^2 numbers a prime
    whole = prod(moduli)
    sums, scatter = np.zeros(dim, object), np.zeros((dim, dim), object)
    for k, p in enumerate(moduli):
        own = got[got["k"] == k]
        part = own["r"].to_numpy().astype(object) * (whole // p * pow(whole // p, -1, p))
        i, j = own["i"].to_numpy(), own["j"].to_numpy()
        sums[i[j < 0]] += part[j < 0]
        scatter[i[j >= 0], j[j >= 0]] += part[j >= 0]
    sums, scatter = (np.where(2 * (x % whole) > whole, x % whole - whole, x % whole) for x in (sums, scatter))
    scatter = np.triu(scatter) + np.triu(scatter, 1).T
    exact = n * scatter - np.outer(sums, sums)  # n^2 times the covariance
    covariance = (exact / (n * n)).astype(np.float64)
    values, directions = np.linalg.eigh(covariance)
    values, directions = np.maximum(values[::-1], 0.0), directions[:, ::-1]
    rank = int((values[:components] > 4 * dim * np.finfo(float).eps * values[0]).sum())
    trace = float(np.trace(exact) / (n * n))
    values, directions = values[:components], directions[:, :components].copy()
    share = np.where(np.arange(len(values)) < rank, values / (trace or 1.0), 0.0)
    out = Whitening(n, [int(v) for v in sums], directions, values, share, rank, largest)
    return replace(out, identity_error=_identity_error(points, dim, out))


WHITE = T.StructType([T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.DecimalType(38, 0))])


def transformed(df: DataFrame, w: Whitening | None, embedding: str = "embedding") -> DataFrame:
    """df with whitened, an entry a component, and deviation, the exact sum over dimensions of (n x - sum)^2 (null from 10^38 on); both null where a row has no result."""
    df = df.drop("whitened", "deviation")
    if w is None:
        return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in WHITE})
    dim, more = len(w.sums), len(w.values) - w.rank

    @F.arrow_udf(WHITE)
    def white(x: pa.Array) -> pa.Array:
        forget()
        out, squares = [None] * len(x), [None] * len(x)
        for at, v in vectors(x):
            if v.shape[1] != dim or not len(at):
                continue
            centred = w.centred(v)
            projected = w.project(centred).tolist()
            for i, row, square in zip(at.tolist(), projected, _squares(centred)):
                out[i] = row + [None] * more
                squares[i] = Decimal(square) if square < 10**38 else None
        return pa.StructArray.from_arrays([pa.array(out, pa.list_(pa.float64())), pa.array(squares, pa.decimal128(38, 0))], ["whitened", "deviation"])

    (c,) = unused(df, "c")
    return df.withColumn(c, white(F.col(embedding))).withColumns({f: F.col(f"{c}.{f}") for f in WHITE.names}).drop(c)


def components(rows: DataFrame, embedding: str = "embedding", id_: str = "vec_id", most: int = 16) -> DataFrame:
    """A row for each vector with a result and component: id, component from 1, n, deviation as a long (null where no long holds it), whitened, explained and identity_error."""
    w = fitted(rows, embedding, most)
    of = lambda v: F.array(*map(F.lit, v)) if len(v) else F.array().cast("array<double>")
    out = transformed(rows.select(id_, embedding), w, embedding).where("whitened IS NOT NULL")
    out = out.select(id_, "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select(
        id_, (F.col("place") + 1).cast("int").alias("component"), F.lit(w.n if w else 0).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"),
        "whitened", F.get(of(w.explained.tolist() if w else []), F.col("place")).alias("explained"), F.lit(w.identity_error if w else 0.0).alias("identity_error"),
    )
