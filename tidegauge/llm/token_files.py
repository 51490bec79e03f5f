"""Operator 5, token ids in binary files: ids by falling frequency, one to four bytes each, lengths in control bytes apart.

A file holds the texts of a range of doc_id in order. Little-endian, one after the other:

    magic  8 bytes  b"TGIDS\\x01\\0\\0"
    n      u64      texts in this file; ids in total: u64; bytes of data: u64
    doc_id n x i64  (absent ids: the smallest i64), then ids of each text: n x u32
    control         for all ids of the file, in fours: a byte of four 2-bit fields, lowest first, bytes of an id less one
    data            the bytes of each id's rank, lowest first

The ranks (the most frequent id has rank 0; ties: the smaller id) are a Parquet table beside the files, as is the list of
files. Texts are tokenised once, after they were ranged by doc_id; their ids wait, packed, in a table that also has each
part's count of every id, until all counts are known. Files are written whole under a name of their own and then renamed, so a task that runs
again after its executor was lost leaves the same files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TEXTS_AT_ONCE, scratch, settled
from .public_vocab import default_path, word_ids

MAGIC = b"TGIDS\x01\0\0"
NO_ID = -(1 << 63)
#: Ids in a file, about; a file may pass it by one text.
FILE_IDS = 2_000_000

#: For each control byte: the lengths of its four ids.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


class TokenFiles(NamedTuple):
    """Where ids were written: data holds the files, ranks and files are Parquet tables."""

    data: str
    ranks: str
    files: str


def encode_stream(rank: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) for unsigned 32-bit ranks."""
    rank = rank.astype("<u4")
    size = np.ones(len(rank), np.uint8)
    for most in (0xFF, 0xFFFF, 0xFFFFFF):
        size += rank > most
    four = np.zeros(-(-len(rank) // 4) * 4, np.uint8)
    four[: len(rank)] = size - 1
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = rank.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_stream(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    start = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        out[longer] |= raw[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack(docs: bytes, counts: bytes, ranks: np.ndarray) -> bytes:
    """A file of the little-endian doc_ids and numbers of ids of its texts, and all their ranks."""
    control, data = encode_stream(ranks)
    return b"".join([MAGIC, struct.pack("<QQQ", len(docs) // 8, len(ranks), len(data)), docs, counts, control, data])


def unpack(file: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, ids of each text, ranks) of a file."""
    if file[:8] != MAGIC:
        raise ValueError("not a token file")
    n, total, size = struct.unpack_from("<QQQ", file, 8)
    at = 32
    ids = np.frombuffer(file, "<i8", n, at)
    counts = np.frombuffer(file, "<u4", n, at := at + 8 * n)
    control = file[(at := at + 4 * n) : (at := at + -(-total // 4))]
    if len(file) != at + size:
        raise ValueError("a token file has another length than its head says")
    return ids, counts.astype(np.int64), decode_stream(control, file[at:], total)


def _open(uri: str):
    """A file system and a path in it, for a folder that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_whole(folder: str, name: str, data: bytes) -> None:
    """data as one file, visible under its name only when whole."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/_part-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, f"{path}/{name}")


def read_whole(folder: str, name: str) -> bytes:
    system, path = _open(folder)
    with system.open_input_stream(f"{path}/{name}", compression=None) as f:
        return f.read()


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in b.column("_text").to_pylist()]


def _encoded(path: str, texts: list[bytes], end: bytes) -> Iterator[bytes]:
    ids = word_ids(path)
    for at in range(0, len(texts), 500):
        own = [ids.words(t) for t in texts[at : at + 500]]
        ids.fill(set().union(*own))
        for w in own:
            yield b"".join(map(ids.__getitem__, w)) + end


def _parts(batches: Iterator[pa.RecordBatch], path: str, end_id: int, file_ids: int) -> Iterator[pa.RecordBatch]:
    """From rows (_id, _text) in order: a row for each file to be, with its ids, packed, and how often it has each."""
    ids, shard, made = word_ids(path), TaskContext.get().partitionId(), 0
    end = np.array([end_id], ids.dtype).tobytes()
    docs, counts, held, n = [], [], [], 0

    def close() -> pa.RecordBatch:
        nonlocal docs, counts, held, n, made
        raw = b"".join(held)
        times = np.bincount(np.frombuffer(raw, ids.dtype))
        used = np.flatnonzero(times)
        row = {"name": f"{shard:06d}-{made:06d}.ids", "n_docs": len(docs), "n_ids": n, "docs": np.array([NO_ID if d is None else d for d in docs], "<i8").tobytes(), "counts": np.array(counts, "<u4").tobytes(), "packed": zstandard.compress(raw, 1), "used": used, "times": times[used]}
        docs, counts, held, n, made = [], [], [], 0, made + 1
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row.values(), _PARTS)], schema=_PARTS)

    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            for d, e in zip(part.column("_id").to_pylist(), _encoded(path, _texts(part), end)):
                docs.append(d)
                counts.append(len(e) // ids.dtype.itemsize)
                held.append(e)
                n += counts[-1]
                if n >= file_ids:
                    yield close()
    if docs:
        yield close()


_PARTS = pa.schema({"name": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64(), "docs": pa.binary(), "counts": pa.binary(), "packed": pa.binary(), "used": pa.list_(pa.int64()), "times": pa.list_(pa.int64())})


def _ranks(parts: DataFrame, size: int) -> np.ndarray:
    """Rank of each id by how often parts have it; what is collected is one row an id of the vocabulary."""
    n = np.zeros(size, np.int64)
    for r in parts.select(F.explode(F.arrays_zip("used", "times")).alias("x")).groupBy(F.col("x.used").alias("id")).agg(F.sum("x.times").alias("n")).collect():
        n[r.id] = r.n
    rank = np.empty(size, np.uint32)
    rank[np.lexsort((np.arange(size), -n))] = np.arange(size)
    return rank


def write_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, path: str | None = None, end_id: int = 1, folder: str | None = None, shards: int | None = None, file_ids: int = FILE_IDS) -> TokenFiles:
    """Every text's ids and end_id, as files in ascending order of doc_id under folder (one in the shared folder by default).

    Null texts are empty: end_id alone. Texts of one doc_id stand in the order of a hash of them, so that an id that
    repeats a million times is dealt out to several tasks; absent doc_ids come first. Other columns aren't read. A text is never cut; a very long one has a file of its own. An empty table writes no file.
    """
    spark, path = docs.sparkSession, path or default_path("word_bpe_49k.json")
    folder = folder or scratch(spark, "token-files")
    out = TokenFiles(f"{folder}/data", f"{folder}/ranks", f"{folder}/files")
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text"))
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    ranged = rows.repartitionByRange(n, "_id", "_hash").sortWithinPartitions("_id", "_hash", "_text").drop("_hash")
    parts = settled(ranged.mapInArrow(lambda b: _parts(b, path, end_id, file_ids), "name string, n_docs bigint, n_ids bigint, docs binary, counts binary, packed binary, used array<bigint>, times array<bigint>"), "token-parts", TEXTS_AT_ONCE)
    ids = word_ids(path)
    rank = _ranks(parts, max(ids.tokenizer.get_vocab_size(), end_id + 1))
    spark.createDataFrame(pa.table({"id": np.arange(len(rank)), "rank": rank.astype(np.int64)})).coalesce(1).write.parquet(out.ranks)
    sent, data, kind = spark.sparkContext.broadcast(rank), out.data, ids.dtype

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, _, n, own, counts, packed = (c[i].as_py() for c in b.columns)
                every = np.frombuffer(zstandard.decompress(packed, n * kind.itemsize), kind)
                write_whole(data, name, pack(own, counts, sent.value[every]))
            yield b.select(["name", "n_docs", "n_ids"])

    parts.select("name", "n_docs", "n_ids", "docs", "counts", "packed").mapInArrow(written, "name string, n_docs bigint, n_ids bigint").write.parquet(out.files)
    return out


def read_tokens(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start (ids of all texts before), n_tokens and ids (little-endian u32, binary) of every text in files."""
    listed = spark.read.schema("name string, n_docs bigint, n_ids bigint").parquet(files.files)
    # A name begins with its task's number: sums within tasks, then of the tasks before.
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = listed.withColumn("task", F.split_part("name", F.lit("-"), F.lit(1)))
    tasks = listed.groupBy("task").agg(F.sum("n_ids").alias("n")).select("task", earlier(Window.orderBy("task"), "n").alias("tasks_before"))
    within = listed.withColumn("within", earlier(Window.partitionBy("task").orderBy("name"), "n_ids"))
    listed = within.join(tasks, "task").withColumn("before", F.col("tasks_before") + F.col("within"))
    if not listed.take(1):
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids binary")
    order = spark.read.parquet(files.ranks)
    by_rank = np.zeros(order.count(), "<u4")
    for r in order.collect():  # one row an id of the vocabulary
        by_rank[r.rank] = r.id
    ids = spark.sparkContext.broadcast(by_rank)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs, n, rank = unpack(read_whole(files.data, name))
                raw, stop = ids.value[rank].tobytes(), np.cumsum(n)
                for at in range(0, len(docs), 2000):
                    part = slice(at, at + 2000)
                    own = [raw[4 * (s - k) : 4 * s] for s, k in zip(stop[part].tolist(), n[part].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[part], mask=docs[part] == NO_ID), pa.array(start + stop[part] - n[part]), pa.array(n[part]), pa.array(own, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return listed.select("name", "before").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(decoded, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_index(rows: DataFrame) -> DataFrame:
    """rows of read_tokens() with ids_crc32, the unsigned CRC-32 of the ids, in place of ids."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
