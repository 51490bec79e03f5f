"""Operator 6, WARC: one gzip member a record, written by Spark tasks and read back in sequence.

The reader inflates a member piece by piece, cuts the record by its Content-Length, and checks block and payload digests
before it hands the record on. Equal payloads are found by digest; all but one of them are written as revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, scratch
from .token_files import _open, write_whole

#: Bytes of a payload from which an equal one is a revisit; bytes of records in a file, about.
REVISIT_BYTES, FILE_BYTES, PIECE = 1000, 32_000_000, 65_536
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Record(NamedTuple):
    headers: dict[str, str]
    http: bytes
    payload: bytes


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, revisits: int | None = None, is_revisit: bool = False) -> bytes:
    """One response or revisit record as a gzip member. A revisit keeps the HTTP head, which tells the payload's length, and leaves out the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    headers = {"WARC-Type": "revisit" if is_revisit else "response", "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>", "WARC-Date": DATE, "WARC-Payload-Digest": base32_sha1(payload), "WARC-Block-Digest": base32_sha1(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    if url:
        headers["WARC-Target-URI"] = url.replace("\r", "").replace("\n", "")
    if is_revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{'' if revisits is None else revisits}>"}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after the other."""
    z, out, raw = zlib.decompressobj(31), [], b""
    while True:
        raw = raw or stream.read(PIECE)
        if not raw:
            if out:
                raise ValueError("a gzip member breaks off")
            return
        out.append(z.decompress(raw))
        raw = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []


def records(stream: BinaryIO) -> Iterator[Record]:
    """The records of a WARC stream; ValueError where framing or a digest is wrong."""
    for member in members(stream):
        head, gap, rest = member.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not gap or not lines[0].startswith("WARC/1."):
            raise ValueError("a record has no WARC head")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        if rest[size:] != b"\r\n\r\n":
            raise ValueError("a record's length differs from its Content-Length")
        block = rest[:size]
        if headers.get("WARC-Block-Digest", base32_sha1(block)) != base32_sha1(block):
            raise ValueError("a block differs from its digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        if headers["WARC-Type"] == "response" and headers.get("WARC-Payload-Digest", base32_sha1(payload)) != base32_sha1(payload):
            raise ValueError("a payload differs from its digest")
        yield Record(headers, http, payload)


def write_warc(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", *, folder: str | None = None, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> str:
    """A record for each row of pages, in .warc.gz files under the folder that is returned.

    Null html is an empty payload; null url leaves out the target. Of rows with equal payloads of revisit_bytes or more,
    the largest page_id is the response and rows of other ids revisit it; if that id repeats with the same payload,
    each of its rows is a response. Null ids are written with an empty number, and revisit the largest id, if any. Other
    columns aren't read; an empty table writes no file. A file's name has the attempt of the task that wrote it, and the
    list of files has those of the attempts that Spark took, so a task that runs again changes nothing.
    """
    spark = pages.sparkSession
    out = folder or scratch(spark, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.encode(F.col(html).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    large = F.octet_length("payload") >= revisit_bytes
    rows = rows.withColumn("digest", F.when(large, F.sha1("payload")))
    groups = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    n = rows.count()
    rows = lookup(rows, groups, "digest", "n", F.monotonically_increasing_id(), n)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, parts, held, done = TaskContext.get(), [], 0, []

        def close() -> None:
            nonlocal parts, held
            name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):06d}.warc.gz"
            write_whole(out, name, b"".join(parts))
            done.append((name, len(parts)))
            parts, held = [], 0

        for b in batches:
            for i in range(b.num_rows):
                page, address, payload, first = (b.column(k)[i].as_py() for k in range(4))
                parts.append(record(page, address, payload, first, first is not None and first != page))
                held += len(parts[-1])
                if held >= file_bytes:
                    close()
        if parts:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["name", "records"])

    rows.select("page_id", "url", "payload", "first").mapInArrow(written, "name string, records bigint").write.parquet(f"{out}/files")
    return out


def _number(uri: str) -> int | None:
    return int(n) if (n := uri.removeprefix("<urn:page:").removesuffix(">")) else None


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits) of each record in write_warc()'s folder."""
    files = spark.read.schema("name string, records bigint").parquet(f"{folder}/files")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        for b in batches:
            for name, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                with system.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for r in records(f):
                        h, revisit = r.headers, r.headers["WARC-Type"] == "revisit"
                        size = int(dict(x.lower().split(b": ", 1) for x in r.http.split(b"\r\n")[1:])[b"content-length"])
                        if not revisit and size != len(r.payload):
                            raise ValueError("a payload's length differs from the HTTP Content-Length")
                        rows.append((_number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), size, base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), h["WARC-Type"], _number(h["WARC-Refers-To"]) if revisit else None, None if revisit else r.payload))
                        n -= 1
                        if len(rows) >= 500:
                            yield _batch(rows)
                            rows = []
                if n:
                    raise ValueError(f"{name} has {-n} records more than were written")
                if rows:
                    yield _batch(rows)

    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


_FIELDS = pa.schema({"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()})


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FIELDS)], schema=_FIELDS)
