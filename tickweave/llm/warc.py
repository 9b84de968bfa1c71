"""Deterministic sharded WARC writer, and its reader.

Rows are range-sorted by id and each range is one task, which compresses each record (regenerated headers with digests,
and the payload) as a gzip member of its own, appends it to files and rolls to the next file by compressed size. A file is written under a temporary name, closed, and renamed to a name
that only depends on its range and number; the task returns a line of the manifest for it. The manifest is written
last, so an archive without one is unfinished, and a reader opens only the files that it lists. A task that runs again
writes the same bytes under the same names.

Files are opened through pyarrow's file systems, by the URI of the folder: it can be any that driver and executors
share. Copies of a payload are found by digest: the row with the largest id is the response, the others revisit it.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, keep, small

#: A file is closed once it holds so many compressed bytes.
ROLL_BYTES = 16 << 20
#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 1000
#: Records of an average range.
RANGE_RECORDS = 20_000
BROADCAST_ROWS = 500_000
READ_BYTES = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _stamp(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _line(value: str | None) -> str:
    """A header value: line breaks and other controls would end it, so they are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value or "")


def _value(line: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), line)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, seconds: int = 0) -> bytes:
    """The compressed bytes of one record. The same row always gives the same bytes."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Date: {_stamp(seconds)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    plain = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(plain) + squeeze.flush()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, payloads, digests, refers = (batch.column(i).to_pylist() for i in range(5))
        made = [record(p, u, x, d, r) for p, u, x, d, r in zip(ids, urls, payloads, digests, refers, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])


def _writer(folder: str, roll: int):
    """Appends the records of a range to files; gives a manifest row for each closed file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = _folder(folder)
        part, number, out, temporary, size, count, digest = TaskContext.get().partitionId(), 0, None, "", 0, 0, hashlib.sha256()
        done: list[tuple] = []

        def commit() -> None:
            nonlocal out
            out.close()
            name = f"part-{part:06d}-{number:05d}.warc.gz"
            system.move(temporary, f"{base}/{name}")
            done.append((name, part, number, count, size, digest.hexdigest()))
            out = None

        for batch in batches:
            for made in batch.column(0).to_pylist():
                if out is None:
                    temporary = f"{base}/_temporary-{part:06d}-{number:05d}-{uuid.uuid4().hex}"
                    out, size, count, digest = system.open_output_stream(temporary), 0, 0, hashlib.sha256()
                out.write(made)
                digest.update(made)
                size, count = size + len(made), count + 1
                if size >= roll:
                    commit()
                    number += 1
        if out is not None:
            commit()
        columns = list(zip(*done, strict=True)) or [[]] * 6
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        names = ["file", "part", "number", "records", "bytes", "sha256"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def write_warc(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record for each row and return the manifest: file, part, number, records, bytes, sha256.

    ``folder`` is a URI that driver and executors share. Payloads are UTF-8, null is empty. Of rows with equal payloads
    of at least LEAST_REVISIT bytes the largest id is the response (all rows that have it, if it repeats); rows with a
    null id are responses. An empty table writes no file and an empty manifest. Null URLs are written empty. Other
    columns are not read.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = keep(rows.filter((F.octet_length("payload") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest").distinct(), "warc-digests")
    first = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Copies that revisit another row, by row and digest: the two together name a record also where ids repeat.
    copies = keep(long.join(first, "digest").filter("page_id <> refers_to"), "warc-copies")
    forget(long)
    rows = rows.join(small(copies, BROADCAST_ROWS), ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")
    # Ranges are sampled from plain rows, and records are compressed once, where they are written.
    ranges = max(1, -(-pages.count() // RANGE_RECORDS))
    placed = rows.repartitionByRange(ranges, "page_id", "url").sortWithinPartitions("page_id", "url", "digest").mapInArrow(_records, "record binary")
    system, base = _folder(folder)
    system.create_dir(base, recursive=True)
    kinds = "file string, part int, number int, records long, bytes long, sha256 string"
    placed.mapInArrow(_writer(folder, roll_bytes), kinds).write.mode("overwrite").parquet(f"{folder}/_manifest")
    forget(copies)
    return pages.sparkSession.read.schema(kinds).parquet(f"{folder}/_manifest")


class _Stream(io.RawIOBase):
    """A readable view of an Arrow stream for gzip."""

    def __init__(self, source) -> None:
        self.source = source

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        got = self.source.read(len(b))
        b[: len(got)] = got
        return len(got)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip stream."""
    plain = io.BufferedReader(gzip.GzipFile(fileobj=io.BufferedReader(_Stream(stream), READ_BYTES)), READ_BYTES)
    while start := plain.readline():
        if start != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {start[:40]!r}")
        head: dict[str, str] = {}
        while (line := plain.readline()) != b"\r\n":
            name, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
            head[name] = value
        block = plain.read(int(head["Content-Length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its header says")
        yield head, block


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for head, block in read_records(stream):
                        if hashlib.sha1(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"{name}: a block differs from its digest")
                        body = block.partition(b"\r\n\r\n")[2]
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload differs from its digest")
                        page, other = head["X-Page-Id"], head.get("X-Refers-To-Page")
                        rows.append((int(page) if page else None, _value(head["WARC-Target-URI"]), int(head["X-Payload-Length"]), digest, kind, int(other) if other else None))
                        if len(rows) >= 5000:
                            yield _as_batch(rows)
                            rows = []
                yield _as_batch(rows)

    return run


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the files in the manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Files are streamed, one task each at a time. Digests of blocks and payloads are checked; a record that differs
    from its own ends the read with an error.
    """
    manifest = spark.read.parquet(f"{folder}/_manifest").select("file")
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.repartition(max(1, min(manifest.count(), 10_000)), "file").mapInArrow(_reader(folder), kinds)
