"""Helpers that the corpus operators share: shared scratch tables, checked broadcasts and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as code points (space, and tab to carriage return).
SPACE_CHARS = "\x20\x09-\x0d"
#: Words are the longest runs of anything else.
WORD_PATTERN = f"[^{SPACE_CHARS}]+"
#: Text is hashed in pieces of about so many bytes, which bounds the memory of one task.
PIECE_BYTES = 1 << 18

#: Rows and bytes of an Arrow batch while a table is written: whole texts and sets are long, and JVM and worker hold
#: batches outside the heap. Only a single row may be longer.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rows that a task decodes of a Parquet file at a time: of whole texts Spark's 4096 are tens of megabytes in one array.
READ_ROWS = 512

_fallback: dict[str, str] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder that driver and executors share (``spark.checkpoint.dir``).

    Where that setting is absent, a local session uses a temporary folder; on a cluster that is an error, as executors
    would write to disks of their own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _fallback.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tickweave-"))
    return f"{base.rstrip('/')}/tickweave/{label}-{uuid.uuid4().hex}"


#: Settings that bound what a task holds of long rows at a time; no result depends on them.
_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS)}
#: Settings of the session while a table is written; shuffle files go as soon as the table stands.
_WRITING = _BOUNDS | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def bounded(spark: SparkSession) -> None:
    """Let the session hold as little of long rows at a time as ``keep`` does, for results that someone else writes."""
    for key, value in _BOUNDS.items():
        spark.conf.set(key, value)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts the lineage and survives lost executors."""
    path, conf = shared_path(df.sparkSession, label), df.sparkSession.conf
    before = {key: conf.get(key) for key in _WRITING}
    try:
        for key, value in _WRITING.items():
            conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            conf.set(key, value)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    vars(kept)["kept_at"] = path
    return kept


def forget(*tables: DataFrame | None) -> None:
    """Delete kept tables that nothing reads any more; anything else is left alone."""
    for table in tables:
        path = table is not None and vars(table).pop("kept_at", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of a table that may be broadcast, as its rows' JSON.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if the table has at most ``rows`` rows and BROADCAST_BYTES bytes; else it is joined by a shuffle.

    Both are counted, so the table should be a kept one.
    """
    n, size = df.limit(rows + 1).agg(F.count("*"), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def learnable(doc_id: str = "doc_id") -> F.Column:
    """Rows that a model may learn from: crc32 of the id's decimal text leaves another remainder than 2 by 4."""
    return F.col(doc_id).isNotNull() & (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class WordHasher:
    """64-bit hashes of the words of many texts at once.

    A word is hashed as a polynomial over its bytes, taken from running sums, so that no word becomes a Python object.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        n = PIECE_BYTES + 4096
        self.table = stream64(256, 7)
        self._grow(n)

    def _grow(self, n: int) -> None:
        inverse = pow(self.BASE, -1, 1 << 64)
        self.power = np.cumprod(np.full(n, self.BASE, np.uint64))
        self.back = np.cumprod(np.full(n, inverse, np.uint64))

    def piece(self, raw: bytes) -> np.ndarray:
        """Hashes of the words of bytes that end in white space."""
        a = np.frombuffer(raw.lower(), np.uint8)
        if len(a) > len(self.power):
            self._grow(len(a))
        solid = (a != 32) & ((a < 9) | (a > 13))
        edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0)))
        starts, ends = edge[::2], edge[1::2]
        sums = np.empty(len(a) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.table[a] * self.power[: len(a)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))

    def words(self, raw: bytes) -> np.ndarray:
        """Hashes of the words of one text, in order, A-Z taken as a-z."""
        if len(raw) <= PIECE_BYTES:
            return self.piece(raw + b"\n")
        out, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + PIECE_BYTES)
            while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
                end += 1
            out.append(self.piece(raw[at:end] + b"\n"))
            at = end
        return np.concatenate(out)

    def many(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Word hashes of each text; short texts share one pass over their bytes."""
        held: list[bytes] = []
        size = 0

        def flush() -> Iterator[np.ndarray]:
            if not held:
                return
            got = self.piece(b"\n".join(held) + b"\n")
            a = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
            solid = (a != 32) & ((a < 9) | (a > 13))
            starts = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0)) == 1)
            bounds = np.cumsum([0] + [len(x) + 1 for x in held])
            cut = np.searchsorted(starts, bounds)
            for i in range(len(held)):
                yield got[cut[i] : cut[i + 1]]

        for raw in texts:
            if len(raw) > PIECE_BYTES // 2:
                yield from flush()
                held, size = [], 0
                yield self.words(raw)
                continue
            held.append(raw)
            size += len(raw) + 1
            if size >= PIECE_BYTES // 2:
                yield from flush()
                held, size = [], 0
        yield from flush()


_hasher: list[WordHasher] = []


def hasher() -> WordHasher:
    if not _hasher:
        _hasher.append(WordHasher())
    return _hasher[0]


SHINGLE_WEIGHTS = stream64(64, 99) | np.uint64(1)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    total = words[: n - k + 1] * SHINGLE_WEIGHTS[0]
    for i in range(1, k):
        total = total + words[i : n - k + 1 + i] * SHINGLE_WEIGHTS[i]
    return np.unique(mix64(total + np.uint64(k)))


def raw_texts(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, nulls as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
