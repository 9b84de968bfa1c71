"""Line dedup: lines that many documents share, found with two Bloom filters and confirmed by exact counts.

Each task sets a line's bits in a filter of lines seen once and, if they were all set, in a filter of lines seen twice.
Two tasks' filters become one by ``once = a | b`` and ``twice = twice_a | twice_b | (a & b)``, segment by segment: no line
that two documents hold is missed, in one task or in two. Only lines that the second filter knows are suspects. They are
counted in documents within each task first, then shuffled as 128-bit digests and counts; what is counted often enough
is confirmed. The filters have a fixed size, whatever the input: the more lines, the more suspects are wrong ones that
the exact count clears again; past some hundred million lines nearly all lines are shuffled as digests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import BITS, SEGMENT_BITS, Bits, pack, unpack
from .common import forget, keep, raw_texts

#: Suspects that a task counts before it passes the counts on, and rows of a batch.
FLUSH, BATCH = 100_000, 1000
#: Confirmed lines whose digests (16 bytes each) every task may hold; beyond, decisions are joined to the documents.
BROADCAST_LINES = 1 << 20


def keys(raw: bytes) -> list[bytes]:
    """The key of each line: stripped of ASCII white space, A-Z lower-cased."""
    return [x.strip() for x in raw.lower().split(b"\n")]


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in found), np.uint64, len(found))


def _filters(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bits(bits), Bits(bits)
        for batch in batches:
            for texts in (batch.column(0).slice(i, BATCH) for i in range(0, batch.num_rows, BATCH)):
                found = [h for raw in raw_texts(texts) if len(h := hashes(list({k for k in keys(raw) if k})))]
                if found:
                    h, n = np.unique(np.concatenate(found), return_counts=True)
                    twice.add(h[once.holds(h) | (n > 1)])
                    once.add(h)
        parts = once.parts(), twice.parts()
        used = np.flatnonzero(parts[0].any(axis=1))
        for some in (used[i : i + 64] for i in range(0, len(used), 64)):
            packed = [pa.array([pack(p[i]) for i in some], pa.binary()) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *packed], ["segment", "once", "twice"])

    return run


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once, twice = np.zeros(SEGMENT_BITS // 8, np.uint8), np.zeros(SEGMENT_BITS // 8, np.uint8)
    for batch in batches:
        for a, b in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True):
            a, b = unpack(a), unpack(b)
            twice |= b | (once & a)
            once |= a
    if twice.any():
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([pack(twice)], pa.binary())], ["segment", "twice"])


def _suspects(twice, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Digests of suspected lines with the documents of this task that hold them, and the first place of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = Bits.of(twice.value, bits), pa.null()
        held: dict[bytes, list] = {}  # documents, and the first place: whether the id is null, id, line

        def rows() -> pa.RecordBatch:
            docs, first = zip(*held.values(), strict=True)
            columns = docs, *list(zip(*first, strict=True))[1:]
            out = [pa.array(list(held), pa.binary()), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), kind, pa.int64()), strict=True))]
            held.clear()
            return pa.RecordBatch.from_arrays(out, ["digest", "docs", "first_id", "first_line"])

        for batch in batches:
            ids, kind = batch.column(0), batch.column(0).type
            for at in range(0, batch.num_rows, BATCH):
                for doc, raw in zip(ids.slice(at, BATCH).to_pylist(), raw_texts(batch.column(1).slice(at, BATCH)), strict=True):
                    first: dict[bytes, int] = {}
                    for i, k in enumerate(keys(raw)):
                        if k:
                            first.setdefault(k, i)
                    found = list(first)
                    for j in np.flatnonzero(known.holds(hashes(found))):
                        place = (doc is None, doc, first[found[j]])
                        seen = held.setdefault(digest(found[j]), [0, place])
                        seen[0] += 1
                        seen[1] = min(seen[1], place)
                    if len(held) >= FLUSH:
                        yield rows()
        if held:
            yield rows()

    return run


def _kept(raw: bytes, gone: set[int]) -> tuple[bytes, int, int]:
    lines = raw.split(b"\n")
    return (b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else raw), len(lines), len(gone)


def _result(batch: pa.RecordBatch, decided: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    texts, n, dropped = zip(*decided, strict=True) if decided else ((), (), ())
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])


def _drop_known(twice, bits: int, confirmed, keep_first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Drop the lines whose digest is confirmed; ``confirmed`` has sorted digests and the first place of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (digests, firsts) = Bits.of(twice.value, bits), confirmed.value
        for big in batches:
            for batch in (big.slice(i, BATCH) for i in range(0, big.num_rows, BATCH)):
                decided = []
                for doc, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                    found = keys(raw)
                    maybe = [i for i in np.flatnonzero(known.holds(hashes(found))) if found[i]] if len(digests) else []
                    d = np.array([digest(found[i]) for i in maybe], "S16")
                    at = np.minimum(np.searchsorted(digests, d), max(len(digests) - 1, 0))
                    hit = digests[at] == d if maybe else []
                    decided.append(_kept(raw, {int(i) for i, j, h in zip(maybe, at, hit, strict=True) if h and not (keep_first and firsts[j] == (doc, int(i)))}))
                yield _result(batch, decided)

    return run


def _places(twice, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Row, line and digest of every suspected line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bits.of(twice.value, bits)
        for big in batches:
            for batch in (big.slice(i, BATCH) for i in range(0, big.num_rows, BATCH)):
                out = []
                for j, raw in enumerate(raw_texts(batch.column(1))):
                    found = keys(raw)
                    out += [(j, int(i), digest(found[i])) for i in np.flatnonzero(known.holds(hashes(found))) if found[i]]
                rows, lines, digests = zip(*out, strict=True) if out else ((), (), ())
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(lines, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "row", "line", "digest"])

    return run


def _drop_named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _result(batch, [_kept(raw, set(gone or ())) for raw, gone in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True)])


def repeated_lines(docs: DataFrame, *, min_docs: int = 10, bits: int = BITS) -> tuple[DataFrame, object]:
    """Digests of the keys that stand in at least ``min_docs`` rows, with their rows and first place; and the filter."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    parts = docs.select("text").mapInArrow(_filters(bits), "segment int, once binary, twice binary")
    merged = parts.groupBy("segment").applyInArrow(_merge, "segment int, twice binary")
    twice = spark.sparkContext.broadcast([(r["segment"], bytes(r["twice"])) for r in merged.collect()])  # at most bits / 8 bytes
    counted = docs.select("doc_id", "text").mapInArrow(_suspects(twice, bits), f"digest binary, docs long, first_id {kind}, first_line long")
    place = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "first_line"))
    exact = counted.groupBy("digest").agg(F.sum("docs").alias("docs"), place.alias("p")).filter(F.col("docs") >= min_docs)
    return keep(exact.select("digest", "docs", "p.first_id", "p.first_line"), "lines-repeated"), twice


def line_dedup(docs: DataFrame, *, min_docs: int = 10, keep_first: bool = False, bits: int = BITS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """Documents without the lines whose key stands in at least ``min_docs`` of them: doc_id, text, n_lines, n_dropped.

    A line's key is the line stripped of ASCII white space at both ends, with A-Z lower-cased; empty keys never count.
    Every line with such a key goes, in every document; with ``keep_first`` the first stays, that of the least
    doc_id (null last) and in it the highest. Other lines stay as they are, joined by \\n. ``n_lines`` counts before.

    A null text is an empty one, and has one empty line. Each row is a document, also where ids or rows repeat; with
    ``keep_first`` rows that share the least id all keep the line. Texts of any length are taken whole; columns other
    than doc_id and text are left out. An empty table gives an empty table.
    """
    if min_docs < 2:
        raise ValueError("the filters tell lines of two documents or more")
    spark: SparkSession = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    repeated, twice = repeated_lines(rows, min_docs=min_docs, bits=bits)
    result = f"doc_id {kind}, text string, n_lines long, n_dropped long"
    if repeated.count() <= broadcast_lines:
        found = sorted((bytes(r["digest"]), (r["first_id"], r["first_line"])) for r in repeated.collect())  # as counted
        forget(repeated)
        confirmed = spark.sparkContext.broadcast((np.array([d for d, _ in found], "S16"), [p for _, p in found] if keep_first else []))
        return rows.mapInArrow(_drop_known(twice, bits, confirmed, keep_first), result)
    # A row is known by a digest of id and text: rows that agree in both lose the same lines.
    named = rows.withColumn("row", F.sha2(F.concat_ws("\x00", F.col("doc_id").cast("string"), F.col("doc_id").isNull().cast("string"), "text"), 256))
    places = named.mapInArrow(_places(twice, bits), f"doc_id {kind}, row string, line long, digest binary")
    gone = places.join(repeated, "digest")
    if keep_first:
        gone = gone.filter(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("line") == F.col("first_line"))))
    gone = gone.groupBy("row").agg(F.collect_set("line").alias("gone"))
    return named.join(gone, "row", "left").select("doc_id", "text", "gone").mapInArrow(_drop_named, result)
