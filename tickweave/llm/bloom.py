"""Bloom filters of a fixed size in segments, which tasks build apart and the driver passes on whole."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: the driver and each task hold an eighth of that in bytes, 16 MB.
BITS = 1 << 27
#: The three bits of a hash lie in one segment of so many bits.
SEGMENT_BITS = 1 << 18


class Bits:
    """A filter: a hash names a segment by its upper ten bits and three bits of it by its other ones."""

    def __init__(self, bits: int = BITS) -> None:
        self.raw = np.zeros(bits // 8, np.uint8)
        self.segments = np.uint64(bits // SEGMENT_BITS)

    def _places(self, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        base = ((h >> np.uint64(54)) % self.segments) * np.uint64(SEGMENT_BITS // 8)
        bits = [(h >> np.uint64(s)) & np.uint64(SEGMENT_BITS - 1) for s in (0, 18, 36)]
        return [((base + (b >> np.uint64(3))).astype(np.int64), np.uint8(1) << (b & np.uint64(7)).astype(np.uint8)) for b in bits]

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at, bit in self._places(h):
            out &= (self.raw[at] & bit) != 0
        return out

    def add(self, h: np.ndarray) -> None:
        for at, bit in self._places(h):
            np.bitwise_or.at(self.raw, at, bit)

    def parts(self) -> np.ndarray:
        """A row of bytes for each segment."""
        return self.raw.reshape(-1, SEGMENT_BITS // 8)

    @classmethod
    def of(cls, segments: Iterable[tuple[int, bytes]], bits: int = BITS) -> Bits:
        out = cls(bits)
        for i, packed in segments:
            out.parts()[i] = unpack(packed)
        return out


def pack(segment: np.ndarray) -> bytes:
    return zlib.compress(segment.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _segment(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = Bits(SEGMENT_BITS)  # with one segment, all hashes are of it
    for batch in batches:
        one.add(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([pack(one.raw)], pa.binary())], ["segment", "packed"])


def filter_of(hashes: DataFrame, bits: int = BITS) -> list[tuple[int, bytes]]:
    """The segments of a filter of the 64-bit hashes in column ``h``; at most ``bits / 8`` bytes reach the driver."""
    segment = F.pmod(F.shiftrightunsigned("h", 54), F.lit(bits // SEGMENT_BITS)).cast("int").alias("segment")
    made = hashes.select(segment, "h").groupBy("segment").applyInArrow(_segment, "segment int, packed binary")
    return [(r["segment"], bytes(r["packed"])) for r in made.collect()]
