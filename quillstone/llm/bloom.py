"""Bloom filters over a whole DataFrame: of hashes seen once, where they meet, and of given hashes, for all tasks.

repeated() deals hashes, 8 bytes each, to tasks by value; each task keeps a once-seen filter that grows
with its share and passes on the hashes that it has seen before. Nothing of this is broadcast, and more
partitions make smaller filters. build() makes one filter of given hashes, of a fixed number of bits, for
all tasks to test with. Hashes that belong into a filter always test positive; others do by chance.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^29 bits: 64 MB to broadcast.
MAX_BITS = 1 << 29
MIN_BITS = 1 << 16
PER_KEY = 16
PROBES = 3
SEGMENT = 1 << 16  # bytes
#: Hashes that a task folds before it passes them on.
FOLD = 1 << 18


def bits_for(n: int, per_key: int = PER_KEY) -> int:
    """The power of two that gives each of n keys per_key bits, within the fixed bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << max(0, int(n) * per_key - 1).bit_length()))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = hashes.astype(np.uint64, copy=False)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)


def _all_set(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _set(bitmap: np.ndarray, places: np.ndarray) -> None:
    p = places.ravel()
    np.bitwise_or.at(bitmap, p >> np.uint64(3), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))


class Seen:
    """A once-seen filter that grows: when a layer is full, one of twice its size is laid beside it."""

    def __init__(self, bits: int = MIN_BITS):
        self.layers, self.left = [np.zeros(bits // 8, np.uint8)], bits // PER_KEY

    def add(self, values: np.ndarray) -> np.ndarray:
        """Adds distinct hashes; which of them were there before, with a few by chance."""
        before = np.zeros(len(values), bool)
        for layer in self.layers:
            before |= _all_set(layer, _places(values, 8 * len(layer)))
        new = values[~before]
        while len(new):
            part, new = new[: self.left], new[self.left :]
            _set(self.layers[-1], _places(part, 8 * len(self.layers[-1])))
            self.left -= len(part)
            if not self.left:
                self.layers.append(np.zeros(2 * len(self.layers[-1]), np.uint8))
                self.left = 8 * len(self.layers[-1]) // PER_KEY
        return before


def _folded(hashes: Callable[[pa.RecordBatch], np.ndarray]):
    """The distinct hashes of a task, FOLD at a time, and which of them it holds twice."""

    def out(parts: list) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts > 1)], ["h", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            parts.append(hashes(b).astype(np.uint64, copy=False))
            n += len(parts[-1])
            if n >= FOLD:
                yield out(parts)
                parts, n = [], 0
        if n:
            yield out(parts)

    return run


def _met_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = Seen()
    for b in batches:
        h, again = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)
        values, first, counts = np.unique(h, return_index=True, return_counts=True)
        marked = np.zeros(len(values), bool)
        marked[np.searchsorted(values, h[again])] = True
        hit = values[seen.add(values) | (counts > 1) | marked]
        yield pa.RecordBatch.from_arrays([pa.array(hit.view(np.int64))], ["h"])


def repeated(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(h long): each hash that hashes(batch) gives twice or more over all batches of df, and a few by chance.

    hashes takes a RecordBatch and returns a numpy array of 64-bit hashes. A hash may come up several times.
    """
    return df.mapInArrow(_folded(hashes), "h long, again boolean").repartition("h").mapInArrow(_met_before, "h long")


def _filled(bits: int, size: int):
    """The segments of a filter of the hashes (h) of a task that aren't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        for b in batches:
            _set(bitmap, _places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
        at = [i for i in range(bits // 8 // size) if bitmap[i * size : (i + 1) * size].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([zlib.compress(bitmap[i * size : (i + 1) * size].tobytes(), 1) for i in at], pa.binary())], ["seg", "bits"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment; holds one segment at a time."""
    now, whole = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(whole.tobytes(), 1)], pa.binary())], ["seg", "bits"])

    for b in batches:
        for seg, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            part = np.frombuffer(zlib.decompress(data.as_buffer()), np.uint8)
            if seg != now:
                if now is not None:
                    yield done()
                now, whole = seg, part.copy()
            else:
                whole |= part
    if now is not None:
        yield done()


class Filter:
    """A finished filter; test() may be called in tasks."""

    def __init__(self, bits: int, broadcast):
        self.bits, self.broadcast = bits, broadcast

    def test(self, hashes: np.ndarray) -> np.ndarray:
        bitmap = np.frombuffer(self.broadcast.value, np.uint8)
        return _all_set(bitmap, _places(hashes, self.bits)) if len(hashes) else np.zeros(0, bool)

    def column(self, h: Column) -> Column:
        """Whether a hash, a long that isn't null, tests positive."""

        @F.arrow_udf("boolean")
        def maybe(h: pa.Array) -> pa.Array:
            return pa.array(self.test(h.to_numpy(zero_copy_only=False).view(np.uint64)))

        return maybe(h)


SCHEMA = "seg int, bits binary"


def build(hashes: DataFrame, bits: int) -> Filter:
    """A filter of hashes (h long). What comes to the driver and is broadcast has bits / 8 bytes."""
    size = min(SEGMENT, bits // 8)
    rows = hashes.select("h").mapInArrow(_filled(bits, size), SCHEMA).repartition("seg").sortWithinPartitions("seg").mapInArrow(_merge, SCHEMA)
    bitmap = bytearray(bits // 8)
    for seg, data in rows.collect():
        bitmap[seg * size : (seg + 1) * size] = zlib.decompress(data)
    return Filter(bits, hashes.sparkSession.sparkContext.broadcast(bytes(bitmap)))
