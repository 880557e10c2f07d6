"""Audio columns: chroma fingerprints and the alignment of recordings.

A recording is cut into overlapping frames; each frame's spectrum is folded to the energies of twelve
pitch classes. Sixteen rectangular filters, evaluated on the integral image of frames by pitch classes,
give two bits each: a packed 32-bit integer per frame. Each query is held against each recording: a
histogram over all offsets of the bits that agree, got by correlating them, names the offsets worth a look,
and there votes (equal integers) and the share of differing bits, counted exactly, decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialize, without

RATE = 5512
FRAME, HOP = 2048, 512
#: Fewest frames of overlap, fewest votes, and most differing bits of an alignment.
LEAST_OVERLAP, LEAST_VOTES, MOST_ERRORS = 16, 4, 0.25
WIDEST = 16
#: Integers, with padding, of the recordings that are compared at once.
BLOCK = 1 << 13


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, classes, frames). By rule: four kinds, four widths, shifted pitches."""
    return [(i % 4, (5 * i) % 7, 6, 4 * (1 + i // 4)) for i in range(16)]


@lru_cache(1)
def _fold() -> np.ndarray:
    """Spectrum bins by pitch class, for 100 to 2000 Hz."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12), np.float32)
    for i in np.flatnonzero((hz >= 100) & (hz <= 2000)):
        out[i, round(12 * np.log2(hz[i] / 440)) % 12] = 1
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by pitch class, each frame of length one; silent frames are zero."""
    n = max(0, (len(samples) - FRAME) // HOP + 1)
    if not n:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n] * np.hanning(FRAME).astype(np.float32)
    energy = (np.abs(np.fft.rfft(frames, axis=1)) ** 2).astype(np.float32) @ _fold()
    size = np.sqrt((energy**2).sum(axis=1, keepdims=True))
    return np.where(size > 1e-3, energy / np.maximum(size, 1e-3), 0)


def packed(c: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each place where the widest filter fits."""
    n = len(c) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    whole = np.zeros((len(c) + 1, 13))
    whole[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(a: int, b: int, p: int, q: int) -> np.ndarray:
        return whole[t + b, q] - whole[t + a, q] - whole[t + b, p] + whole[t + a, p]

    out = np.zeros(n, np.int64)
    for kind, p, h, w in _filters():
        q, half, mid = p + h, w // 2, p + h // 2
        if kind == 0:  # low against high pitches
            x, y = area(0, w, p, mid), area(0, w, mid, q)
        elif kind == 1:  # before against after
            x, y = area(0, half, p, q), area(half, w, p, q)
        elif kind == 2:  # middle against both sides
            x, y = 2 * area(w // 4, w - w // 4, p, q), 2 * (area(0, w // 4, p, q) + area(w - w // 4, w, p, q))
        else:  # one diagonal against the other
            x, y = area(0, half, p, mid) + area(half, w, mid, q), area(0, half, mid, q) + area(half, w, p, mid)
        v = np.log1p(x) - np.log1p(y)
        level = np.searchsorted([-0.15, 0.0, 0.15], v)
        out = out << 2 | (level ^ level >> 1)  # neighbouring levels differ in one bit
    return out


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed integers, and which of them lie in sound throughout."""
    c = chroma(samples)
    bits = packed(c)
    loud = np.concatenate([[0], (c.any(axis=1)).cumsum()])
    return bits, (loud[WIDEST:] - loud[: len(loud) - WIDEST] == WIDEST)[: len(bits)] if len(bits) else np.zeros(0, bool)


def pcm16(data: bytes | None) -> np.ndarray:
    """Samples of 16-bit little-endian mono PCM at RATE; an odd last byte is left out."""
    return np.frombuffer(data or b"", "<i2", len(data or b"") // 2).astype(np.float32) / 32768


def melody(numbers: list | None, seconds: float = 0.1) -> np.ndarray:
    """Samples of a list of numbers played as notes around 440 Hz, a difference of 0.5 being an octave."""
    n = int(RATE * seconds)
    fade = np.minimum(1, np.minimum(np.arange(n), np.arange(n)[::-1]) / (0.1 * n))
    hz = 440 * 2 ** np.clip(2 * np.nan_to_num(np.array([0 if v is None else v for v in numbers or ()], float)), -1, 1)
    return (np.sin(2 * np.pi * hz[:, None] / RATE * np.arange(n)) * fade).ravel().astype(np.float32)


def fingerprints(df: DataFrame, media: Column, decode: Callable[[Any], np.ndarray] = pcm16) -> DataFrame:
    """df with bits (array of packed integers), sound and digest of a media column.

    decode turns one value of the column into samples at RATE, one recording at a time. Null, empty and
    short recordings have no integers and a null digest. Columns named like a result are replaced.
    """
    df = without(df, "bits", "sound", "digest")

    def one(value) -> dict:
        bits, loud = fingerprint(decode(value))
        return {"bits": bits, "sound": loud, "digest": xxhash.xxh3_128_hexdigest(bits.tobytes()) if len(bits) else None}

    @F.arrow_udf("struct<bits array<long>, sound array<boolean>, digest string>")
    def run(batch: pa.Array) -> pa.Array:
        kind = pa.struct([("bits", pa.list_(pa.int64())), ("sound", pa.list_(pa.bool_())), ("digest", pa.string())])
        return pa.array([one(x.as_py()) for x in batch], kind)

    return df.withColumn("__p", run(media)).select(*df.columns, "__p.*")


def _prints(block: pa.StructArray) -> list:
    """(id, bits, sound) of each recording of a block."""
    ids, *lists = block.flatten()
    return list(zip(ids.to_pylist(), *[np.split(x.flatten().to_numpy(zero_copy_only=False), np.cumsum(x.value_lengths().to_numpy())[:-1]) for x in lists], strict=True))


def _spectra(prints: list, size: int) -> np.ndarray:
    """Spectra of each bit's course, as 1 and -1: recordings by bits by frequencies."""
    x = np.zeros((len(prints), 32, size), np.float32)
    for i, (_, bits, _) in enumerate(prints):
        x[i, :, : len(bits)] = (bits >> np.arange(32)[:, None] & 1) * 2 - 1
    return np.fft.rfft(x, axis=2)


def _fft_size(n: int) -> int:
    """The smallest even size from n on that has no other prime factors than 2, 3 and 5."""
    sizes = (2 * 2**a * 3**b * 5**c for b in range(8) for c in range(5) for a in [max(0, (-(-n // (2 * 3**b * 5**c)) - 1).bit_length())])
    return min(sizes)


def _bars(nq: np.ndarray, nr: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """What equal bits less differing ones must come to: offsets by queries by recordings, or an axis of one where
    all are of one length. Rounding may add a little to them: what passes is counted exactly."""
    (q, iq), (r, ir) = (np.unique(x, return_inverse=True) for x in (nq, nr))
    o = offset[:, None, None]
    n = np.minimum(r, q[:, None] + o) - np.maximum(0, o)
    bars = np.where(n >= LEAST_OVERLAP, 32 * n - 64 * n * (MOST_ERRORS + 0.001) - 1, np.inf).astype(np.float32)
    bars = bars if len(q) == 1 else bars[:, iq]
    return bars if len(r) == 1 else bars[:, :, ir]


def _aligned(queries: list, prints: list) -> Iterator[tuple]:
    """(query, recording, offset, votes, overlap, bit errors) of those that align. Both: (id, bits, sound)."""
    # offsets with less overlap may fold onto one another, none of them onto one that counts
    size = _fft_size(max(1, max(len(x[1]) for x in queries) + max(len(x[1]) for x in prints) - LEAST_OVERLAP))
    step = max(1, 2 * BLOCK // size)
    parts = [(r, np.array([len(x[1]) for x in r]), _spectra(r, size).transpose(2, 1, 0).copy()) for r in (prints[j : j + step] for j in range(0, len(prints), step))]
    for i in range(0, len(queries), step):
        q = queries[i : i + step]
        a, nq = _spectra(q, size).conj().transpose(2, 0, 1).copy(), np.array([len(x[1]) for x in q])
        for r, nr, spectra in parts:
            offset = np.arange(size)
            offset[offset > nr.max() - LEAST_OVERLAP] -= size
            alike = np.fft.irfft(a @ spectra, size, axis=0)
            k, x, y = np.unravel_index(np.flatnonzero(alike >= _bars(nq, nr, offset)), alike.shape)
            order = np.lexsort((y, x))
            k, x, y = k[order], x[order], y[order]
            cuts = [*np.flatnonzero(np.diff(x * len(r) + y, prepend=-1)).tolist(), len(x)]
            for begin, end in pairwise(cuts):
                (qid, *query), (rid, *recording) = q[x[begin]], r[y[begin]]
                if qid != rid and (best := _best_offset(query, recording, np.sort(offset[k[begin:end]]))):
                    yield qid, rid, *best


def _best_offset(query: list, recording: list, offsets: np.ndarray) -> tuple | None:
    """(offset, votes, overlap, bit errors) of the best of these offsets, counted bit by bit; both: (bits, sound)."""
    (qb, qs), (rb, rs), best = query, recording, None
    step = max(1, (1 << 20) // len(qb))
    for i in range(0, len(offsets), step):
        o = offsets[i : i + step]
        at = np.arange(len(qb)) + o[:, None]
        inside = (at >= 0) & (at < len(rb))
        at = np.where(inside, at, 0)
        differ, sound = np.where(inside, rb[at] ^ qb, 0), rs[at] & qs & inside
        overlap = inside.sum(axis=1)
        errors = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) / (32.0 * overlap)
        votes, heard = ((differ == 0) & sound).sum(axis=1), sound.sum(axis=1)
        good = np.flatnonzero((errors <= MOST_ERRORS) & ((votes >= LEAST_VOTES) | (heard >= LEAST_OVERLAP)))
        if len(good):
            n = good[np.lexsort((o[good], errors[good], -votes[good]))[0]]
            new = (-int(votes[n]), float(errors[n]), int(o[n]), int(overlap[n]))
            best = new if best is None else min(best, new)
    return best and (best[2], -best[0], best[3], best[1])


def align(df: DataFrame, queries: Column, id_col: str = "id") -> DataFrame:
    """Aligned recordings: a row for each pair of a query and another recording that differ in print.

    df: id, bits, sound and digest, as from fingerprints(); queries tells which rows are searched for,
    against all rows. Recordings of equal print are one class, named by its smallest id; the rows are
    (query_class, class_id, offset, votes, overlap, bit_errors), offset being the place of the query's
    start in the recording and votes how many sounding integers are equal there. Of the offsets with an
    overlap of LEAST_OVERLAP and MOST_ERRORS at most, that with most votes counts, then that with fewest
    errors, then the smallest. Silence alone aligns nothing: LEAST_VOTES sounding integers are equal, or
    LEAST_OVERLAP places sound in both. Every query is compared with every recording, in blocks: the work is
    queries times recordings, whatever they sound like. Rows with a null id or digest, and recordings that are
    silent throughout or shorter than LEAST_OVERLAP, align with nothing. Rows that repeat an id are one
    recording for each print. Other columns of df are not read.
    """
    known = df.where(F.col("digest").isNotNull() & F.col(id_col).isNotNull())
    classes = materialize(known.groupBy("digest").agg(F.min(id_col).alias("class_id"), F.bool_or(queries).alias("asked"), F.first("bits").alias("bits"), F.first("sound").alias("sound")), "recordings")
    classes = classes.where((F.size("bits") >= LEAST_OVERLAP) & F.exists("sound", lambda x: x)).withColumn("__c", F.ceil(F.log2(F.size("bits").cast("double"))).cast("int"))
    key, spark = df.schema[id_col].dataType.simpleString(), df.sparkSession

    def blocks(rows: DataFrame) -> DataFrame:
        pieces = F.lit(1)
        for c, n in rows.groupBy("__c").count().collect():
            pieces = F.when(F.col("__c") == c, F.lit(-(-n * 2**c // BLOCK))).otherwise(pieces)
        rows = rows.withColumn("__k", F.pmod(F.xxhash64("class_id"), pieces.cast("long")))
        return rows.groupBy("__c", "__k").agg(F.collect_list(F.struct("class_id", "bits", "sound")).alias("r")).select("__c", "__k", "r")

    known = blocks(classes).repartition(4 * spark.sparkContext.defaultParallelism, "__c", "__k").select("r")
    asked = materialize(blocks(classes.where("asked")).select(F.col("r").alias("q")), "asked")
    out = f"query_class {key}, class_id {key}, offset int, votes long, overlap int, bit_errors double"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.schema.field(0).type.value_type.field(0).type
            for i in range(b.num_rows):
                r, q = (_prints(b.column(j)[i].values) for j in (0, 1))
                rows = list(_aligned(q, r))
                if rows:
                    kinds = (kind, kind, pa.int32(), pa.int64(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["query_class", "class_id", "offset", "votes", "overlap", "bit_errors"])

    return known.crossJoin(asked).mapInArrow(compare, out)
