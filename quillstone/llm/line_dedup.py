"""Line deduplication with two Bloom filters.

The hashes of all lines, dealt to tasks by value, go through once-seen filters; those met again make up the
twice-seen filter, which all tasks test their lines with (bloom.py). Only lines that it suspects are
shuffled, with their whole key, to confirm that two documents hold them and to find the smallest
document id. Documents then lose the confirmed keys; those that lose nothing stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import bloom
from quillstone.llm.common import SPACE_BYTES, materialize, without

RESULTS = ("kept_text", "n_lines", "n_dropped")
MIN_CHARS = 10


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE_BYTES).lower()  # bytes.lower() changes A-Z alone


def keys_of(text: str | None, least: int) -> set[bytes]:
    """Distinct keys of at least so many code points."""
    out = set()
    for line in (text or "").encode().split(b"\n"):
        k = line.strip(SPACE_BYTES)
        if len(k) >= least and (len(k) >= 4 * least or len(k.decode()) >= least):
            out.add(k.lower())
    return out


def _hashes(least: int):
    def of(b: pa.RecordBatch) -> np.ndarray:
        h = xxhash.xxh3_64_intdigest
        return np.fromiter((h(k) for i in range(0, b.num_rows, 1000) for t in b.column(0).slice(i, 1000).to_pylist() if t for k in keys_of(t, least)), np.uint64)

    return of


def _slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    return (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(slices)


def _in_slice(k: int, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_slice_of(b.column(0).to_numpy().view(np.uint64), slices) == k))

    return run


def _suspects(twice: bloom.Filter, least: int, k: int, slices: int):
    """(id, key) of the lines in a slice of all hashes that the filter suspects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_64_intdigest
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                rows, keys = [], []
                for i, t in enumerate(b.column(0).to_pylist()):
                    if t:
                        ks = list(keys_of(t, least))
                        rows += [i] * len(ks)
                        keys += ks
                hashes = np.fromiter(map(h, keys), np.uint64, len(keys))
                own = np.flatnonzero(_slice_of(hashes, slices) == k) if slices > 1 else np.arange(len(keys))
                hit = own[twice.test(hashes[own])]
                ids = b.column(1).take(pa.array([rows[i] for i in hit], pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([keys[i].decode() for i in hit], pa.string())], ["id", "key"])

    return run


def suspects(df: DataFrame, id_col: str, text_col: str, least: int, max_bits: int) -> DataFrame:
    """(id, key) of all lines that may occur twice; those that do are all among them.

    The twice-filter has 16 bits for each of its hashes. Where they need more than max_bits, they are
    taken in slices by value, one after the other: each slice goes through all texts again.
    """
    text, kind = F.col(text_col), df.schema[id_col].dataType.simpleString()
    twice = materialize(bloom.repeated(df.select(text), _hashes(least)), "repeated")
    n = twice.count()
    slices, found = max(1, -(-n * bloom.PER_KEY // max_bits)), []
    for k in range(slices):
        own = twice.mapInArrow(_in_slice(k, slices), "h long") if slices > 1 else twice
        seen = bloom.build(own, bloom.bits_for(n // slices))
        found.append(materialize(df.select(text, F.col(id_col).alias("id")).mapInArrow(_suspects(seen, least, k, slices), f"id {kind}, key string"), "suspects"))
        seen.broadcast.unpersist()
    return reduce(DataFrame.unionByName, found)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """df with kept_text, n_lines and n_dropped.

    A text is its lines between \\n; null and empty texts are one empty line. A line's key is the line
    without white space at its ends, A-Z in lower case. Keys of at least min_chars code points that two
    or more ids hold lose all their lines except in the smallest id. Rows that share an id count as
    one document; a null id is greater than any other, and rows with null ids count as one document.
    An empty table gives an empty table. Columns named like a result are replaced. max_bits: the
    largest filter to broadcast; beyond it texts are gone through several times.
    """
    df = without(df, *RESULTS)
    text = F.col(text_col)
    found = suspects(df, id_col, text_col, min_chars, max_bits)
    first = found.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.bool_or(F.col("id").isNull()).alias("nulls"))
    # as a table of its own, the join below may split a key that very many documents hold
    first = materialize(first.where("least < most or (least is not null and nulls)").select(F.col("key").alias("dup"), "least"), "repeated")
    drops = (
        found.join(first, F.col("key") == F.col("dup"))
        .where(~F.col("id").eqNullSafe(F.col("least")))
        .groupBy(F.col("id").alias("__id")).agg(F.collect_set("key").alias("__drop"))
    )
    drops = materialize(drops, "drops")
    # documents that lose nothing aren't shuffled
    loses = bloom.build(drops.select(F.xxhash64("__id").alias("h")), bloom.bits_for(drops.count())).column(F.xxhash64(id_col))

    @F.arrow_udf("struct<kept_text string, n_lines long, n_dropped long>")
    def lines(texts: pa.Array, gone: pa.Array) -> pa.Array:
        kept, total, dropped = [], [], []
        for t, g in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
            old = new = (t or "").split("\n")
            if g:
                g = {k.encode() for k in g}
                new = [x for x in old if line_key(x.encode()) not in g]
            kept.append("\n".join(new))
            total.append(len(old))
            dropped.append(len(old) - len(new))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], ["kept_text", "n_lines", "n_dropped"])

    some = df.where(loses).join(drops, F.col(id_col).eqNullSafe(F.col("__id")), "left").withColumn("__r", lines(text, F.col("__drop")))
    whole = F.coalesce(text, F.lit(""))
    breaks = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit("")))
    rest = df.where(~loses).select(*df.columns, whole.alias("kept_text"), (breaks + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return some.select(*df.columns, *[F.col(f"__r.{c}").alias(c) for c in RESULTS]).unionByName(rest)
