"""Exact deduplication by Grace hashing over complete content.

Spark's shuffle is the first partitioning level. Within a shuffle partition records go into an
open-addressing table that compares whole texts; once its content passes a byte budget, what it holds
and what follows is split by further hash digits into spill files, and each file is treated likewise.
Before the shuffle each task folds its own equal texts, so a text that a third of all rows share
reaches its partition once per task. Rows find their class by content hash; should two different
texts share a hash, their rows are told apart by comparing texts.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialize, normal_space, without

RESULTS = ("keep_id", "group_size", "kept", "text_sha256")
FANOUT = 16
#: Bytes of an entry besides its strings: lists, numbers and slots.
ENTRY = 300


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


class Table:
    """Open addressing with linear probing; slots hold entry numbers, entries hold whole texts."""

    def __init__(self):
        self.slots, self.entries, self.bytes = [-1] * 1024, [], 0

    def add(self, key: str, text: str, least, n: int) -> None:
        if 3 * len(self.entries) > 2 * len(self.slots):
            old, self.slots = self.entries, [-1] * (4 * len(self.slots))
            for i, e in enumerate(old):
                self.slots[self._slot(e[0], e[1], fresh=True)] = i
        at = self._slot(key, text)
        if self.slots[at] < 0:
            self.slots[at] = len(self.entries)
            self.entries.append([key, text, least, n])
            self.bytes += getsizeof(text) + getsizeof(key) + ENTRY
        else:
            e = self.entries[self.slots[at]]
            e[2], e[3] = _least(e[2], least), e[3] + n

    def _slot(self, key: str, text: str, fresh: bool = False) -> int:
        mask = len(self.slots) - 1
        at = hash(key) & mask
        while (i := self.slots[at]) >= 0 and (fresh or self.entries[i][0] != key or self.entries[i][1] != text):
            at = (at + 1) & mask
        return at


def _digit(key: str, depth: int) -> int:
    """Hash digit for this level, from the end of the key: Spark's shuffle has not used it."""
    return int(key[-1 - depth], 16) if depth < len(key) else -1


def grace(records: Iterator[tuple], budget: int, depth: int = 0, folder: str | None = None) -> Iterator[list]:
    """Classes [key, text, least id, rows] of records, in buckets that fit the budget.

    Texts that agree in every digit of the key can't be split further and share one table.
    """
    t, files = Table(), None
    with tempfile.TemporaryDirectory(dir=folder) as own:
        try:
            for r in records:
                if files is None:
                    t.add(*r)
                    if t.bytes > budget and len(t.entries) > 1 and any(_digit(e[0], depth) >= 0 for e in t.entries):
                        files = [open(os.path.join(own, str(i)), "wb") for i in range(FANOUT + 1)]  # noqa: SIM115
                        for e in t.entries:
                            pickle.dump(tuple(e), files[_digit(e[0], depth)], -1)
                        t = None
                else:
                    pickle.dump(r, files[_digit(r[0], depth)], -1)
        finally:
            for f in files or ():
                f.close()
        if files is None:
            yield t.entries
            return
        for f in files:
            if os.path.getsize(f.name):
                yield from grace(_spilled(f.name), budget, depth + 1, own)
            os.unlink(f.name)


def _spilled(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


RECORDS = "k string, t string, least {id}, n long"
CLASSES = "k string, only_text string, least {id}, n long, mixed boolean"


def _fold(budget: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal texts of this task as one record, as far as they fit the budget together."""
        seen: dict = {}
        size = 0
        schema = None

        def out() -> pa.RecordBatch:
            ks = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in ks], schema.field(0).type), pa.array([t for _, t in ks], schema.field(1).type), pa.array([seen[k][0] for k in ks], schema.field(2).type), pa.array([seen[k][1] for k in ks], pa.int64())], ["k", "t", "least", "n"])

        for b in batches:
            schema = b.schema
            for k, t, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (e := seen.get((k, t))) is not None:
                    e[0], e[1] = _least(e[0], i), e[1] + 1
                else:
                    seen[(k, t)] = [i, 1]
                    size += getsizeof(t) + getsizeof(k) + ENTRY
                    if size > budget:
                        yield out()
                        seen, size = {}, 0
        if seen:
            yield out()

    return fold


def _classes(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = []

        def records():
            for b in batches:
                kind[:] = [b.schema.field(2).type]
                for i in range(0, b.num_rows, 256):
                    yield from zip(*(b.slice(i, 256).column(j).to_pylist() for j in range(4)), strict=True)

        for entries in grace(records(), budget):
            first, mixed = {}, set()
            for k, t, _, _ in entries:
                if first.setdefault(k, t) is not t:
                    mixed.add(k)
            if entries:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e[0] for e in entries], pa.string()), pa.array([e[1] if e[0] in mixed else None for e in entries], pa.string()), pa.array([e[2] for e in entries], kind[0]), pa.array([e[3] for e in entries], pa.int64()), pa.array([e[0] in mixed for e in entries], pa.bool_())],
                    ["k", "only_text", "least", "n", "mixed"],
                )

    return run


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Column | None = None, key: Column | None = None, budget: int = 48 << 20) -> DataFrame:
    """df with keep_id, group_size, kept and text_sha256 for every row, dropped ones too.

    Texts are equal when their normal forms are (white-space runs as one space by default); of equal
    texts the row with the smallest id stays. Null texts count as empty. A null id is greater than any
    other: such a row stays (kept) only if all its group's ids are null. Rows that repeat an id of
    equal text are marked alike. Columns of df named like a result are replaced. key (lowercase hex)
    may replace SHA-256; results don't depend on it. budget: bytes that a task holds, strings and
    entries counted as Python holds them. An empty table gives an empty table.
    """
    df = without(df, *RESULTS)
    norm = normal_space(F.col(text_col)) if normal is None else normal
    digest = F.sha2(norm, 256)
    k = digest if key is None else key
    kind = df.schema[id_col].dataType.simpleString()
    records = df.select(k.alias("k"), norm.alias("t"), F.col(id_col).alias("least")).mapInArrow(_fold(budget // 2), RECORDS.format(id=kind))
    classes = materialize(records.repartition("k").mapInArrow(_classes(budget), CLASSES.format(id=kind)), "classes")
    classes = classes.select(*[F.col(c).alias(f"__{c}") for c in classes.columns])
    rows = df.withColumn("__key", k).withColumn("text_sha256", digest)
    results = [F.col("__least").alias("keep_id"), F.col("__n").alias("group_size"), F.col(id_col).eqNullSafe(F.col("__least")).alias("kept"), "text_sha256"]
    plain = rows.join(classes.where("not __mixed"), F.col("__key") == F.col("__k")).select(*df.columns, *results)
    if classes.where("__mixed").isEmpty():
        return plain
    mixed = rows.withColumn("__norm", norm).join(classes.where("__mixed"), (F.col("__key") == F.col("__k")) & (F.col("__norm") == F.col("__only_text")))
    return plain.unionByName(mixed.select(*df.columns, *results))
