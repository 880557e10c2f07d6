"""Near-duplicate documents: MinHash, banding, verification, and connected components.

Each text's set of word shingles is hashed to 64 bits; of BANDS x ROWS universal hash functions the
minima form its signature, and a band's minima form a bucket key. Documents with equal sets are one
node. Links are confirmed on the full sets:

1. Each node is compared with the node that it shares most buckets with among buckets' smallest ids.
2. What these links join is one component. Buckets that still hold several components are searched
   for pairs across components whose signatures agree well enough, each pair in the first bucket that it
   shares; these, in turn, are compared on their full sets. A bucket reports no more links than join its
   components.
3. Crowded buckets of this kind, as documents of one template make them, aren't searched whole: their
   documents are dealt anew by rare shingles. With all shingles in the order of how many of these
   documents hold them, two documents of similarity 0.8 share one among the first fifth of each, and
   among the first ninth of the smaller one. Documents that own more than that drop out, and the others
   meet in blocks only those that hold the same rare shingle.

So a bucket of n near copies costs about n comparisons, not n squared, and yet every pair that shares
a bucket is either confirmed, refuted, or already joined through others. A pair of similarity 0.8
shares none of 34 bands of 5 rows with a probability of 1.4e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import bloom
from quillstone.llm.common import SPACE_BYTES, materialize
from quillstone.llm.components import connected_components

BANDS, ROWS = 34, 5
#: Nodes of a block; a task compares those of two blocks with one another. Larger buckets count as crowded.
BLOCK = 250
#: Signatures may estimate a similarity so much below the threshold; six standard deviations.
SLACK = 0.2
#: Numbers of documents by which shingles of crowded buckets are told rare from common.
LEVELS = (2, 8, 64, 512, 4096)
#: Shared buckets from which the first step compares a pair.
SHARED = 4

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _ODD[4]
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(255, _ODD[0], np.uint64)]), dtype=np.uint64)


_POWERS = _powers()


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. Fewer words than k make one shingle; no
    words, or no text, none.
    """
    data = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    word_byte = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word_byte]).astype(np.int8)))
    start, length = edges[0::2], edges[1::2] - edges[0::2]
    first = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
    offset = np.searchsorted(start, first)
    if not len(start):
        return [np.zeros(0, np.uint64) for _ in texts]
    at = np.flatnonzero(word_byte)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    within = np.arange(len(at)) - np.repeat(begin, length)
    weight = _POWERS[within & 255]
    if length.max() > 256:
        blocks = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(length.max()) >> 8, (_POWERS[255:] * _ODD[0])[0], np.uint64)]), dtype=np.uint64)
        weight = weight * blocks[within >> 8]
    h = np.add.reduceat((_LOWER[raw[at]].astype(np.uint64) + np.uint64(1)) * weight, begin)
    h = _mix(h + length.astype(np.uint64) * _ODD[1])
    n = len(h)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k if n >= k else 0):
        rolled = _mix(rolled + h[i : n - k + 1 + i] + _ODD[i % 4])
    out = []
    for a, b in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for v in h[a:b]:
                    x = _mix(np.array([x * _ODD[2] + v]))[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add functions on 64-bit hashes, of which the high bits count."""
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), ~np.uint64(0))
    for i in range(0, len(values), 256):  # small enough to stay in cache
        out = np.minimum(out, (values[i : i + 256, None] * a + b).min(axis=0))
    return out >> np.uint64(32)


#: minima: the low byte of each minimum, then 32 bits of each bucket.
SKETCH = "id {id}, n_shingles long, set_key binary, buckets array<long>, minima binary"


def _sketches(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _functions(bands * rows)
        band = np.arange(1, bands + 1, dtype=np.uint64) * _ODD[3]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                sets = shingle_sets(part.column(1).to_pylist(), k)
                keys, buckets, minima = [], [], []
                for s in sets:
                    if not len(s):
                        keys.append(None)
                        buckets.append([])
                        minima.append(None)
                        continue
                    sig = signature(s, a, b)
                    h = band
                    for row in sig.reshape(bands, rows).T:
                        h = _mix(h * _ODD[1] + row)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    buckets.append(h.view(np.int64))
                    minima.append((sig & np.uint64(255)).astype(np.uint8).tobytes() + h.astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), pa.array(minima, pa.binary())], ["id", "n_shingles", "set_key", "buckets", "minima"])

    return run


def _full_sets(k: int, needed: bloom.Filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                b = b.filter(pa.array(needed.test(b.column(2).to_numpy(zero_copy_only=False).view(np.uint64))))
                sets = shingle_sets(b.column(1).to_pylist(), k)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "members"])

    return run


class Unions:
    """Which components a block has joined so far."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows without their first columns, by runs of equal first columns."""
    now, rows = None, []
    for b in batches:
        for i in range(0, b.num_rows, 500):
            for row in zip(*(c.to_pylist() if not pa.types.is_list(c.type) else [x.values.to_numpy() for x in c] for c in b.slice(i, 500).columns), strict=True):
                if row[:keys] != now:
                    if rows:
                        yield now, rows
                    now, rows = row[:keys], []
                rows.append(row[keys:])
    if rows:
        yield now, rows


def _promising(least: float, bands: int):
    """(bucket, i, j, id, comp, minima, band) to those rows whose signature agrees with one of another component.

    Two rows that have the same bucket in an earlier band have met there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out = None, []

        def seen(bs):
            nonlocal kinds
            for b in bs:
                kinds = [b.schema.field(i).type for i in range(5)]
                yield b

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(5)], ["bucket", "i", "j", "id", "comp"])

        for key, members in _blocks(seen(batches), 3):
            raw = np.frombuffer(b"".join(r[2] for r in members), np.uint8).reshape(len(members), -1)
            sig, buckets = raw[:, : -4 * bands], np.ascontiguousarray(raw[:, -4 * bands :]).view(np.uint32)
            comps, before = [r[1] for r in members], min(r[3] for r in members)
            number = {c: n for n, c in enumerate(dict.fromkeys(comps))}
            if len(number) < 2:
                continue
            comp = np.array([number[c] for c in comps])
            # chance agreement of one byte in 256 counts in the pair's favour
            need, hit = least * sig.shape[1], np.zeros(len(members), bool)
            main = np.bincount(comp).argmax()
            for x in np.flatnonzero(comp != main).tolist():
                good = np.flatnonzero(((sig == sig[x]).sum(axis=1) >= need) & (comp != comp[x]))
                good = good[~(buckets[good, :before] == buckets[x, :before]).any(axis=1)]
                if len(good):
                    hit[x] = True
                    hit[good] = True
            out += [(*key, members[i][0], members[i][1]) for i in np.flatnonzero(hit).tolist()]
            if len(out) > 5000:
                yield flush()
                out = []
        if out:
            yield flush()

    return run


def _confirm(percent: int):
    """(bucket, i, j, id, comp, members) to pairs (u, v) of components of a block that a link joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out = None, []

        def seen(bs):
            nonlocal kind
            for b in bs:
                kind = b.schema.field(4).type
                yield b

        for _, rows in _blocks(seen(batches), 3):
            ids, comps, sets = zip(*rows, strict=True)
            joined, count = Unions(), {}
            size = np.array([len(s) for s in sets])
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for c in comps:
                count[c] = count.get(c, 0) + 1
            main = max(count, key=lambda c: (count[c], c))
            number = {c: n for n, c in enumerate(count)}
            comp = np.array([number[c] for c in comps])
            for x in range(len(ids)):
                if comps[x] == main:
                    continue
                a, b = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
                n = b - a
                places = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                shared = np.bincount(owner[places], minlength=len(ids))
                linked = np.flatnonzero((100 * shared >= percent * (size + size[x] - shared)) & (comp != comp[x]))
                for y in linked.tolist():
                    if joined.join(comps[x], comps[y]):
                        out.append((comps[x], comps[y]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], kind), pa.array([v for _, v in out], kind)], ["u", "v"])

    return run


def _open(members: DataFrame) -> DataFrame:
    """(b, all, mains, main): buckets of members (bucket, id, comp) with several components, the largest being main."""
    by = members.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top"))
    return materialize(by.where("all > top.n").select(F.col("bucket").alias("b"), "all", F.col("top.n").alias("mains"), F.col("top.comp").alias("main")), "open")


def _spread(members: DataFrame, block: int) -> DataFrame:
    """Members (bucket, id, comp) of buckets with several components, dealt to blocks (i, j).

    Every pair of different components meets in a block of about 2 x block rows at most. Only members
    outside the bucket's largest component are copied to several blocks of it.
    """
    blocks = lambda n: F.ceil(n / block).cast("int")
    open_ = _open(members).select("b", "main", (F.col("all") <= 2 * block).alias("small"), blocks(F.col("all") - F.col("mains")).alias("rest"), blocks(F.col("mains")).alias("mains"))
    m = members.join(open_, F.col("bucket") == F.col("b")).withColumn("out", F.col("comp") != F.col("main"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("out"), F.col("rest")).otherwise(F.col("mains"))).cast("int")
    m = m.withColumn("own", own)
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    rest = F.sequence(F.lit(0), F.col("rest") - 1)
    of_rest = F.concat(F.transform(rest, lambda x: pair(F.least("own", x), F.greatest("own", x))), F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: pair(F.col("own"), F.col("rest") + j)))
    of_main = F.transform(rest, lambda i: pair(i, F.col("rest") + F.col("own")))
    where = F.when(F.col("small"), F.array(pair(F.lit(0), F.lit(0)))).when(F.col("out"), of_rest).otherwise(of_main)
    return m.withColumn("at", F.explode(where)).select("bucket", "at.i", "at.j", F.lit(0).alias("band"), "id", "comp")


def _first_shingles(filters: list[bloom.Filter], percent: int):
    """(id, comp, members) to (bucket, id, comp, n, at, early): the shingles by which links to a document show.

    A shingle's level is the number of filters that know it; those of level 0 are held by one document only,
    and lead to no other. early: a link to a document that isn't smaller shows here as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                b, rows, found, n_of, at_of, early = whole.slice(i, 200), [], [], [], [], []
                sets = [x.values.to_numpy().view(np.uint64) for x in b.column(2)]
                levels = sum(f.test(np.concatenate(sets)).astype(np.int64) for f in filters)
                for row, (own, level) in enumerate(zip(sets, np.split(levels, np.cumsum([len(x) for x in sets])[:-1]), strict=True)):
                    n = len(own)
                    first, low = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
                    at = np.arange(np.count_nonzero(level == 0), first)
                    if len(at):
                        found.append(own[np.lexsort((own, level))[at]])
                        rows += [row] * len(at)
                        n_of += [n] * len(at)
                        at_of.append(at)
                        early.append(at < low)
                if rows:
                    pick = pa.array(rows, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), b.column(0).take(pick), b.column(1).take(pick), pa.array(n_of, pa.int64()), pa.array(np.concatenate(at_of)), pa.array(np.concatenate(early))], ["bucket", "id", "comp", "n", "at", "early"])

    return run


def _by_rare_shingles(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, id, comp): documents (id, comp) by the rare shingles, as buckets, that linked ones share.

    Shingles stand in one order, by how many of these documents hold them, roughly, and then by value; so
    those of a single document come first. Of two linked documents, the first shingle that they share
    has the rest of the intersection behind it: at most n - at shingles of either.
    """
    of = materialize(crowd.join(sets, "id").select("id", "comp", "members"), "crowd")
    shared = materialize(of.select(F.explode("members").alias("h")).groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "shingles")
    counts = shared.agg(*[F.count_if(F.col("df") >= least) for least in LEVELS]).first()
    filters = [bloom.build(shared.where(F.col("df") >= least), bloom.bits_for(n)) for least, n in zip(LEVELS, counts, strict=True) if n]
    if not filters:
        return of.select(F.lit(0).cast("long").alias("bucket"), "id", "comp").limit(0)
    kind = crowd.schema["id"].dataType.simpleString()
    keys = materialize(of.mapInArrow(_first_shingles(filters, percent), f"bucket long, id {kind}, comp {kind}, n long, at long, early boolean"), "rare")
    groups = keys.groupBy("bucket").agg(F.min("n").alias("least"), F.min(F.when(F.col("early"), F.col("n"))).alias("early_least"), F.min("comp").alias("a"), F.max("comp").alias("z"))
    groups = materialize(groups.where("a < z and early_least is not null").select(F.col("bucket").alias("b"), "least", "early_least"), "groups")
    # the smallest partner that there may be here
    other = F.greatest(F.ceil(percent * F.col("n") / 100), F.when(F.col("early"), F.col("least")).otherwise(F.col("early_least")))
    fits = percent * (F.col("n") + other) <= (100 + percent) * (F.col("n") - F.col("at"))
    return keys.join(groups, (F.col("bucket") == F.col("b")) & fits).select("bucket", "id", "comp").distinct()


def _to_search(labelled: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(bucket, i, j, band, id, comp) of what is compared, from members (bucket, band, id, comp)."""
    open_ = _open(labelled)
    few = open_.where(F.col("all") <= 2 * block).select("b")
    here = labelled.join(few, F.col("bucket") == F.col("b")).select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), "band", "id", "comp")
    many = open_.where(F.col("all") > 2 * block).select("b")
    if many.isEmpty():
        return here
    crowd = materialize(labelled.join(many, F.col("bucket") == F.col("b")).select("id", "comp").distinct(), "crowd")
    rare = materialize(_by_rare_shingles(crowd, sets, percent), "dealt")
    return here.unionByName(_spread(rare, block))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """A row for each row of df, with its id, n_shingles, component_id and kept, and no other column.

    Two documents are linked if the intersection of their shingle sets is at least percent of the
    union. component_id: the smallest id that links reach, the own one included; kept: the own id is
    it. Documents without words are linked with nothing. Rows that repeat an id are one document, with
    the links of each text. A row with a null id has the component of documents with an equal set, if
    there are any, and is not kept; else it is kept, with a null component_id. Texts of any length are
    read whole. An empty table gives an empty table.
    """
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    sketches = materialize(docs.mapInArrow(_sketches(shingle, bands, rows), SKETCH.format(id=kind)), "sketches")
    known = sketches.where("set_key is not null and id is not null")
    reps = materialize(known.groupBy("set_key").agg(F.min("id").alias("rep")), "nodes")
    named = reps.withColumnRenamed("set_key", "k")
    nodes = known.join(named, (F.col("set_key") == F.col("k")) & (F.col("id") == F.col("rep"))).groupBy("id").agg(F.flatten(F.collect_set("buckets")).alias("buckets"), F.collect_set("minima").alias("minima"))

    # buckets with several nodes, by their smallest
    banded = F.array_distinct(F.transform("buckets", lambda x, i: F.struct(x.alias("bucket"), (i % bands).cast("int").alias("band"))))
    entries = nodes.select("id", F.explode(banded).alias("x")).select("id", "x.bucket", "x.band")
    shared = entries.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(F.col("bucket").alias("b"), "least")
    members = materialize(entries.join(shared, F.col("bucket") == F.col("b")).select("bucket", "band", "id", "least"), "members")

    # full sets of all nodes that share a bucket
    ids = members.select("id").distinct()
    h = F.xxhash64("id")
    needed = bloom.build(ids.select(h.alias("h")), bloom.bits_for(ids.count()))
    sets = docs.where("id is not null").select("id", "t", h.alias("h")).mapInArrow(_full_sets(shingle, needed), f"id {kind}, members array<long>")
    sets = materialize(sets.join(ids, "id", "left_semi"), "sets")

    # first: each node and the smallest of its buckets' nodes that it shares most buckets with
    best = members.where("id <> least").groupBy("id", "least").agg(F.count("*").alias("n")).where(F.col("n") >= min(SHARED, bands)).groupBy("id").agg(F.max_by("least", F.struct("n", "least")).alias("v"))
    left = best.join(sets, "id").select(F.col("id").alias("u"), "v", F.col("members").alias("mu"))
    both = left.join(sets.select(F.col("id").alias("w"), F.col("members").alias("mv")), F.col("v") == F.col("w"))
    n = F.size(F.array_intersect("mu", "mv"))
    first = both.where(100 * n >= percent * (F.size("mu") + F.size("mv") - n)).select("u", "v")
    # an id that several sets share is one document, linked to the node of each
    h = F.xxhash64("set_key")
    several = materialize(known.groupBy("id").agg(F.min(h).alias("low"), F.max(h).alias("high")).where("low < high").select(F.col("id").alias("u")), "several")
    if not several.isEmpty():
        sets_of = known.join(several, F.col("id") == F.col("u")).select("u", "set_key").distinct()
        first = first.unionByName(sets_of.join(named, F.col("set_key") == F.col("k")).select("u", F.col("rep").alias("v")))
    first = materialize(first, "links")
    parts = materialize(connected_components(first), "parts")

    # then: whatever else shares a bucket across components
    comp = parts.select(F.col("id").alias("c"), "component")
    labelled = members.select("bucket", "band", "id").join(comp, F.col("id") == F.col("c"), "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("comp"))
    at = ["bucket", "i", "j"]
    search = _to_search(labelled, sets, percent, block).join(nodes.select("id", F.explode("minima").alias("minima")), "id").select(*at, "id", "comp", "minima", "band")
    promising = materialize(search.repartition(*at).sortWithinPartitions(*at).mapInArrow(_promising(percent / 100 - SLACK, bands), f"bucket long, i int, j int, id {kind}, comp {kind}"), "promising")
    whole = promising.join(sets, "id").select(*at, "id", "comp", "members")
    second = materialize(whole.repartition(*at).sortWithinPartitions(*at).mapInArrow(_confirm(percent), f"u {kind}, v {kind}"), "links")
    joined = materialize(connected_components(second), "components").select(F.col("id").alias("j"), F.col("component").alias("into"))

    group = reps.join(comp, F.col("rep") == F.col("c"), "left").select(F.col("set_key").alias("k"), F.coalesce("component", "rep").alias("part"))
    group = group.join(joined, F.col("part") == F.col("j"), "left").select("k", F.coalesce("into", "part").alias("group"))
    group = materialize(group, "groups")
    rows_ = sketches.join(group, F.col("set_key") == F.col("k"), "left").withColumn("component_id", F.coalesce("group", F.when(F.col("set_key").isNull(), F.col("id"))))
    return rows_.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """df with one document of each group of near duplicates, that with the smallest id, and all its columns.

    Rows with a null id stay, and so do all rows that repeat an id which stays.
    """
    found = near_duplicates(df, id_col, **options)
    gone = materialize(found.where(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__gone")).distinct(), "gone")
    return df.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
