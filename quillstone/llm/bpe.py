"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by a pattern; each is merged on its own. Candidate merges wait in one
bucket per merge rank, holding places in the linked list of the pre-token's pieces; a two-level bitmap
over the ranks gives the lowest rank that has candidates by finding the first set bit in two words. A
merge makes its neighbours' entries stale; stale entries are skipped when they come up. The queue costs
the same per merge however long the pre-token is.

Pre-tokens that a worker hasn't met share one queue, many at a time: a bucket then holds places in all of
them, and the first place of each is merged in one step of numpy. Long ones have the queue to themselves.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import without

# Fixed value: the pattern of byte-level BPE vocabularies that split.py can follow without regex.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens that a Python worker remembers with their ids: with another pattern, and with that one.
REMEMBERED, RECALLED = 500_000, 1_500_000
#: Bytes up to which pre-tokens are merged many at a time, how many are worth it, and the characters of
#: the texts that they are looked up in together.
SHORT, MANY, TOGETHER = 64, 2000, 1_500_000
#: No entry of a hash, and that of another pre-token.
ABSENT, CLASH = -1, -2
#: Bits of a bitmap word; Python's integers can be as wide as that.
SHIFT = 8
WORD, MASK = 1 << SHIFT, (1 << SHIFT) - 1


class RankQueue:
    """Which ranks have a bucket. A bit of a word in low: that rank has one; a bit of top: that word has bits."""

    def __init__(self, ranks: int):
        self.low, self.top = [0] * (ranks // WORD + 1), 0
        self.bit = [1 << i for i in range(max(WORD, len(self.low)))]
        self.places: list[int | list[int]] = [-1] * ranks

    def add(self, rank: int) -> None:
        self.low[rank >> SHIFT] |= self.bit[rank & MASK]
        self.top |= self.bit[rank >> SHIFT]

    def take(self) -> int:
        """The lowest rank, which then has no bucket any more: the first set bits, level by level."""
        at = (self.top & -self.top).bit_length() - 1
        word = self.low[at]
        spot = word & -word
        self.low[at] = word ^ spot
        if word == spot:
            self.top ^= self.bit[at]
        return at << SHIFT | spot.bit_length() - 1

    def drain(self, piece: bytes, rank_of) -> list[int]:
        """Ends of the pieces of one pre-token that are left when no pair of neighbours has a rank.

        after[i]: end of the piece that starts at i; before[i]: start of the one on its left; waits[i]: rank
        of the pair at i. A bucket in places is one place, a heap of several, or -1. add() and take() are
        written out here: calls would cost more than the queue.
        """
        n, low, places, bit, top = len(piece), self.low, self.places, self.bit, 0
        after, before, waits = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        new = [(i, r) for i in range(n - 1) if (r := rank_of(piece[i : i + 2], -1)) >= 0]
        for i, r in new:
            waits[i] = r
        while True:
            for i, r in new:
                bucket = places[r]
                if bucket.__class__ is list:
                    heappush(bucket, i)
                elif bucket >= 0:
                    places[r] = [bucket, i] if bucket < i else [i, bucket]
                else:
                    places[r] = i
                    at = r >> SHIFT
                    low[at] |= bit[r & MASK]
                    top |= bit[at]
            if not top:
                return after
            at = (top & -top).bit_length() - 1
            word = low[at]
            spot = word & -word
            rank = at << SHIFT | spot.bit_length() - 1
            bucket = places[rank]
            if bucket.__class__ is list:
                i = heappop(bucket)
                if len(bucket) == 1:
                    places[rank] = bucket[0]
            else:
                i = bucket
                places[rank] = -1
                low[at] = word ^ spot
                if word == spot:
                    top ^= bit[at]
            new = []
            if waits[i] != rank:
                continue  # stale
            j = after[i]
            waits[j] = -1
            end = after[i] = after[j]
            if end < n:
                before[end] = i
                waits[i] = r = rank_of(piece[i : after[end]], -1)
                if r >= 0:
                    new.append((i, r))
            else:
                waits[i] = -1
            if i:
                h = before[i]
                waits[h] = r = rank_of(piece[h:end], -1)
                if r >= 0:
                    new.append((h, r))


class Vocabulary:
    """Merge ranks by bytes; an id is its rank."""

    def __init__(self, ranks: Mapping[bytes, int], pattern: str):
        import regex

        self.ranks = dict(ranks)
        self.words = [b""] * (max(self.ranks.values(), default=0) + 1)
        for word, rank in self.ranks.items():
            self.words[rank] = word
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.words))]
        compiled = regex.compile(pattern)
        self.find, self.each = compiled.findall, compiled.finditer
        self.queue = RankQueue(len(self.words))
        self.known: dict[str, bytes] = _Known(self)
        self.memory = Memory() if pattern == PATTERN else None
        self._pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        after, out, i = self.queue.drain(piece, self.ranks.get), [], 0
        while i < len(piece):
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every two ids that make a third, as sorted keys with their ranks; and the id of each byte."""
        if self._pairs is None:
            get, found = self.ranks.get, []
            for word, rank in self.ranks.items():
                for i in range(1, len(word)):
                    a, b = get(word[:i]), get(word[i:])
                    if a is not None and b is not None:
                        found.append((a << 32 | b, rank))
            found.sort()
            self._pairs = np.array([k for k, _ in found], np.int64), np.array([r for _, r in found], np.int32), np.array([get(bytes([i]), -1) for i in range(256)], np.int32)
        return self._pairs

    def merge_many(self, pieces: list[bytes]) -> Iterator[bytes]:
        """Packed ids of each of many short pre-tokens, from one queue for all of them."""
        keys, ranks, single = self.pairs()
        size = np.fromiter(map(len, pieces), np.int32, len(pieces))
        ends = np.cumsum(size)
        n = int(ends[-1])
        of = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        ids, after, before = single[np.frombuffer(b"".join(pieces), np.uint8)], np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - size] = -1
        waits, left, buckets, q = np.full(n, -1, np.int32), np.ones(n, bool), {}, self.queue

        def wait(at: np.ndarray) -> None:
            """Look up the pairs that start at these places, and put them into their buckets."""
            key = ids[at].astype(np.int64) << 32 | ids[after[at]]
            i = np.searchsorted(keys, key)
            i[i == len(keys)] = 0
            r = np.where(keys[i] == key, ranks[i], -1) if len(keys) else np.full(len(at), -1, np.int32)
            waits[at] = r
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for rank, part in zip(r[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True):
                if rank in buckets:
                    buckets[rank].append(part)
                else:
                    buckets[rank] = [part]
                    q.add(rank)

        wait(np.flatnonzero(after >= 0).astype(np.int32))
        while q.top:
            rank = q.take()
            at = np.concatenate(buckets.pop(rank))
            at = at[waits[at] == rank]  # others are stale
            if len(at) > 1:
                at = np.unique(at)
                first = np.concatenate([[True], of[at[1:]] != of[at[:-1]]])
                if not first.all():  # a merge may bring up a lower rank in the same pre-token
                    buckets[rank] = [at[~first]]
                    q.add(rank)
                    at = at[first]
            if not len(at):
                continue
            gone = after[at]
            waits[gone], left[gone], ids[at] = -1, False, rank
            end = after[at] = after[gone]
            waits[at] = -1
            inner = at[end >= 0]
            before[end[end >= 0]] = inner
            back = before[at]
            wait(np.concatenate([inner, back[back >= 0]]))
        data, upto = ids[left].astype("<u4").tobytes(), np.cumsum(np.bincount(of[left], minlength=len(pieces))) * 4
        start = 0
        for stop in upto.tolist():
            yield data[start:stop]
            start = stop

    def meet(self, tokens: Iterable[list[str]]) -> None:
        """Remember the ids of all pre-tokens in these lists."""
        new = {t for ts in tokens for t in ts if t not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
        short = [(t, p) for t in new if len(p := t.encode()) <= SHORT and p not in self.ranks]
        if len(short) >= MANY:
            self.known.update(zip([t for t, _ in short], self.merge_many([p for _, p in short]), strict=True))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """encode() of each text; texts of TOGETHER characters are looked at together."""
        run = self._encode_part if self.memory is None else self._encode_split
        part, size = [], 0
        for t in texts:
            if len(t) > TOGETHER:
                yield from run(part)
                part, size = [], 0
                yield self._encode_long(t)
                continue
            part.append(t)
            size += len(t)
            if size > TOGETHER:
                yield from run(part)
                part, size = [], 0
        yield from run(part)

    def _encode_split(self, texts: list[str]) -> Iterator[bytes]:
        """All pre-tokens of texts as numbers: no Python object for each of them."""
        if not texts:
            return
        s = Split(texts)
        first, of = s.distinct()
        at = self.memory.find(s.hash[first], s.check[first])
        # a hash that stands for another pre-token here: its texts go by their pre-tokens' text
        s.mark_long(np.flatnonzero((at == CLASH)[of]))
        new = np.flatnonzero(at == ABSENT)
        if len(self.memory.hash) + len(new) > RECALLED:
            self.memory, new = Memory(), np.arange(len(first))
        if len(new):
            self.memory.add(s.hash[first[new]], s.check[first[new]], self._ids_of([s.token(i) for i in first[new].tolist()]))
            at = self.memory.find(s.hash[first], s.check[first])
        at = np.maximum(at, 0)  # those of a clash aren't used
        begin, count = self.memory.begin[at], self.memory.count[at]
        first_of = np.concatenate([[0], s.last])
        for i in range(0, len(texts), 200):
            upto = first_of[i : i + 201]
            tokens = of[upto[0] : upto[-1]]
            n = count[tokens]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = self.memory.ids[np.repeat(begin[tokens] - ends[:-1], n) + np.arange(ends[-1])]
            cuts = ends[upto - upto[0]].tolist()
            for k in range(len(upto) - 1):
                yield ids[cuts[k] : cuts[k + 1]].tobytes() if i + k not in s.long else self._encode_with_long(texts[i + k])

    def _encode_with_long(self, text: str) -> bytes:
        """A text with pre-tokens that their numbers don't tell apart."""
        return b"".join(map(self.known.__getitem__, self.find(text)))

    def _ids_of(self, tokens: list[str]) -> list[bytes]:
        """Packed ids; none for a long pre-token, whose text goes another way."""
        pieces = [t.encode() if len(t) <= SHORT else b"" for t in tokens]
        rest = [p for p in pieces if p and p not in self.ranks]
        merged = self.merge_many(rest) if len(rest) >= MANY else (b"".join([self.packed[i] for i in self.merge(p)]) for p in rest)
        return [self.packed[r] if (r := self.ranks.get(p)) is not None else next(merged) if p else b"" for p in pieces]

    def _encode_part(self, texts: list[str]) -> Iterator[bytes]:
        found = [self.find(t) for t in texts]
        self.meet(found)
        for tokens in found:
            yield b"".join(map(self.known.__getitem__, tokens))

    def _encode_long(self, text: str) -> bytes:
        """Without a list of all its pre-tokens."""
        out, each = bytearray(), (m.group() for m in self.each(text))
        while tokens := list(islice(each, 100_000)):
            self.meet([tokens])
            out += b"".join(map(self.known.__getitem__, tokens))
        return bytes(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(1)
def _classes() -> np.ndarray:
    """By code point: 0 letter, 1 number, 2 other, 3 white space, as the pattern sees them."""
    import regex

    out = np.full(0x110000, 2, np.uint8)
    for kind, pattern in ((0, r"\p{L}"), (1, r"\p{N}"), (3, r"\s")):
        every = regex.compile(pattern + "+")
        for low, high in ((0, 0xD800), (0xE000, 0x110000)):
            for m in every.finditer(np.arange(low, high, dtype="<u4").tobytes().decode("utf-32-le")):
                out[low + m.start() : low + m.end()] = kind
    return out


@lru_cache(1)
def _weights() -> np.ndarray:
    """Powers of two odd multipliers, for hashes of up to SHORT code points."""
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 63, (2, SHORT), dtype=np.uint64) << np.uint64(1) | np.uint64(1)


class Split:
    """The pre-tokens of texts under PATTERN.

    start: where each begins among all code points; last: pre-tokens up to the end of each text; hash and
    check: two numbers that tell short pre-tokens apart; long: texts that are encoded by their pre-tokens' text, as
    they have some of over SHORT code points, or of a hash that is another's.
    """

    def __init__(self, texts: list[str]):
        self.text = "\0".join([*texts, ""])
        c = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        kind = _classes()[c]
        kind[ends] = 4  # what stands between texts
        before, after = np.empty_like(kind), np.empty_like(kind)
        before[0], before[1:] = 4, kind[:-1]
        after[-1], after[:-1] = 4, kind[1:]
        space = kind == 3
        # one space goes with what follows; of several the last is apart from the others
        led = np.zeros(len(c), bool)
        led[1:] = (c[:-1] == 32) & space[:-1]
        begins = np.where(space, (before != 3) | (after < 3), (before != kind) & ~(led & (kind < 3)) | (kind == 4))
        # 's 't 're 've 'm 'll 'd, where an apostrophe begins a pre-token
        i = np.flatnonzero((c == 39) & begins & (after == 0))
        if len(i):
            padded = np.concatenate([c, np.zeros(2, np.uint32)])
            a, b = padded[i + 1], padded[i + 2]
            n = np.where(np.isin(a, [ord(x) for x in "stmd"]), 1, np.where(((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")), 2, 0))
            i, n = i[n > 0], n[n > 0]
            begins[i + 1] = False
            rest = i + 1 + n
            begins[rest[kind[rest] == 0]] = True
        start = np.flatnonzero(begins)
        length = np.diff(np.append(start, len(c)))
        real = kind[start] != 4
        self.last = np.cumsum(real)[np.searchsorted(start, ends)]
        del kind, before, after, space, led, begins
        self.hash, self.check = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
        for i in range(0, len(start), 100_000):
            self._number(c, start[i : i + 100_000], length[i : i + 100_000], i)
        self.start, self.length, self.hash, self.check = start[real], length[real], self.hash[real], self.check[real]
        self.long = set(np.searchsorted(self.last, np.flatnonzero(self.length > SHORT), "right").tolist())

    def _number(self, c: np.ndarray, start: np.ndarray, length: np.ndarray, at: int) -> None:
        x = c[start[0] : start[-1] + length[-1]].astype(np.uint64) + np.uint64(1)
        start = start - start[0]
        within = (np.arange(len(x)) - np.repeat(start, length)) & (SHORT - 1)
        for w, out in zip(_weights(), (self.hash, self.check), strict=True):
            h = np.add.reduceat(x * w[within], start) + length.astype(np.uint64) * w[0]
            out[at : at + len(start)] = np.where(length > SHORT, np.uint64(0), h ^ (h >> np.uint64(32)))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The first place of each distinct pre-token, and which of them each one is.

        Texts with a pre-token that shares its hash with another one are marked as long.
        """
        _, first, of = np.unique(self.hash, return_index=True, return_inverse=True)
        self.mark_long(np.flatnonzero(self.check[first][of] != self.check))
        return first, of

    def mark_long(self, places: np.ndarray) -> None:
        self.long.update(np.searchsorted(self.last, places, "right").tolist())

    def token(self, i: int) -> str:
        return self.text[self.start[i] : self.start[i] + self.length[i]]


class Memory:
    """Ids of pre-tokens by hash: sorted arrays, a few dozen bytes for each."""

    def __init__(self):
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Entries; ABSENT where there is none, CLASH where it is another pre-token's."""
        if not len(self.hash):
            return np.full(len(hashes), ABSENT)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] != hashes, ABSENT, np.where(self.check[at] == checks, at, CLASH))

    def add(self, hashes: np.ndarray, checks: np.ndarray, ids: list[bytes]) -> None:
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = len(self.ids) + np.cumsum(count) - count
        order = np.argsort(new := np.concatenate([self.hash, hashes]), kind="stable")
        self.hash, self.check = new[order], np.concatenate([self.check, checks])[order]
        self.begin, self.count = np.concatenate([self.begin, begin])[order], np.concatenate([self.count, count])[order]
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])


class _Known(dict):
    """Ids of pre-tokens met before; starts anew when full, so memory is bounded."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> bytes:
        v = self.vocabulary
        ids = b"".join([v.packed[i] for i in v.merge(token.encode())])
        if len(token) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = ids
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, filter(bytes.strip, f))}


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read once in each Python worker; every machine has the file at this path, as a package file."""
    return Vocabulary(read_ranks(path), pattern)


def _joined(pieces: Iterable[bytes]) -> tuple[np.ndarray, bytearray]:
    """Pieces after one another, and where each ends, without a list of them in between."""
    data, ends = bytearray(), [0]
    for p in pieces:
        data += p
        ends.append(len(data))
    return np.array(ends, np.int64), data


def _texts(batch: pa.Array) -> Iterator[str]:
    for at in range(0, len(batch), 500):
        for t in batch.slice(at, 500).to_pylist():
            yield t or ""


def _binary(pieces: Iterable[bytes]) -> pa.Array:
    ends, data = _joined(pieces)
    if len(data) >= 1 << 31:
        raise ValueError("a batch of more than 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids of a text as little-endian unsigned 32-bit integers in a binary; null and empty texts have none."""

    @F.arrow_udf("binary")
    def ids(batch: pa.Array) -> pa.Array:
        return _binary(vocabulary(path, pattern).encode_all(_texts(batch)))

    return ids(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that ids, packed in a binary or as an array of int, stand for. Null: none."""

    @F.arrow_udf("binary")
    def out(batch: pa.Array) -> pa.Array:
        v = vocabulary(path, pattern)
        if not pa.types.is_list(batch.type):
            return _binary(v.decode(i.as_buffer()) if i.is_valid else b"" for i in batch)
        return _binary(v.decode(i.values.to_numpy().astype("<u4")) if i.is_valid else b"" for i in batch)

    return out(ids)


def encode_array(text: Column, path: str, pattern: str) -> Column:
    """Ids of a text as an array of int; null and empty texts have none."""

    @F.arrow_udf("array<int>")
    def ids(batch: pa.Array) -> pa.Array:
        ends, data = _joined(vocabulary(path, pattern).encode_all(_texts(batch)))
        return pa.ListArray.from_arrays(pa.array((ends // 4).astype(np.int32)), pa.array(np.frombuffer(data, "<i4")))

    return ids(text)


def encode_and_back(text: Column, path: str, pattern: str) -> Column:
    """ids, as by encode_array(), and the SHA-256 (lowercase hex) of the bytes that they decode to, text by text."""

    @F.arrow_udf("struct<ids array<int>, decoded_sha256 string>")
    def both(batch: pa.Array) -> pa.Array:
        v, digests = vocabulary(path, pattern), []

        def encoded() -> Iterator[bytes]:
            for ids in v.encode_all(_texts(batch)):
                digests.append(sha256(v.decode(ids)).hexdigest())
                yield ids

        ends, data = _joined(encoded())
        ids = pa.ListArray.from_arrays(pa.array((ends // 4).astype(np.int32)), pa.array(np.frombuffer(data, "<i4")))
        return pa.StructArray.from_arrays([ids, pa.array(digests, pa.string())], ["ids", "decoded_sha256"])

    return both(text)


def bpe_round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """df with ids (binary), n_tokens and decoded (binary), which equals the text in UTF-8.

    Special tokens are ordinary text. Null and empty texts have no ids. Rows may repeat; an empty table
    gives an empty table. Columns named like a result are replaced.
    """
    df = without(df, "ids", "n_tokens", "decoded")
    out = df.withColumn("ids", encode(F.col(text_col), path, pattern))
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")).withColumn("decoded", decode(F.col("ids"), path, pattern))
