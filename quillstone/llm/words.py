"""Words of many texts at once, as numpy arrays, for operators that label chains of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

ALL = 0x110000


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and its lower case where that is one code point."""
    letter = np.fromiter((chr(c).isalpha() for c in range(ALL)), bool, ALL)
    lower = np.arange(ALL, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return letter, lower


@lru_cache(1)
def _powers() -> np.ndarray:
    p = np.empty(64, np.uint64)
    x = 1
    for i in range(64):
        p[i] = x
        x = x * 0x9E3779B97F4A7C15 % (1 << 64)
    return p


class Words:
    """Runs of letters, in lower case, of a list of texts.

    chars: all code points with a line break between texts; start, length: of each word in chars;
    doc: each word's text; first: where each text starts in chars; offset: each text's first word,
    and the number of words at the end.
    """

    def __init__(self, texts: list[str]):
        letter, lower = _tables()
        self.chars = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        self.is_letter = letter[self.chars]
        self.chars = lower[self.chars]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], self.is_letter, [False]]).astype(np.int8)))
        self.start, self.length = edges[0::2], edges[1::2] - edges[0::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        self.doc = np.searchsorted(self.first, self.start, "right") - 1
        self.offset = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in chars of all letters, and where each word begins among them."""
        return np.flatnonzero(self.is_letter), np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        at, begin = self.letters()
        within = np.arange(len(at)) - np.repeat(begin, self.length)
        h = np.add.reduceat((self.chars[at].astype(np.uint64) + np.uint64(within.size and 1)) * _powers()[within & 63], begin)
        h ^= (self.length.astype(np.uint64) << np.uint64(56)) ^ (h >> np.uint64(29))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def chunks(texts: list, most: int) -> Iterator[tuple[int, list[str]]]:
    """Slices of texts with about so many characters, or one long text; nulls become empty."""
    at, size, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > most:
            yield at, part
            at, size, part = i, 0, []
        part.append(t)
        size += len(t)
    if part:
        yield at, part


#: Characters that are labelled together, and that are turned into numbers together. Chains gain from
#: many texts side by side; what a character takes on the way to its word's numbers is ten times as much.
TOGETHER, PIECE = 2_000_000, 500_000


class Scan:
    """Words of many texts with what of() makes of each word, got from a few texts at a time.

    doc: each word's text; begin, length: its place in that text; offset: each text's first word.
    """

    def __init__(self, texts: list, of: Callable[[Words], np.ndarray]):
        parts = []
        for at, part in chunks(texts, PIECE):
            w = Words(part)
            parts.append((w.doc + at, w.start - w.first[w.doc], w.length, of(w)))
        if not parts:
            w = Words([])
            parts = [(w.doc, w.start, w.length, of(w))]
        self.doc, self.begin, self.length, self.of = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.offset = np.searchsorted(self.doc, np.arange(len(texts) + 1))


class Chains:
    """Chains of unequal length walked side by side: step t holds the chains longer than t, longest first."""

    def __init__(self, offset: np.ndarray):
        size = np.diff(offset)
        order = np.argsort(-size, kind="stable")
        self.order = order[: np.count_nonzero(size)]
        self.begin, self.size = offset[:-1][self.order], size[self.order]
        longest = int(self.size[0]) if len(self.size) else 0
        #: chains that have a step t
        self.active = len(self.size) - np.searchsorted(self.size[::-1], np.arange(longest), "right")

    def forward(self) -> Iterator[tuple[int, np.ndarray]]:
        for n, t in zip(self.active.tolist(), range(len(self.active))):
            yield n, self.begin[:n] + t

    def backward(self) -> Iterator[tuple[int, np.ndarray]]:
        for t in range(len(self.active) - 1, -1, -1):
            n = int(self.active[t])
            yield n, self.begin[:n] + t
