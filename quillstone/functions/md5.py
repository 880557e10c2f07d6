"""MD5 of many short texts behind many leads: each step is one numpy operation over all of them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

#: Initial state, step constants, rotations and the message word that each step takes (RFC 1321).
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]


def padded(texts: Sequence[bytes], lead: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, words) of the texts that take equally many blocks. words: a row for each 32-bit word of the
    padded message, a column for each text; the first `lead` bytes of a message are left zero."""
    sizes, out = np.array([len(t) for t in texts], np.int64) + lead, []
    blocks = (sizes + 8) // 64 + 1
    for n in np.unique(blocks):
        at = np.flatnonzero(blocks == n)
        size, data = sizes[at], np.frombuffer(b"".join(texts[i] for i in at), np.uint8)
        own, row = size - lead, np.arange(len(at))
        raw = np.zeros((len(at), 64 * n), np.uint8)
        raw[np.repeat(row, own), np.arange(len(data)) - np.repeat(np.cumsum(own) - own, own) + lead] = data
        raw[row, size] = 0x80
        words = np.ascontiguousarray(raw.view("<u4").T)
        words[-2], words[-1] = size * 8 & 0xFFFFFFFF, size * 8 >> 32
        out.append((at, words))
    return out


def leads(texts: Sequence[bytes]) -> np.ndarray:
    """A row of 32-bit words for each lead; all are equally long."""
    return np.array([np.frombuffer(t + bytes(-len(t) % 4), "<u4") for t in texts])


def heads(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The first 32 bits of the hash of each lead (row) with each text (column): the number that its first
    eight hexadecimal digits write. Three steps of the last block don't touch them and are left out."""
    same = (words == words[:, :1]).all(axis=1)
    shape = len(before), words.shape[1]
    state = [np.full(shape, v, np.uint32) for v in START]
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for block in range(0, len(words), 16):
        last = block + 16 == len(words)
        a, b, c, d = [x.copy() for x in state]
        for i in range(61 if last else 64):
            if i < 16:  # c where b has a bit, else d
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:  # b where d has a bit, else c
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.bitwise_not(d, out=f)
                f |= b
                f ^= c
            f += a
            at, more = block + WORDS[i], SINES[i]
            if same[at]:
                more += int(words[at, 0])
            else:
                f += words[at]
            more = np.uint32(more & 0xFFFFFFFF)
            f += before[:, at : at + 1] + more if at < before.shape[1] else more
            np.left_shift(f, np.uint32(TURNS[i]), out=t)
            f >>= np.uint32(32 - TURNS[i])
            f |= t
            f += b
            a, d, c, b, f = d, c, b, f, a
        if last:
            return (state[0] + b).byteswap()
        for x, y in zip(state, (a, b, c, d), strict=True):
            x += y
    raise ValueError("no words")
