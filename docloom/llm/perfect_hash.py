"""A minimal perfect hash in numpy: levels of bit arrays, each keeping the keys that fall alone on a bit.

A key's index is the rank of its bit over all levels, so n keys get the indices 0..n-1. Stored, a key takes about 3.3
bits; looked up, 5: the set bits before each word of 64 are counted once, those within a word when they are asked for.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


def seed_of(level: int) -> np.uint64:
    return U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ seed_of(level)) % U(size)).astype(np.int64)


def build(keys: np.ndarray) -> list[tuple[int, bytes]]:
    """Levels (number of bits, bits from the lowest on) for distinct 64-bit keys; equal keys are an error."""
    rest, levels = np.unique(keys.astype(np.uint64)), []
    if len(rest) < len(keys):
        raise ValueError("two keys are equal")
    while len(rest):
        size = max(64, int(GAMMA * len(rest)) + 63 & ~63)
        at = place(rest, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append((size, np.packbits(alone, bitorder="little").tobytes()))
        rest = rest[~alone[at]]
    return levels


class Lookup:
    """Index of a key among those built; an absent key gets -1 or some other key's index."""

    def __init__(self, levels: list[tuple[int, bytes]]):
        self.levels, start = [], 0
        for size, packed in levels:
            words = np.frombuffer(packed, "<u8")
            ones = np.cumsum(np.bitwise_count(words), dtype=np.uint32)
            self.levels.append((size, words, np.concatenate(([0], ones[:-1])).astype(np.uint32) + np.uint32(start)))
            start += int(ones[-1])
        self.n = start

    @property
    def nbytes(self) -> int:
        return sum(words.nbytes + before.nbytes for _, words, before in self.levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (size, words, before) in enumerate(self.levels):
            if not len(open_):
                break
            at = place(keys[open_], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & U(1) == 1
            lower = word[hit] & ((U(1) << bit[hit]) - U(1))
            out[open_[hit]] = before[at[hit] >> 6].astype(np.int64) + np.bitwise_count(lower)
            open_ = open_[~hit]
        return out
