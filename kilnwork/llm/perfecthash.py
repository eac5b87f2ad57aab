"""A minimal perfect hash over 64-bit keys: levels of bits in which a key that falls alone has its place, and the keys by place."""

from __future__ import annotations

import numpy as np

from .base import mix64

#: Bits of a level for every key that is still without a place.
GAMMA = 2


class PerfectHash:
    """Numbers distinct keys from 0 to n - 1. Every answer is checked against the key stored there, so a foreign key has none.

    A level has GAMMA bits a key; a key whose bit no other key of the level shares is placed there, the others go on to the next. A
    slot is the number of bits set before its own. That takes about 5 bits a key beside the keys.
    """

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, np.uint64)
        self.starts, words, rest = [], [], keys
        while len(rest):
            size = max(64, -(-len(rest) * GAMMA // 64) * 64)
            at = self.place(rest, len(words), size)
            bits = np.bincount(at, minlength=size) == 1
            self.starts.append((64 * sum(map(len, words)), size))
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            rest = rest[~bits[at]]
        self.words = np.concatenate(words) if words else np.zeros(1, np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.uint32)
        self.keys = np.zeros(len(keys), np.uint64)
        self.keys[self.slots(keys)] = keys

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A member's slot; of others any slot, or -1."""
        out, todo, left = np.full(len(keys), -1, np.int64), None, keys
        for level, (start, size) in enumerate(self.starts):
            at = self.place(left, level, size) + start
            word, shift = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
            found = (self.ranks[at >> 6] + below)[hit]
            out[hit if todo is None else todo[hit]] = found
            todo = np.flatnonzero(~hit) if todo is None else todo[~hit]
            left = left[~hit]
            if not len(left):
                break
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots; -1 for what is no key, by comparison with the stored ones."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        out = self.slots(keys)
        out[self.keys[out] != keys] = -1  # -1 itself reads the last key, which a missing one can't equal
        return out
