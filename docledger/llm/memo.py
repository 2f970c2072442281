"""A bounded memory of what words encode to, kept by an executor's Python worker between batches."""

from __future__ import annotations

import numpy as np


class Memo:
    """Two-way cache from 64-bit word hashes to int64 values. A word that finds no room is simply worked out again."""

    def __init__(self, bits: int = 21):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros((2, 1 << bits), np.uint64)
        self.values = np.zeros((2, 1 << bits), np.int64)
        self.known = np.zeros((2, 1 << bits), bool)

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h & self.mask).astype(np.int64), ((h >> np.uint64(32)) & self.mask).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the places of the hashes that are not known."""
        a, b = self._slots(h)
        values = self.values[0][a]
        missed = np.flatnonzero((self.keys[0][a] != h) | ~self.known[0][a])
        b = b[missed]
        second = (self.keys[1][b] == h[missed]) & self.known[1][b]
        values[missed[second]] = self.values[1][b[second]]
        return values, missed[~second]

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        a, b = self._slots(h)
        way = self.known[0][a].astype(np.int64)  # the second place takes what the first has no room for
        slot = np.where(way == 0, a, b)
        self.keys[way, slot], self.values[way, slot], self.known[way, slot] = h, values, True
        # two new words on one slot: the last key stays, and so must its value
        self.values[way, slot] = np.where(self.keys[way, slot] == h, values, self.values[way, slot])

    def clear(self) -> None:
        self.known[:] = False
