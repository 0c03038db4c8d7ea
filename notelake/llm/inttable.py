"""A hash table of 64-bit integers that is probed for many keys at once."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)


class IntTable:
    """Open addressing over distinct ``keys`` of 0 or more; a key's row is its place in ``keys``."""

    def __init__(self, keys: np.ndarray, room: int = 3):
        keys = np.asarray(keys, np.int64)
        self.bits = max(10, int(len(keys) * room).bit_length())
        self.none = len(keys)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.row = np.full(1 << self.bits, self.none, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = first[free[first]]
            self.keys[at[put]], self.row[at[put]] = keys[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _STEP) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of ``keys`` (int64); ``none`` for absent ones, those under 0 included."""
        at = self._slot(keys)
        seen = self.keys[at]
        hit = seen == keys
        out = np.where(hit, self.row[at], np.int32(self.none))
        go = np.flatnonzero(~hit & (seen != -1))
        while len(go):
            at[go] = (at[go] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[go]]
            hit = seen == keys[go]
            out[go[hit]] = self.row[at[go[hit]]]
            go = go[~hit & (seen != -1)]
        return out
