"""A bounded memory, per Python worker, of what was computed for distinct byte strings."""

from __future__ import annotations

import numpy as np


class Memo:
    """Row numbers by 64-bit key, at most `most` of them (callers ask for `room`). It only saves time and
    never decides a result."""

    def __init__(self, most: int = 2_000_000):
        self.most = most
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row number of each key, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rows[at], -1)

    def room(self, n: int) -> bool:
        """Whether n more keys fit."""
        return self.n + n <= self.most

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers for new, sorted keys."""
        rows = np.arange(self.n, self.n + len(keys))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, rows)
        self.n += len(keys)
        return rows
