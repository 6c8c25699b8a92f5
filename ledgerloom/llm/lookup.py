"""Many look-ups at once in tables of longs, for numpy code inside tasks."""

from __future__ import annotations

import numpy as np


class Lookup:
    """Non-negative longs to 32-bit values by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(1.4 * len(keys) + 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, values.dtype)
        left, at = np.arange(len(keys)), self.place(keys)
        while len(left):
            free = self.keys[at[left]] == -1
            self.keys[at[left[free]]] = keys[left[free]]
            won = self.keys[at[left]] == keys[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        at = self.place(keys)
        met = self.keys[at]
        same = met == keys
        out = np.where(same, self.values[at], self.values.dtype.type(default))
        left = np.flatnonzero(~same & (met != -1))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            met = self.keys[at[left]]
            hit = met == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (met != -1)]
        return out
