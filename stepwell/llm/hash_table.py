"""A vectorised hash table of arrays, for what a worker remembers between blocks."""

from __future__ import annotations

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Open addressing from 64-bit keys (0 counts as 1) to values >= 0; it doubles when it is half full."""

    def __init__(self, bits: int = 16):
        self.n = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)  # 0 marks a free place
        self.values = np.zeros(1 << bits, np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is or would be put, and what is there."""
        with np.errstate(over="ignore"):
            at = ((keys * _GOLD) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[at]
        off = np.flatnonzero((held != keys) & (held != 0))
        while len(off):
            at[off] = (at[off] + 1) & ((1 << self.bits) - 1)
            now = held[off] = self.keys[at[off]]
            off = off[(now != keys[off]) & (now != 0)]
        return at, held

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        at, held = self._places(np.maximum(keys, np.uint64(1)))
        return np.where(held != 0, self.values[at], -1)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not there yet."""
        keys = np.maximum(keys, np.uint64(1))
        self.n += len(keys)
        if 2 * self.n > 1 << self.bits:
            old = self.keys != 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self._make(max(self.bits + 1, (2 * self.n - 1).bit_length()))
        while len(keys):
            at, _ = self._places(keys)
            self.keys[at] = keys
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values = keys[~won], values[~won]
