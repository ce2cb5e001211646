"""Looking up many small things at once: a hash table in numpy, and ids of texts gathered from their distinct units."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


class Table:
    """A fixed map from whole numbers (0 to 2^62) to numbers that aren't negative, looked up by arrays. Keys are compared in full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 6).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self.place(keys)
        while len(left):  # each round a free place takes the first key that wants it, the others look further
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = first & (self.keys[at] < 0)
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            left, at = left[~put], (at[~put] + 1) & self.mask

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, or -1 where a key isn't held."""
        at = self.place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            left, at = left[on], at[on]
        return out


def gather(units: pa.ListArray, ids_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of lists of units, one after another, and where each list's begin and end.

    ids_of() gets the distinct units and returns their ids, one after another, and each unit's number of ids.
    """
    bounds = units.offsets.to_numpy() - units.offsets[0].as_py()
    coded = units.flatten().dictionary_encode()
    pool, size = ids_of(coded.dictionary)
    codes = coded.indices.to_numpy()
    n = size[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    small = np.int32 if max(ends[-1], len(pool)) < 1 << 30 else np.int64
    first = (np.cumsum(size) - size).astype(small)[codes] - ends[:-1].astype(small)
    return pool[np.arange(ends[-1], dtype=small) + np.repeat(first, n)], ends[bounds]
