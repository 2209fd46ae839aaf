"""Distinct strings and the ids they stand for, kept in arrays: what tokenizers remember between batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def taken(flat: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the values of these rows one after the other, how many each has); row r is flat[ends[r] : ends[r + 1]]."""
    start = ends[rows]
    sizes = ends[rows + 1] - start
    to = np.cumsum(sizes)
    at = np.arange(to[-1] if len(to) else 0)
    at += np.repeat(start - to + sizes, sizes)
    return flat[at], sizes


def run_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of these sizes (0 for an empty run)."""
    before = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return before[ends] - before[ends - sizes]


class Memo:
    """Distinct strings (Arrow) and the ids of each, all in one array; entries are only added."""

    def __init__(self):
        self.keys = pa.array([], pa.string())
        self.flat, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: pa.Array) -> pa.Array:
        """Entry of each key, null if it is new."""
        return pc.index_in(keys, value_set=self.keys).cast(pa.int64())

    def add(self, rows: pa.Array, keys: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """New entries; the nulls of ``rows`` in turn become their numbers."""
        rows = pc.replace_with_mask(rows, pc.is_null(rows), pa.array(np.arange(len(self), len(self) + len(keys))))
        self.keys = pa.concat_arrays([self.keys, keys])
        self.ends = np.concatenate([self.ends, np.cumsum(sizes) + self.ends[-1]])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        return rows

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of these entries one after the other, how many each has)."""
        return taken(self.flat, self.ends, rows)
