"""Ragged arrays: one flat numpy array of values and the offsets of its rows."""

from __future__ import annotations

import numpy as np


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Row offsets of rows with the given lengths."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return offsets


def take(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray):
    """The given rows, in that order and as often as named: (values, offsets)."""
    starts = offsets[rows]
    lengths = offsets[rows + 1] - starts
    taken = offsets_of(lengths)
    places = np.arange(taken[-1], dtype=np.int64)
    places += np.repeat(starts - taken[:-1], lengths)
    return values[places], taken


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each row; an empty row has 0."""
    total = np.zeros(len(values) + 1, dtype=np.result_type(values.dtype, np.int64))
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
