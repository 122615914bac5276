"""NumPy helpers that run inside tasks: unit rows and the best matches of a block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DECIMALS = 6
# Similarities closer than this may swap when rounded.
SLACK = 2e-6
CHUNK_VALUES = 4_000_000
GROUP_COLUMNS = 32


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of unit rows in double precision; zero rows stay zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if rows == 0:
        return values.reshape(0, 0)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != lengths[0]).any():
        raise ValueError("vectors differ in length")
    return unit_matrix(values.reshape(rows, -1))


def unit_matrix(matrix: np.ndarray) -> np.ndarray:
    """The rows at length one; zero rows stay zero."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return matrix / norms


def keep_best(rows, similarities, ids, k):
    """Of (row, similarity, id) triples, the k best per row in order, and their ranks."""
    order = np.lexsort((ids, -similarities, rows))
    rows, similarities, ids = rows[order], similarities[order], ids[order]
    first = np.searchsorted(rows, rows, side="left")
    rank = np.arange(len(rows)) - first
    kept = rank < k
    return rows[kept], similarities[kept], ids[kept], rank[kept] + 1


def lower_limit(block, k):
    """Per row a value that at least k entries reach, close to the k-th largest.

    Taken from the maxima of groups of columns: the k-th largest of those is
    reached by k entries, and finding it costs little more than one pass.
    """
    rows, columns = block.shape
    if columns <= k:
        return np.full(rows, -np.inf)
    per_group = GROUP_COLUMNS if columns >= 4 * k * GROUP_COLUMNS else 1
    grouped = columns // per_group * per_group
    maxima = block[:, :grouped].reshape(rows, per_group, -1).max(axis=1)
    return np.partition(maxima, -k, axis=1)[:, -k]


def best_matches(queries, corpus, ids, k, floor=None):
    """The k most similar corpus rows per query row, ties by smaller id.

    Works through the queries in chunks, so the similarity matrix stays small.
    With ``floor``, matches clearly below a query's floor are left out.
    """
    parts = []
    step = max(1, CHUNK_VALUES // max(1, len(corpus)))
    for start in range(0, len(queries), step):
        block = queries[start : start + step] @ corpus.T
        limit = lower_limit(block, k) - SLACK
        if floor is not None:
            limit = np.maximum(limit, floor[start : start + step] - SLACK)
        reached = np.flatnonzero(block >= limit[:, None])
        rows, columns = np.divmod(reached, max(1, block.shape[1]))
        similarities = np.round(block[rows, columns], DECIMALS) + 0.0
        parts.append(keep_best(rows + start, similarities, ids[columns], k))
    if not parts:
        empty = np.empty(0, dtype=np.int64)
        return empty, np.empty(0), empty, empty
    return tuple(np.concatenate(part) for part in zip(*parts))


def angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))

