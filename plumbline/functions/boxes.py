"""Short vectors in a balanced tree of boxes, searched by whole batches of queries.

Unit rows that are at least as similar as s are at most sqrt(2 - 2 s) apart, so a box that is
farther from a query holds nothing for it. In few dimensions boxes that hold a few dozen rows
rule nearly everything out; balls and angles around a centre do not.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np

from plumbline.functions.nearest import DECIMALS, SLACK, best_matches, keep_best

#: Longest vectors that boxes are used for, and the smallest corpus.
BOX_LENGTH = 16
TREE_ROWS = 4096
#: Rows of a leaf at most, and the leaves of a query that give it its first limit.
LEAF_ROWS = 32
FIRST_LEAVES = 4
#: Queries worked on at once, and pairs of a query and a box, or a query and a leaf.
QUERIES = 1024
TESTS = 1 << 17
VISITS = 1 << 13


def apart(units: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of rows from boxes, by the last axis."""
    gap = np.maximum(np.maximum(low - units, units - high), 0.0)
    return np.einsum("...i,...i->...", gap, gap)


def farthest(similarity):
    """The squared distance up to which something may still be as similar."""
    return 2 - 2 * (similarity - SLACK) + 1e-9


def halved(points: np.ndarray, rows: np.ndarray, depth: int) -> list[np.ndarray]:
    """``rows`` cut ``depth`` times in halves at the median of the widest dimension."""
    if depth == 0:
        return [rows]
    values = points[rows]
    middle = len(rows) // 2
    rows = rows[np.argpartition(values[:, values.var(axis=0).argmax()], middle)]
    return halved(points, rows[:middle], depth - 1) + halved(points, rows[middle:], depth - 1)


class Table:
    """Corpus rows as they are; every query is compared with all of them."""

    def __init__(self, units: np.ndarray, ids: np.ndarray):
        self.units, self.ids = units, ids

    def search(self, units: np.ndarray, k: int, floor: np.ndarray | None = None):
        return best_matches(units, self.units, self.ids, k, floor)


class BoxTree:
    """Corpus rows in leaves of at most ``LEAF_ROWS``, and the boxes of all inner nodes."""

    def __init__(self, units: np.ndarray, ids: np.ndarray):
        depth = max(0, math.ceil(math.log2(len(units) / LEAF_ROWS)))
        leaves = halved(units, np.arange(len(units)), depth)
        width = max(len(leaf) for leaf in leaves)
        # a leaf's spare places repeat its first row, and are not looked at
        rows = np.stack([np.concatenate([leaf, np.repeat(leaf[:1], width - len(leaf))]) for leaf in leaves])
        self.taken = np.arange(width) < np.array([len(leaf) for leaf in leaves])[:, None]
        self.vectors, self.ids = units[rows], ids[rows]
        # by level, the root first
        self.boxes = [(self.vectors.min(axis=1), self.vectors.max(axis=1))]
        for _ in range(depth):
            low, high = self.boxes[0]
            shape = (-1, 2, units.shape[1])
            self.boxes.insert(0, (low.reshape(shape).min(axis=1), high.reshape(shape).max(axis=1)))

    @cached_property
    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        return self.vectors[self.taken], self.ids[self.taken]

    def search(self, units: np.ndarray, k: int, floor: np.ndarray | None = None):
        """As ``best_matches``."""
        parts = []
        for start in range(0, len(units), QUERIES):
            part = units[start : start + QUERIES]
            limit = self._limit(part, k) if floor is None else floor[start : start + QUERIES]
            rows, *found = self._search(part, k, limit)
            parts.append((rows + start, *found))
        if not parts:
            return best_matches(units, *self.flat, k)
        return tuple(np.concatenate(part) for part in zip(*parts))

    def _limit(self, units, k) -> np.ndarray:
        """What the k-th match of every query has at least, by a few leaves."""
        limit = np.full(len(units), -2.0)
        rows, similarities, _, rank = self._compared(units, *self._first(units), k, limit)
        limit[rows[rank == k]] = similarities[rank == k]
        return limit

    def _search(self, units, k, limit):
        rows, leaves = self._within(units, farthest(limit))
        if 4 * len(rows) > len(units) * len(self.ids):
            return best_matches(units, *self.flat, k, limit)
        return self._compared(units, rows, leaves, k, limit)

    def _first(self, units) -> tuple[np.ndarray, np.ndarray]:
        """A few leaves near each query."""
        nodes = np.zeros((len(units), 1), dtype=np.int64)
        for low, high in self.boxes[1:]:
            nodes = np.concatenate([2 * nodes, 2 * nodes + 1], axis=1)
            if nodes.shape[1] > FIRST_LEAVES:
                gaps = apart(units[:, None], low[nodes], high[nodes])
                nearest = np.argpartition(gaps, FIRST_LEAVES - 1, axis=1)[:, :FIRST_LEAVES]
                nodes = np.take_along_axis(nodes, nearest, axis=1)
        return np.repeat(np.arange(len(units)), nodes.shape[1]), nodes.ravel()

    def _within(self, units, most) -> tuple[np.ndarray, np.ndarray]:
        """Every query with every leaf whose box is within the query's ``most``."""
        rows, nodes = np.arange(len(units)), np.zeros(len(units), dtype=np.int64)
        for low, high in self.boxes[1:]:
            rows, nodes = np.repeat(rows, 2), np.repeat(2 * nodes, 2)
            nodes[1::2] += 1
            kept = [
                apart(units[rows[part]], low[nodes[part]], high[nodes[part]]) <= most[rows[part]]
                for part in _slices(len(rows), TESTS)
            ]
            kept = np.concatenate(kept) if kept else np.empty(0, dtype=bool)
            rows, nodes = rows[kept], nodes[kept]
        return rows, nodes

    def _compared(self, units, rows, leaves, k, limit):
        parts = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        for part in _slices(len(rows), VISITS):
            leaf, row = leaves[part], rows[part]
            similar = np.matmul(self.vectors[leaf], units[row][:, :, None])[:, :, 0]
            reached = (similar >= (limit[row] - SLACK)[:, None]) & self.taken[leaf]
            visit, place = np.nonzero(reached)
            values = np.round(similar[visit, place], DECIMALS) + 0.0
            parts.append((row[visit], values, self.ids[leaf[visit], place]))
        return keep_best(*(np.concatenate(part) for part in zip(*parts)), k)


def _slices(total: int, step: int) -> list[slice]:
    return [slice(start, start + step) for start in range(0, total, step)]


def searchable(units: np.ndarray, ids: np.ndarray) -> Table | BoxTree:
    """Corpus rows to be searched in a task, in boxes where these help."""
    if len(units) >= TREE_ROWS and units.shape[1] <= BOX_LENGTH:
        return BoxTree(units, ids)
    return Table(units, ids)
