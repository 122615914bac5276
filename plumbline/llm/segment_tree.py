"""BPE by a segment tree over byte positions.

A leaf holds the rank of the pair that begins at its byte, the root the leftmost lowest
one. A merge changes three leaves: the pair that goes, the pair that begins at the new
symbol, and the pair that ends there; each change climbs the tree in a logarithm of the
width. Pre-tokens of like length share numpy arrays, one tree per row, and make their
next merge together; long ones have a tree of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from plumbline.llm.array_merging import binary_arrays
from plumbline.llm.ragged import offsets_of, take
from plumbline.llm.vocabulary import NO_RANK, Vocabulary

#: Widths that share arrays; longer pre-tokens are encoded one at a time.
WIDEST = 128
#: Cells (rows times width) of one set of arrays.
CELLS = 2_000_000

#: Bits of a place, as many as a byte array of 2 GiB needs; ranks take the other 32.
PLACE_BITS = 31
_PLACE = (1 << PLACE_BITS) - 1
_NOTHING = np.int64(int(NO_RANK) << PLACE_BITS)


def _keys(ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Order by rank, then from the left."""
    return np.where(ranks < NO_RANK, (ranks << PLACE_BITS) | places, _NOTHING)


def _encode_rows(vocabulary: Vocabulary, symbols: np.ndarray, lengths: np.ndarray):
    """Merge rows of byte symbols (rows x width, filled with -1): symbols, -1 where merged."""
    rows, width = symbols.shape
    places = np.arange(width)
    live = places[None, :] < lengths[:, None]
    following = np.where(places[None, :] + 1 < lengths[:, None], places[None, :] + 1, -1)
    previous = np.where(live, places[None, :] - 1, -1)
    tree = np.full((rows, 2 * width), _NOTHING, dtype=np.int64)
    at_row, at = np.nonzero(following >= 0)
    ranks = vocabulary.pairs.ranks(symbols[at_row, at], symbols[at_row, at + 1])
    tree[at_row, width + at] = _keys(ranks, at)
    for node in range(width - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
    active = np.arange(rows)
    flat = tree.reshape(-1)
    while True:
        active = active[tree[active, 1] < _NOTHING]
        if not len(active):
            return symbols
        p = tree[active, 1] & _PLACE
        q = following[active, p]
        number = vocabulary.pairs.find(symbols[active, p], symbols[active, q])
        symbols[active, p] = vocabulary.pairs.merged[number]
        symbols[active, q] = -1
        after = following[active, q]
        following[active, p] = after
        has_after = after >= 0
        previous[active[has_after], after[has_after]] = p[has_after]
        tree[active, width + q] = _NOTHING
        tree[active, width + p] = _NOTHING
        before = previous[active, p]
        has_before = before >= 0
        left = np.concatenate([p[has_after], before[has_before]])
        right = np.concatenate([after[has_after], p[has_before]])
        of = np.concatenate([active[has_after], active[has_before]])
        ranks = vocabulary.pairs.ranks(symbols[of, left], symbols[of, right])
        tree[of, width + left] = _keys(ranks, left)
        base = np.concatenate([active, active, active[has_before]]) * (2 * width)
        node = np.concatenate([q, p, before[has_before]]) + width
        for _ in range(width.bit_length() - 1):
            node >>= 1
            child = base + 2 * node
            flat[base + node] = np.minimum(flat[child], flat[child + 1])


def _encode_long(vocabulary: Vocabulary, data: np.ndarray) -> np.ndarray:
    """The same for one long pre-token, with plain lists: steps are single numbers."""
    length = len(data)
    width = 1 << (length - 1).bit_length()
    symbols = vocabulary.byte_ids[data]
    nothing = int(_NOTHING)
    ranks = vocabulary.pairs.ranks(symbols[:-1], symbols[1:])
    leaves = np.full(width, nothing, dtype=np.int64)
    leaves[: length - 1] = _keys(ranks, np.arange(length - 1))
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = [nothing, *np.concatenate(levels[::-1]).tolist()]
    symbols = symbols.tolist()
    following = [*range(1, length), -1]
    previous = list(range(-1, length - 1))
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def pair(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in known:
            number = int(vocabulary.pairs.find(np.array([a]), np.array([b]))[0])
            known[a, b] = (
                (int(vocabulary.pairs.rank[number]), int(vocabulary.pairs.merged[number]))
                if number >= 0
                else (-1, -1)
            )
        return known[a, b]

    def put(place: int, key: int) -> None:
        node = width + place
        tree[node] = key
        while node > 1:
            node >>= 1
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def pair_key(place: int) -> int:
        if place < 0 or following[place] < 0:
            return nothing
        rank, _ = pair(symbols[place], symbols[following[place]])
        return nothing if rank < 0 else (rank << PLACE_BITS) | place

    while tree[1] < nothing:
        p = tree[1] & _PLACE
        q = following[p]
        symbols[p] = pair(symbols[p], symbols[q])[1]
        symbols[q] = -1
        following[p] = following[q]
        if following[p] >= 0:
            previous[following[p]] = p
        put(q, nothing)
        put(p, pair_key(p))
        if previous[p] >= 0:
            put(previous[p], pair_key(previous[p]))
    return np.array(symbols)


def encode(vocabulary: Vocabulary, distinct: pa.Array):
    """Token ids of every pre-token: (ids, offsets)."""
    data, offsets = binary_arrays(distinct)
    lengths = np.diff(offsets)
    found_rows, found_ids, found_lengths = [], [], []

    def keep(rows: np.ndarray, symbols: np.ndarray) -> None:
        alive = symbols >= 0
        found_rows.append(rows)
        found_ids.append(symbols[alive])
        found_lengths.append(alive.sum(axis=1))

    single = np.flatnonzero(lengths <= 1)
    found_rows.append(single)
    found_ids.append(vocabulary.byte_ids[data[offsets[single[lengths[single] == 1]]]])
    found_lengths.append(lengths[single])
    width = 2
    while width <= WIDEST:
        rows = np.flatnonzero((lengths > width // 2) & (lengths <= width) & (lengths > 1))
        step = max(1, CELLS // width)
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            places = np.arange(width)[None, :]
            live = places < lengths[some][:, None]
            at = np.where(live, offsets[some][:, None] + places, 0)
            symbols = np.where(live, vocabulary.byte_ids[data[at]], -1)
            keep(some, _encode_rows(vocabulary, symbols, lengths[some]))
        width *= 2
    for row in np.flatnonzero(lengths > WIDEST):
        symbols = _encode_long(vocabulary, data[offsets[row] : offsets[row + 1]])
        keep(np.array([row]), symbols[None, :])
    rows = np.concatenate(found_rows)
    order = np.empty(len(rows), dtype=np.int64)
    order[rows] = np.arange(len(rows))
    return take(np.concatenate(found_ids), offsets_of(np.concatenate(found_lengths)), order)


def decode(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray):
    """The bytes that rows of ids spell: (bytes, offsets)."""
    data, token_offsets = take(vocabulary.token_bytes, vocabulary.token_offsets, ids)
    return data, token_offsets[offsets]
