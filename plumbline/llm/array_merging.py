"""BPE by rank-synchronous merging of ragged numpy arrays.

All distinct pre-tokens lie in one flat array of symbol ids with row offsets. A round
finds every row's lowest pair rank and merges all pairs of that rank in the row at once;
rows without a pair that merges are finished. What survives are the tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from plumbline.llm.ragged import offsets_of
from plumbline.llm.vocabulary import NO_RANK, Vocabulary


def binary_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow array of (large) binaries without nulls."""
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _chosen(hit: np.ndarray) -> np.ndarray:
    """Of runs of neighbouring hits, which overlap, the first, third, fifth and so on."""
    places = np.flatnonzero(hit)
    if not len(places):
        return places
    opens = np.ones(len(places), dtype=bool)
    opens[1:] = np.diff(places) > 1
    run_start = np.maximum.accumulate(np.where(opens, np.arange(len(places)), 0))
    return places[(np.arange(len(places)) - run_start) % 2 == 0]


def merge(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray):
    """Token ids of every row of bytes: (ids, offsets)."""
    count = len(offsets) - 1
    done_rows, done_ids, done_lengths = [], [], []
    rows = np.arange(count)
    symbols = vocabulary.byte_ids[data]
    lengths = np.diff(offsets)
    ranks = None
    while len(rows):
        row_of = np.repeat(np.arange(len(rows)), lengths)
        if ranks is None:
            ranks = np.full(len(symbols), NO_RANK, dtype=np.int64)
            inner = np.flatnonzero(row_of[:-1] == row_of[1:])
            ranks[inner] = vocabulary.pairs.ranks(symbols[inner], symbols[inner + 1])
        starts = np.cumsum(lengths) - lengths
        filled = lengths > 0
        lowest = np.full(len(rows), NO_RANK, dtype=np.int64)
        if len(symbols):
            lowest[filled] = np.minimum.reduceat(ranks, starts[filled])
        active = lowest < NO_RANK
        if not active.all():
            over = ~active[row_of]
            done_rows.append(rows[~active])
            done_ids.append(symbols[over])
            done_lengths.append(lengths[~active])
            symbols, ranks = symbols[~over], ranks[~over]
            rows, lengths, lowest = rows[active], lengths[active], lowest[active]
            if not len(rows):
                break
            row_of = np.repeat(np.arange(len(rows)), lengths)
        at = _chosen(ranks == lowest[row_of])
        number = vocabulary.pairs.find(symbols[at], symbols[at + 1])
        symbols[at] = vocabulary.pairs.merged[number]
        kept = np.ones(len(symbols), dtype=bool)
        kept[at + 1] = False
        ranks[at] = -1  # to be found anew, as is the pair that ends here
        ranks[at[at > 0] - 1] = -1
        lengths = lengths - np.bincount(row_of[at], minlength=len(rows))
        symbols, ranks, row_of = symbols[kept], ranks[kept], row_of[kept]
        stale = np.flatnonzero(ranks < 0)
        last = np.append(row_of[1:] != row_of[:-1], True)
        ranks[stale[last[stale]]] = NO_RANK
        stale = stale[~last[stale]]
        ranks[stale] = vocabulary.pairs.ranks(symbols[stale], symbols[stale + 1])
    if not done_rows:
        return np.zeros(0, np.int64), np.zeros(count + 1, np.int64)
    return _in_order(np.concatenate(done_rows), np.concatenate(done_ids), np.concatenate(done_lengths))


def _in_order(rows: np.ndarray, ids: np.ndarray, lengths: np.ndarray):
    from plumbline.llm.ragged import take

    order = np.empty(len(rows), dtype=np.int64)
    order[rows] = np.arange(len(rows))
    return take(ids, offsets_of(lengths), order)


def encode(vocabulary: Vocabulary, distinct: pa.Array):
    """Ids of each distinct pre-token, the special string as its own id."""
    ids, offsets = merge(vocabulary, *binary_arrays(distinct))
    if vocabulary.special is None or not len(distinct):
        return ids, offsets
    import pyarrow.compute as pc

    place = pc.index(distinct, pa.scalar(vocabulary.special.encode(), distinct.type)).as_py()
    if place < 0:
        return ids, offsets
    before, after = ids[: offsets[place]], ids[offsets[place + 1] :]
    shorter = offsets[place + 1] - offsets[place] - 1
    ids = np.concatenate([before, [vocabulary.special_id], after])
    offsets = offsets.copy()
    offsets[place + 1 :] -= shorter
    return ids, offsets
