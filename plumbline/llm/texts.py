"""Whole texts of an Arrow batch as byte arrays, and the words in them.

Python tasks get Arrow batches and work on all texts of a batch at once: the UTF-8
bytes of neighbouring texts lie in one array, so finding and hashing words is a
handful of numpy passes, not a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken together until they have this many bytes.
PART_BYTES = 2_000_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD6E8FEB86659FD93


@dataclass
class Part:
    """Neighbouring texts of a batch: rows first..last, bytes, offsets of the texts."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def parts(column: pa.Array, part_bytes: int = PART_BYTES) -> Iterator[Part]:
    """A text column in parts; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + part_bytes, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        low, high = offsets[row], offsets[end]
        yield Part(row, data[low:high], offsets[row : end + 1] - low)
        row = end


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of unsigned 64-bit values."""
    values = values ^ (values >> np.uint64(32))
    values = values * _MULTIPLIER
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(32)
    return values


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash of an ordered pair of hashes."""
    return mixed(left * np.uint64(0xA24BAED4963EE407) + (right ^ (right >> np.uint64(31))))


_byte_codes = mixed(np.arange(1, 257, dtype=np.uint64))
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _running_products(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


class Hashes:
    """64-bit hashes of short slices of a byte array, by value alone.

    For slices of some hundred bytes at most: longer ones can be built that collide
    (``SliceHashes`` has no such limit). Prefix sums of byte codes times powers of an odd number: a slice is the
    difference of two sums, moved to the origin by the inverse power.
    """

    def __init__(self, data: np.ndarray):
        global _powers, _inverses
        n = len(data) + 1
        size = max(n, PART_BYTES + 1)
        if size <= len(_powers):
            powers, self._inverses = _powers, _inverses
        else:
            powers = _running_products(_ODD, size)
            self._inverses = _running_products(pow(_ODD, -1, 2**64), size)
            if size == PART_BYTES + 1:  # those of a longer text go with it
                _powers, _inverses = powers, self._inverses
        self._sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(_byte_codes[data] * powers[: n - 1], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at_origin = (self._sums[ends] - self._sums[starts]) * self._inverses[starts]
        return mixed(at_origin + (ends - starts).astype(np.uint64))

    def rolling(self, width: int) -> np.ndarray:
        """The hash of every slice of the given width, in order of its start."""
        n = len(self._sums) - width
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mixed((self._sums[width:] - self._sums[:n]) * self._inverses[:n] + np.uint64(width))


#: 8-byte pieces that ``SliceHashes`` works on at once.
PIECES_AT_ONCE = 1 << 18


class SliceHashes:
    """64-bit hashes of slices of any length, by value alone.

    A slice is cut into pieces of 8 bytes, the last one filled with zeros. Every piece is
    scrambled together with its number, and the sum of the pieces with the length. No
    power series is involved, so no text is built to collide in it, and memory does not
    grow with a slice.
    """

    def __init__(self, data: np.ndarray):
        self._data = data

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = np.asarray(ends) - starts
        pieces = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum((lengths + 7) // 8, out=pieces[1:])
        sums = np.zeros(len(lengths), dtype=np.uint64)
        for low in range(0, int(pieces[-1]), PIECES_AT_ONCE):
            number = np.arange(low, min(low + PIECES_AT_ONCE, int(pieces[-1])))
            first = int(np.searchsorted(pieces, low, side="right")) - 1
            last = int(np.searchsorted(pieces, number[-1], side="right")) - 1
            inside = np.minimum(pieces[first + 1 : last + 2], number[-1] + 1) - np.maximum(
                pieces[first : last + 1], low
            )
            owner = np.repeat(np.arange(first, last + 1), inside)
            number -= pieces[owner]
            sums_of = _piece_hashes(self._data, starts[owner] + 8 * number, ends[owner], number)
            filled = np.flatnonzero(inside)
            begins = (np.cumsum(inside) - inside)[filled]
            sums[first + filled] += np.add.reduceat(sums_of, begins)
        return mixed(sums + lengths.astype(np.uint64) * np.uint64(_ODD))


def _piece_hashes(data: np.ndarray, at: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The up to 8 bytes from each place, scrambled with the piece's number."""
    values = np.zeros(len(at), dtype=np.uint64)
    rest = ends - at
    last = len(data) - 1
    for i in range(8):
        byte = data[np.minimum(at + i, last)].astype(np.uint64) << np.uint64(8 * i)
        values |= np.where(rest > i, byte, np.uint64(0))
    salted = values + mixed(number.astype(np.uint64) + np.uint64(0x51ED2701))
    return mixed(salted) ^ mixed(salted * np.uint64(0xA24BAED4963EE407) + np.uint64(1))


#: Which bytes part words: blank, and tab to carriage return.
IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Words:
    """Word slices of a part in order; ``offsets`` are those of the texts' words."""

    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def words(part: Part) -> Words:
    """Runs of bytes that are no separators; words never cross texts."""
    n = len(part.data)
    inside = ~IS_SEPARATOR[part.data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    # a text's border also parts words
    borders = part.offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    begins[borders] = inside[borders]
    stops[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, part.offsets))


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of ``size`` words within one text, and their texts."""
    counts = np.maximum(found.counts - (size - 1), 0)
    text = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return found.offsets[:-1][text] + within, text
