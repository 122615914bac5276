"""Circulant MinHash signatures of documents' word-shingle sets.

Two permutations give every coordinate: the first scatters a shingle over a circle of
2**32 places, the second, shifted round the circle by k places, orders the places for
coordinate k. A document's coordinate is the lowest place among its shingles.
"""

from __future__ import annotations

import numpy as np

from plumbline.llm.ragged import offsets_of
from plumbline.llm.texts import Part, SliceHashes, mixed, paired, windows, words

BANDS = 32
ROWS = 4


def lower_case(part: Part) -> Part:
    """A-Z in lower case; other letters stay."""
    data = part.data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] += 0x20
    return Part(part.first, data, part.offsets)


def shingle_sets(part: Part, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text: (hashes, offsets), sorted within a text.

    A text with fewer words than ``size`` has one shingle, all its words; one without
    words has none.
    """
    lowered = lower_case(part)
    found = words(lowered)
    word_hashes = SliceHashes(lowered.data).of(found.starts, found.ends)
    first, text = windows(found, size)
    shingles = word_hashes[first]
    for step in range(1, size):
        shingles = paired(shingles, word_hashes[first + step])
    counts = found.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    for row in short:
        whole = mixed(np.array([counts[row]], dtype=np.uint64))
        for place in range(found.offsets[row], found.offsets[row + 1]):
            whole = paired(whole, word_hashes[place : place + 1])
        shingles = np.append(shingles, whole)
    text = np.concatenate([text, short])
    order = np.lexsort((shingles, text))
    shingles, text = shingles[order], text[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (shingles[1:] != shingles[:-1])
    shingles, text = shingles[new], text[new]
    return shingles, offsets_of(np.bincount(text, minlength=len(part)))


def set_keys(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits that name each set: two sums over differently scrambled members."""
    keys = np.zeros((len(offsets) - 1, 2), dtype=np.uint64)
    for half, salt in enumerate((0x51ED2701, 0xB5297A4D)):
        total = np.zeros(len(shingles) + 1, dtype=np.uint64)
        np.cumsum(mixed(shingles ^ np.uint64(salt)), out=total[1:])
        keys[:, half] = total[offsets[1:]] - total[offsets[:-1]]
    return keys


def _order_places(places: np.ndarray) -> None:
    """The second permutation, of 32-bit numbers, in place."""
    places ^= places >> np.uint32(16)
    places *= np.uint32(0x85EBCA6B)
    places ^= places >> np.uint32(13)
    places *= np.uint32(0xC2B2AE35)
    places ^= places >> np.uint32(16)


def signatures(shingles: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """Texts x coordinates; rows of empty sets are all ones in binary."""
    filled = np.flatnonzero(np.diff(offsets))
    found = np.full((len(offsets) - 1, coordinates), 0xFFFFFFFF, dtype=np.uint32)
    if not len(filled):
        return found
    scattered = (mixed(shingles ^ np.uint64(0x3C6EF372)) >> np.uint64(32)).astype(np.uint32)
    starts = offsets[:-1][filled]
    for k in range(coordinates):
        places = scattered + np.uint32(k)
        _order_places(places)
        found[filled, k] = np.minimum.reduceat(places, starts)
    return found


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Texts x bands: one hash of each band's coordinates and the band's number."""
    hashes = np.empty((len(signature), bands), dtype=np.uint64)
    for band in range(bands):
        value = np.full(len(signature), band + 1, dtype=np.uint64)
        for row in range(band * rows, (band + 1) * rows):
            value = paired(value, signature[:, row].astype(np.uint64))
        hashes[:, band] = value
    return hashes.view(np.int64)
