"""Split texts into the pre-tokens of a byte-level BPE vocabulary.

The split is the one of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
worked out from each character's class and its neighbours' classes for all texts of a
part at once. Equal pre-tokens fold to one entry, so the merges run once for each
distinct pre-token of a part.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

from plumbline.llm.texts import Part

OTHER, LETTER, NUMBER, SPACE, NOTHING = range(5)

#: Characters with the Unicode property White_Space.
WHITE_SPACE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]


@cache
def character_classes() -> np.ndarray:
    """The class of every code point."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    classes[[c for c, kind in enumerate(kinds) if kind == "L"]] = LETTER
    classes[[c for c, kind in enumerate(kinds) if kind == "N"]] = NUMBER
    classes[WHITE_SPACE] = SPACE
    return classes


@dataclass
class PreTokens:
    """Distinct pre-tokens as Arrow binaries, their order in the texts, text offsets."""

    distinct: pa.Array
    index: np.ndarray
    offsets: np.ndarray


def _contraction_lengths(points, following, starts) -> tuple[np.ndarray, np.ndarray]:
    """Starts of contractions, and their lengths."""
    at = np.flatnonzero((points == 0x27) & starts & (following == LETTER))
    padded = np.append(points, [0, 0])
    one, two = padded[at + 1], padded[at + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
    long |= (one == ord("l")) & (two == ord("l"))
    long &= np.append(following, NOTHING)[at + 1] == LETTER
    lengths = np.where(short, 2, np.where(long, 3, 0))
    return at[lengths > 0], lengths[lengths > 0]


def _token_starts(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Which characters begin a pre-token. ``borders``: first characters of the texts."""
    kind = character_classes()[points]
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    before[borders] = NOTHING
    after = np.empty_like(kind)
    after[:-1] = kind[1:]
    after[-1] = NOTHING
    after[borders[borders > 0] - 1] = NOTHING
    space = kind == SPACE
    # white space: the run's first character, and its last one if something follows
    starts = space & ((before != SPACE) | (after < SPACE))
    begins = ~space & (before != kind)
    blank_before = np.zeros(len(points), dtype=bool)
    blank_before[1:] = points[:-1] == 0x20
    starts |= begins & ~((before == SPACE) & blank_before)
    at, lengths = _contraction_lengths(points, after, starts)
    starts[at + 1] = False
    past = at + lengths
    starts[past[past < len(points)]] = True
    return starts


def split(part: Part, special: str | None = None) -> PreTokens:
    """The pre-tokens of a part's texts.

    Occurrences of ``special`` stand for themselves, and the text on either side is
    split on its own. No other pre-token can look like it if it mixes letters with
    signs, as the special strings of the vocabularies do.
    """
    data = part.data
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    if len(points) == len(data):
        at_byte = None
        text_starts = part.offsets
    else:
        at_byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        text_starts = np.searchsorted(at_byte, part.offsets)
    if not len(points):
        empty = pa.array([], pa.large_binary())
        return PreTokens(empty, np.zeros(0, np.int64), np.zeros(len(part) + 1, np.int64))
    borders = text_starts[:-1]
    borders = np.unique(borders[borders < len(points)])
    found = _special_places(raw, part.offsets, special.encode()) if special else []
    if found:
        places = np.array(found, dtype=np.int64)
        if at_byte is not None:
            places = np.searchsorted(at_byte, places)
        edges = np.concatenate([places, places + len(special)])
        borders = np.unique(np.concatenate([borders, edges[edges < len(points)]]))
        starts = _token_starts(points, borders)
        for place in places:
            starts[place + 1 : place + len(special)] = False
    else:
        starts = _token_starts(points, borders)
    tokens = np.flatnonzero(starts)
    text_offsets = np.searchsorted(tokens, text_starts)
    tokens = np.append(tokens, len(points))
    ends = tokens if at_byte is None else at_byte[tokens]
    slices = pa.Array.from_buffers(
        pa.large_binary(),
        len(ends) - 1,
        [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)],
    )
    coded = slices.dictionary_encode()
    return PreTokens(coded.dictionary, coded.indices.to_numpy().astype(np.int64), text_offsets)


def _special_places(raw: bytes, offsets: np.ndarray, special: bytes) -> list[int]:
    """Byte positions of the special string within single texts."""
    found, at = [], raw.find(special)
    while at >= 0:
        text = int(np.searchsorted(offsets, at, side="right")) - 1
        if at + len(special) <= offsets[text + 1]:
            found.append(at)
            at = raw.find(special, at + len(special))
        else:
            at = raw.find(special, at + 1)
    return found
