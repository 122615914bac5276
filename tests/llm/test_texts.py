"""Hashes of slices, and places in the segment tree, at sizes beyond ordinary texts."""

import numpy as np
import pyarrow as pa
import pytest
from brute import base_counts as brute_counts
from hypothesis import given
from hypothesis import strategies as st

from plumbline.llm import segment_tree, texts
from plumbline.llm.minhash import shingle_sets
from plumbline.llm.quality_rules import base_counts


def thue_morse(length, letters="ab"):
    """Texts on which every power series modulo a power of two fails sooner or later."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(length))


def part_of(*some):
    (part,) = texts.parts(pa.array(some), 1 << 30)
    return part


def hashed(part, slices):
    starts, ends = (np.array(x, dtype=np.int64) for x in zip(*slices))
    return texts.SliceHashes(part.data).of(starts, ends).tolist()


@given(st.lists(st.binary(max_size=40), min_size=1, max_size=20), st.integers(1, 9))
def test_equal_slices_and_only_those_have_equal_hashes(monkeypatch_session, pieces, at_once):
    monkeypatch_session.setattr(texts, "PIECES_AT_ONCE", at_once)
    data = np.frombuffer(b"".join(pieces) + b"\0", np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    found = texts.SliceHashes(data).of(ends - [len(p) for p in pieces], ends).tolist()
    for a, x in zip(pieces, found):
        for b, y in zip(pieces, found):
            assert (a == b) == (x == y)


@pytest.fixture(scope="module")
def monkeypatch_session():
    with pytest.MonkeyPatch.context() as patch:
        yield patch


@pytest.mark.parametrize("length", [512, 1024, 2048, 4096, 8192, 65536])
def test_thue_morse_slices_differ(length):
    one, other = thue_morse(length), thue_morse(length, "ba")
    part = part_of(one + " " + other + " " + one)
    first, second, third = hashed(
        part, [(0, length), (length + 1, 2 * length + 1), (2 * length + 2, 3 * length + 2)]
    )
    assert first == third != second


@pytest.mark.parametrize("length", [1024, 8192])
def test_thue_morse_lines_and_words_are_not_repeated(length):
    one, other = thue_morse(length), thue_morse(length, "ba")
    text = "\n".join([one, other, one]) + " end"
    part = part_of(text)
    found = texts.words(part)
    counts = base_counts(part, found, texts.SliceHashes(part.data))
    assert [int(c[0]) for c in counts.values()] == list(brute_counts(text))
    assert int(counts["n_dup_lines"][0]) == 0  # the third line has one more word


@pytest.mark.parametrize("length", [1024, 8192])
def test_thue_morse_words_make_different_sets(length):
    one, other = thue_morse(length), thue_morse(length, "ba")
    shingles, offsets = shingle_sets(part_of(one + " x", other + " x", one + " x"), 2)
    sets = [set(shingles[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
    assert sets[0] == sets[2] and not sets[0] & sets[1]


@pytest.mark.parametrize("place", [0, 1, 2**24 - 1, 2**24, 2**31 - 1])
@pytest.mark.parametrize("rank", [0, 5, 2**31 - 1])
def test_places_and_ranks_come_out_of_keys(rank, place):
    key = int(segment_tree._keys(np.array([rank]), np.array([place]))[0])
    assert (key >> segment_tree.PLACE_BITS, key & segment_tree._PLACE) == (rank, place)
    assert key < int(segment_tree._NOTHING)
