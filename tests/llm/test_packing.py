import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import FOLDER, ODD_TEXTS
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import packing
from plumbline.llm.queries import END_ID, QUERIES, SEQUENCE

JSON = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, capacity):
    library = Tokenizer.from_file(JSON)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in rows:
        by_doc[row.doc_id].append(row)
        by_sequence[row.sequence_id].append(row)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [END_ID]
        at = 0
        for row in sorted(by_doc[i], key=lambda r: r.start):
            assert (row.start, row.doc_tokens) == (at, len(ids))
            some = np.array(ids[at : at + row.length], dtype="<u4").tobytes()
            assert zlib.crc32(some) == row.ids_crc32
            at += row.length
        assert at == len(ids)
    padded = 0
    for placed in by_sequence.values():
        at = 0
        for row in sorted(placed, key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert at <= capacity
        expected = at if at & (at - 1) == 0 else capacity
        assert {row.padded_length for row in placed} == {expected}
        padded += expected
    return sum(row.length for row in rows) / max(padded, 1)


@given(st.integers(1, 20_000), st.sampled_from([64, 2048, 1000]))
def test_cuts_cover_the_document_and_waste_little(total, capacity):
    lengths = packing.piece_lengths(total, capacity)
    assert sum(lengths) == total and min(lengths) > 0 and max(lengths) <= capacity
    for length in lengths:
        fit = capacity // length
        assert capacity - fit * length <= max(packing.WASTE * capacity, fit)


def test_query_places_every_token_with_little_padding(spark, documents):
    rows = QUERIES["op1_packing"](spark, FOLDER).collect()
    assert check(rows, documents, SEQUENCE) > 0.98


def test_odd_texts_and_real_sequences(odd):
    pieces = packing.cut(odd, JSON, 64, END_ID)
    placed = packing.place(pieces, 64)
    rows = placed.selectExpr("*", "crc32(ids) as ids_crc32").collect()
    check(rows, dict(enumerate(ODD_TEXTS)), 64)
    joined = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(placed).collect()}
    assert sum(map(len, joined.values())) == sum(r.length for r in rows)
    for row in rows:
        part = joined[row.sequence_id][row.offset : row.offset + row.length]
        assert part.tobytes() == bytes(row.ids)


def test_no_documents(no_docs):
    assert packing.place(packing.cut(no_docs, JSON, 64, END_ID), 64).count() == 0


@pytest.mark.parametrize("lengths", [[1] * 130, [64] * 3, [33] * 5, [10, 54, 20, 44]])
def test_placing_given_lengths(spark, lengths):
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id bigint, length bigint")
    rows = packing.place(pieces, 64).collect()
    assert len(rows) == len(lengths)
    used = defaultdict(int)
    for row in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert row.offset == used[row.sequence_id]
        used[row.sequence_id] += row.length
    assert max(used.values()) <= 64
