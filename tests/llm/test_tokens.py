import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from brute import sha256
from conftest import FOLDER, ODD_TEXTS
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import array_merging, segment_tree, tokens
from plumbline.llm.queries import QUERIES, vocabulary
from plumbline.llm.texts import parts
from plumbline.llm.vocabulary import from_json, from_ranks

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def rank_library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def read(path, parse):
    with open(path, "rb") as file:
        return parse(file.read())


VOCABULARY = read(JSON, from_json)
RANKED = read(RANKS, from_ranks)


def encoded(texts, vocabulary, encode):
    found = []
    for part in parts(pa.array(texts, pa.string())):
        ids, offsets = tokens.token_ids(vocabulary, part, encode)
        found += [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    return found


pieces = st.sampled_from(["'", "'s", "'ll", "'ve", " ", "  ", "\n", "\t", "ab", "É", "日", "1", "½", "!", "<|endoftext|>", "　", "​", "é", "\x1c", "\x85"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), pieces), max_size=12).map("".join))
def test_random_texts_as_the_libraries(library, rank_library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoded([text, "x", text], VOCABULARY, array_merging.encode)[2] == library.encode(
        text, add_special_tokens=False
    ).ids
    assert encoded([text], RANKED, segment_tree.encode)[0] == rank_library.encode_ordinary(text)


def test_long_pretokens_use_trees_of_their_own(rank_library):
    generator = random.Random(1)
    texts = ["a" * 3000, "ab" * 500, "".join(generator.choices("abcde", k=2000)), "x" * 128, "x" * 129]
    assert encoded(texts, RANKED, segment_tree.encode) == [rank_library.encode_ordinary(t) for t in texts]


def test_decoding_gives_the_bytes_back():
    ids, offsets = segment_tree.encode(RANKED, pa.array([b" word", b"\xe6\x97", b""], pa.binary()))
    data, places = segment_tree.decode(RANKED, ids, offsets)
    assert data.tobytes() == b" word\xe6\x97"
    assert np.diff(places).tolist() == [5, 2, 0]


def test_counts_of_odd_texts(odd, library):
    rows = {r.doc_id: r for r in tokens.count_tokens(odd, JSON, 10).collect()}
    for i, text in enumerate(ODD_TEXTS):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (rows[i].n_bytes, rows[i].n_tokens) == (len((text or "").encode()), n)
        assert rows[i].over_limit == (n > 10)


def test_empty_table_and_missing_identifiers(spark, no_docs):
    assert tokens.count_tokens(no_docs, JSON, 1).count() == 0
    assert tokens.encode_and_decode(no_docs, RANKS).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id bigint, text string")
    assert [(r.doc_id, r.n_tokens) for r in tokens.count_tokens(twice, JSON, 1).collect()] == [(None, 2)] * 2


def test_queries_over_all_documents(spark, documents, library, rank_library):
    counted = {r.doc_id: r for r in QUERIES["op8_token_counts"](spark, FOLDER).collect()}
    coded = {r.doc_id: r for r in QUERIES["op3_byte_bpe"](spark, FOLDER).collect()}
    assert set(counted) == set(coded) == set(documents)
    for i, text in documents.items():
        assert counted[i].n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        ids = np.array(rank_library.encode_ordinary(text), dtype="<u4")
        assert coded[i].n_tokens == len(ids)
        assert coded[i].ids_sha256 == sha256(ids.tobytes())
        assert coded[i].decoded_sha256 == sha256(text.encode())


def test_path_of_the_vocabulary_is_a_parameter():
    assert vocabulary("byte_bpe_50k.json") == JSON
