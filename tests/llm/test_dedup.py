import random

import pyarrow as pa
import pytest
from brute import near_duplicates, sha256, without_repeats
from compare import connect, differences
from conftest import FOLDER, ODD_TEXTS
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, near_dedup, substring_dedup
from plumbline.llm.components import components
from plumbline.llm.minhash import shingle_sets, signatures
from plumbline.llm.queries import QUERIES, SQL

KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

# --- exact ------------------------------------------------------------------


def test_exact_query_as_sql(spark):
    assert differences(QUERIES["op6_exact_dedup"](spark, FOLDER), connect(FOLDER), SQL["op6_exact_dedup"]) == []


def exact(rows):
    return {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows.collect()}


def test_exact_on_odd_texts(odd):
    found = {r.doc_id: r for r in exact_dedup.exact_duplicates(odd).collect()}
    assert len(found) == len(ODD_TEXTS)
    assert (found[0].keep_id, found[1].keep_id, found[0].group_size) == (1, 1, 2)
    assert (found[6].keep_id, found[7].kept, found[5].group_size) == (7, True, 1)


@pytest.mark.parametrize("share", [0.001, 0.2])
def test_texts_with_one_digest_stay_apart(spark, monkeypatch, share):
    """With few digests and few hot ones, groups must still be by content."""
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    rows = [(i, f"t{i % 7}" if i % 3 else "hot") for i in range(200)] + [(None, "hot"), (None, "only")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    groups = {}
    for i, text in rows:
        groups.setdefault(text, []).append(i)
    expected = set()
    for i, text in rows:
        largest = max((x for x in groups[text] if x is not None), default=None)
        expected.add((i, largest, len(groups[text]), i == largest))
    weak = exact_dedup.exact_duplicates(docs, digest=lambda t: F.substring(F.md5(t), 1, 1))
    assert exact(weak) == expected
    assert exact(exact_dedup.exact_duplicates(docs)) == expected


def test_exact_without_documents_and_with_repeated_rows(spark, no_docs):
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    twice = spark.createDataFrame([(3, "a"), (3, "a"), (1, "a")], "doc_id bigint, text string")
    assert sorted(r.kept for r in exact_dedup.exact_duplicates(twice).collect()) == [False, True, True]


# --- near -------------------------------------------------------------------


def near(rows):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows.collect()}


def test_near_query_as_brute_force(spark, documents):
    assert near(QUERIES["op4_near_dedup"](spark, FOLDER)) == near_duplicates(documents, 2)


def test_near_on_odd_texts(odd):
    assert near(near_dedup.near_duplicates(odd)) == near_duplicates(dict(enumerate(ODD_TEXTS)), 5)


@pytest.mark.parametrize("block", [1000, 4])
def test_a_large_group_of_near_copies(spark, monkeypatch, block):
    """Copies that differ in a few words each, some of them too much to be linked."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    generator = random.Random(block)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(60):
        words = list(base)
        for _ in range(generator.randrange(1, 7)):
            words[generator.randrange(60)] = f"x{generator.randrange(12)}"
        texts[i] = " ".join(words).upper() if i % 2 else "\t".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    expected = near_duplicates(texts, 2)
    assert len({c for _, c, _ in expected.values()}) > 3
    assert near(near_dedup.near_duplicates(docs, shingle=2)) == expected


def test_near_without_documents_or_identifiers(spark, no_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0
    text = "one two three four five six seven"
    rows = [(None, text), (4, text), (None, "alone here"), (4, "other words of the same number")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(
        ((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=str
    )
    assert found == sorted([(None, 4, False), (4, 4, True), (None, None, True), (4, 4, True)], key=str)


def test_signature_agreement_follows_similarity():
    import numpy as np
    import pyarrow as pa

    from plumbline.llm.texts import parts

    words = [f"w{i}" for i in range(400)]
    other = words[:360] + [f"v{i}" for i in range(40)]
    (part,) = parts(pa.array([" ".join(words), " ".join(other)]))
    sets, offsets = shingle_sets(part, 1)
    found = signatures(sets, offsets, 1024)
    assert abs((found[0] == found[1]).mean() - 360 / 440) < 0.05
    assert len(np.unique(found[0])) > 300


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 130)]
    links = spark.createDataFrame(chain[::-1] + star + [(7, 7), (200, 199)], "a bigint, b bigint")
    labels = {r.node: r.label for r in components(links).collect()}
    assert {labels[i] for i in range(41)} == {0}
    assert {labels[i] for i in range(100, 130)} == {100}
    assert labels[200] == labels[199] == 199
    assert len(labels) == 41 + 30 + 2


# --- passages ---------------------------------------------------------------


def removed(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows.collect()}


def test_passage_query_as_brute_force(spark, documents):
    found = {r.doc_id: r for r in QUERIES["op10_suffix_dedup"](spark, FOLDER).collect()}
    expected = without_repeats(documents)
    assert set(found) == set(expected)
    for i, (n, gone, runs, kept) in expected.items():
        row = found[i]
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (n, gone, runs, sha256(kept))


@pytest.mark.parametrize("limit", [20_000, 2])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é"])
def test_random_texts_with_shared_passages(spark, monkeypatch, limit, alphabet):
    monkeypatch.setattr(substring_dedup, "TASK_CONTEXTS", limit)
    generator = random.Random(limit + len(alphabet))
    passages = ["".join(generator.choices(alphabet, k=generator.randrange(40, 160))) for _ in range(6)]
    texts = {}
    for i in range(40):
        chunks = []
        for _ in range(generator.randrange(0, 5)):
            passage = generator.choice(passages)
            chunks.append(passage[generator.randrange(20) :] if generator.random() < 0.5 else passage)
            chunks.append("".join(generator.choices(alphabet, k=generator.randrange(0, 30))))
        texts[i] = "".join(chunks)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    assert removed(substring_dedup.remove_repeats(docs)) == without_repeats(texts)


def test_passages_in_odd_texts(odd):
    found = substring_dedup.remove_repeats(odd, carry=["label", "size"])
    assert removed(found) == without_repeats(dict(enumerate(ODD_TEXTS)))
    assert {(r.doc_id, r["size"], r.label) for r in found.collect()} == {
        (i, i, "b") for i in range(len(ODD_TEXTS))
    }


def test_passages_with_equal_or_missing_identifiers(spark, no_docs):
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    passage = "".join(chr(97 + (i * i) % 23) for i in range(70))
    rows = [(5, passage), (5, passage + "!"), (None, "?" + passage), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.n_bytes, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    assert found == {(5, 70, 0), (5, 71, 0), (None, 71, 70), (None, 70, 70)}


@pytest.mark.parametrize("seed", range(6))
def test_slices_end_where_grams_do(seed):
    chance = random.Random(seed)
    rows = sorted((chance.randrange(12), i, b"x" * chance.randrange(9)) for i in range(80))
    names = ["gram", "context", "doc", "bytes"]
    batches, at = [], 0
    while at < len(rows):
        some = rows[at : at + chance.choice([1, 3, 17])]
        at += len(some)
        columns = [[g for g, _, _ in some], [i for _, i, _ in some], [0] * len(some), [b for *_, b in some]]
        batches.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS)], names=names))
    slices = list(substring_dedup._whole_grams(iter(batches), 20))
    assert [x for s in slices for x in s.column(1).to_pylist()] == [i for _, i, _ in rows]
    grams = [set(s.column(0).to_pylist()) for s in slices]
    assert sum(map(len, grams)) == len(set().union(*grams))
    for part, held in zip(slices, grams):
        assert len(held) == 1 or sum(map(len, part.column(3).to_pylist())) <= 20


def test_memory_of_a_slice_does_not_grow_with_the_contexts(spark, documents, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 300)
    docs = spark.createDataFrame(list(documents.items())[:80], "doc_id bigint, text string")
    rows = substring_dedup.remove_repeats(docs).collect()
    expected = without_repeats(dict(list(documents.items())[:80]))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == expected


def test_cuts_at_whole_characters(spark):
    same = "日本語のとても長い文章がここにあります、そして続きます。"
    texts = {1: "a" + same + "é", 2: "ü" + same[1:] + "ê", 3: "x" + "é" * 30, 4: "ê" + "é" * 30, 5: None, 6: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = substring_dedup.remove_repeats(docs, whole_characters=True).collect()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows}
    assert found == without_repeats(texts, whole=True)
    assert found != without_repeats(texts)
    assert all(kept.decode() is not None for *_, kept in found.values())
