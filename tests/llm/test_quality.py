import math

import numpy as np
import pyarrow as pa
import pytest
from brute import WORD, base_counts, is_held_out
from conftest import FOLDER, ODD_TEXTS

from plumbline.llm import quality_classifier as qc
from plumbline.llm import quality_rules as qr
from plumbline.llm.queries import QUERIES
from plumbline.llm.texts import SliceHashes, parts, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def failed(counts):
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def test_rules_query_as_brute_force(spark, documents):
    """Ratios from plain dictionaries over the same hashed n-grams."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1")
    trusted = {r.doc_id for r in labels.collect()}
    grams = {}
    for i, text in documents.items():
        (part,) = parts(pa.array([text]))
        found = words(part)
        grams[i] = qr.ngram_buckets(part, found, SliceHashes(part.data), qr.BUCKETS)[0].tolist()
        assert len(grams[i]) == max(2 * len(WORD.findall(text)) - 1, 0)
    raw, target = {}, {}
    for i, buckets in grams.items():
        for b in buckets:
            raw[b] = raw.get(b, 0) + 1
            if i in trusted:
                target[b] = target.get(b, 0) + 1
    all_raw, all_target = (sum(c.values()) + qr.BUCKETS for c in (raw, target))
    rows = QUERIES["op9_quality_rules"](spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(documents)
    for row in rows:
        counts = base_counts(documents[row.doc_id])
        assert tuple(row[c] for c in COUNTS) == counts
        assert row.base_failed == failed(counts)
        ratios = [
            math.log((target.get(b, 0) + 1) / all_target) - math.log((raw[b] + 1) / all_raw)
            for b in grams[row.doc_id]
        ]
        mean = sum(ratios) / max(len(ratios), 1)
        assert abs(row.score - mean) < 1e-5
        assert row.kept == (not row.base_failed and row.score >= qr.THRESHOLD)


def test_rules_keep_good_documents_and_drop_bad_ones(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = QUERIES["op9_quality_rules"](spark, "/root/testdata/sf0.01").collect()
    passed = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([kept for quality, kept in passed if quality == 1]) > 0.99
    assert np.mean([kept for quality, kept in passed if quality == 0]) < 0.2


def test_rules_on_odd_texts(spark, odd, no_docs):
    trusted = spark.createDataFrame([(6,), (6,), (None,)], "doc_id bigint")
    rows = qr.quality_rules(odd, trusted).collect()
    assert len(rows) == len(ODD_TEXTS)
    for row in rows:
        assert tuple(row[c] for c in COUNTS) == base_counts(ODD_TEXTS[row.doc_id])
        assert row.kept <= (not failed(base_counts(ODD_TEXTS[row.doc_id])))
    assert qr.quality_rules(no_docs, trusted).count() == 0
    # without a target nothing is told apart
    assert {r.score for r in qr.quality_rules(odd, trusted.where("false")).collect()} == {0.0}


def test_pairwise_sum_in_linear_time_is_the_pairwise_sum():
    generator = np.random.default_rng(0)
    size = qc.BUCKETS + len(qc.STATISTICS)
    model = qc.Model(
        0.3,
        generator.normal(size=size),
        generator.normal(size=(size, 3)),
        generator.normal(size=len(qc.STATISTICS)),
        np.full(len(qc.STATISTICS), 2.0),
    )
    bucket = np.array([5, 9, 700, 5])
    weights = np.array([0.5, -1.0, 2.0, 1.5])
    statistics = generator.normal(size=(2, len(qc.STATISTICS)))
    found = model.raw_scores(bucket, weights, np.array([0, 3, 4]), statistics)
    scaled = model.standardised(statistics)
    for row, (low, high) in enumerate([(0, 3), (3, 4)]):
        ids = [*bucket[low:high], *range(qc.BUCKETS, size)]
        x = [*weights[low:high], *scaled[row]]
        total = model.bias + sum(model.linear[i] * v for i, v in zip(ids, x))
        for a in range(len(ids)):
            for b in range(a):
                total += float(model.factors[ids[a]] @ model.factors[ids[b]]) * x[a] * x[b]
        assert abs(found[row] - total) < 1e-6


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op7_quality_classifier"](spark, folder).collect()
    assert len(rows) == 1000
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([s for q, s in held if q == want] for want in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_labels_of_held_out_documents_change_nothing(spark, documents):
    docs = spark.createDataFrame(list(documents.items())[:60], "doc_id bigint, text string")
    labels = [(i, i % 2) for i in list(documents)[:60]]
    turned = [(i, 1 - q if is_held_out(i) else q) for i, q in labels]
    schema = "doc_id bigint, quality int"
    scores = [
        {r.doc_id: r.score for r in qc.classify(docs, spark.createDataFrame(x, schema), 0.3).collect()}
        for x in (labels, turned)
    ]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("labelled", [[], [(3, 1), (4, 0), (4, None), (None, 1), (99, 1), (6, 0)]])
def test_classifier_on_odd_texts(spark, odd, no_docs, labelled):
    labels = spark.createDataFrame(labelled, "doc_id bigint, quality int")
    rows = qc.classify(odd, labels, 0.3).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(ODD_TEXTS)))
    assert all(0 <= r.score <= 1 for r in rows)
    if not labelled:
        assert {r.score for r in rows} == {0.5}
    assert qc.classify(no_docs, labels, 0.3).count() == 0
