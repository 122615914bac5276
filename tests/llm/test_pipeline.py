"""Each stage of the pipeline against a plain version of it, on what its predecessor wrote."""

import corpus_pipeline
from brute import near_duplicates, without_repeats
from conftest import FOLDER
from test_packing import check

from plumbline.llm import quality_classifier
from plumbline.llm.common import stored
from plumbline.llm.queries import SEQUENCE


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    before = texts(docs)

    docs = stored(stages["quality_classifier"](spark, docs, FOLDER))
    good = texts(docs)
    predicted = quality_classifier.classify(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels, 0.3)
    assert set(good) == {r.doc_id for r in predicted.where("predicted = 1").collect()}
    assert len(good) > 0.7 * len(before)

    docs = stored(stages["exact_dedup"](spark, docs, FOLDER))
    single = texts(docs)
    assert set(single) == set({text: i for i, text in sorted(good.items())}.values())

    docs = stored(stages["near_dedup"](spark, docs, FOLDER))
    distinct = texts(docs)
    assert set(distinct) == {i for i, (_, _, kept) in near_duplicates(single, 5).items() if kept}

    docs = stored(stages["suffix_dedup"](spark, docs, FOLDER))
    assert docs.columns == columns
    cut = texts(docs)
    found = without_repeats(distinct, whole=True)
    assert cut == {i: kept.decode() for i, (n, gone, _, kept) in found.items() if gone < n or not n}
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    rows = stages["packing"](spark, docs, FOLDER).collect()
    assert check(rows, cut, SEQUENCE) > 0.98
    whole = corpus_pipeline.run(spark, FOLDER)
    assert {(r.doc_id, r.start, r.ids_crc32) for r in whole.collect()} == {(r.doc_id, r.start, r.ids_crc32) for r in rows}


def test_rows_with_nulls_and_other_columns(spark, odd):
    """No stage fails on missing values; a repeated name of an inner column comes through."""
    docs = odd.selectExpr("*", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as bigint) as n_chars")
    docs = docs.union(docs.selectExpr("cast(null as bigint)", *docs.columns[1:]).limit(4))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stored(stage(spark, docs, FOLDER))
        assert docs.columns == columns, name
    assert dict(corpus_pipeline.STAGES)["packing"](spark, docs, FOLDER).count() >= docs.count()


def test_no_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER))
    assert docs.count() == 0
