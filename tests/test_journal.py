"""Runs that keep a journal of answers, and stores that several runs add to."""

import hashlib
import os
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import embedding as E
from plumbline.operators.journal import ask_missing, with_answers
from plumbline.plans import classification
from plumbline.session import checkpoint_folder, materialise
from plumbline.sources.batches import append_batch, newest_of_keys, read_batches


@pytest.fixture
def folder(spark):
    return f"{checkpoint_folder(spark)}/journal-{uuid.uuid4().hex}"


def counting(place, fail_on=None):
    """A stand-in that leaves a file for every prompt it is asked."""

    def answer(prompts):
        for prompt in prompts:
            if fail_on is not None and prompt == fail_on:
                raise RuntimeError("the model is gone")
            name = hashlib.md5(prompt.encode()).hexdigest()
            with open(os.path.join(place, f"{name}-{uuid.uuid4().hex}"), "w"):
                pass
        return [f"answer to {prompt}" for prompt in prompts]

    return answer


def asked(place):
    return Counter(name.split("-")[0] for name in os.listdir(place))


def _prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, prompt string")


TEXTS = [f"p{i % 40}" for i in range(120)] + [None, None] + ["hot"] * 60


def test_each_distinct_prompt_is_asked_once(spark, folder, tmp_path):
    prompts = _prompts(spark, TEXTS)
    assert ask_missing(prompts, counting(str(tmp_path)), "m", folder, slice_rows=15) == 0
    assert len(asked(tmp_path)) == 41 and set(asked(tmp_path).values()) == {1}
    ask_missing(prompts, counting(str(tmp_path)), "m", folder)
    assert set(asked(tmp_path).values()) == {1}
    got = {r.id: r.response for r in with_answers(prompts, "m", folder, hot_rows=10).collect()}
    assert got == {i: text and f"answer to {text}" for i, text in enumerate(TEXTS)}
    # another model has answers of its own
    assert with_answers(prompts, "other", folder).where("response is not null").isEmpty()


def test_a_stopped_run_goes_on(spark, folder, tmp_path):
    prompts = _prompts(spark, TEXTS)
    assert ask_missing(prompts, counting(str(tmp_path)), "m", folder, slice_rows=10, max_slices=2) == 3
    first = asked(tmp_path)
    assert 0 < len(first) < 41
    assert ask_missing(prompts, counting(str(tmp_path)), "m", folder, slice_rows=10) == 0
    assert len(asked(tmp_path)) == 41 and set(asked(tmp_path).values()) == {1}


def test_a_failed_run_keeps_its_finished_slices(spark, folder, tmp_path):
    prompts = _prompts(spark, TEXTS)
    with pytest.raises(Exception, match="the model is gone"):
        ask_missing(prompts, counting(str(tmp_path), fail_on="p7"), "m", folder, slice_rows=8)
    kept = read_batches(spark, folder, "key binary, response string").count()
    ask_missing(prompts, counting(str(tmp_path)), "m", folder, slice_rows=8)
    # only the slice that failed was asked again
    assert sum(asked(tmp_path).values()) - 41 <= 41 - kept
    assert with_answers(prompts, "m", folder).where("prompt is not null and response is null").isEmpty()


def test_whole_run_with_a_journal(spark, folder):
    test = spark.createDataFrame(
        [(1, "same", 0), (2, "same", 1), (3, " ", 0), (4, None, 1)],
        "id bigint, sentence string, diagnosis int",
    )
    answer = lambda prompts: ['{"diagnosis": 1, "severity": 2}' for _ in prompts]
    plain = classification.run(test, answer, f"{folder}-plain").predictions
    kept = classification.run(test, answer, f"{folder}-kept", journal=folder, model="m").predictions
    assert kept.columns == plain.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))
    assert read_batches(spark, folder, "key binary, response string").count() == 1
    with pytest.raises(ValueError, match="model's name"):
        classification.run(test, answer, f"{folder}-x", journal=folder)


letters = lambda texts: [[float(text.count(c)) for c in "abc"] for text in texts]


def test_a_doubled_append_gives_one_vector_per_text(spark, folder):
    texts = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "b"), (4, None)], "id bigint, sentence string")
    nothing = spark.createDataFrame([], "key binary, embedding array<float>")
    # two runs that both found the store empty
    for _ in range(2):
        append_batch(E.refresh_embeddings(texts, nothing, letters, "m"), folder)
    assert read_batches(spark, folder, classification.STORE).count() == 4
    rows = classification.with_embeddings(texts, letters, "m", folder).collect()
    assert {r.id: r.embedding for r in rows} == {1: [1, 1, 1], 2: [1, 1, 1], 3: [0, 1, 0], 4: None}
    assert len(rows) == 4


def test_rows_without_a_commit_do_not_count(spark, folder):
    rows = spark.createDataFrame([(b"k", [1.0])], classification.STORE)
    append_batch(rows, folder)
    rows.write.parquet(f"{folder}/rows/batch=stopped")
    assert newest_of_keys(read_batches(spark, folder, classification.STORE), "key", "embedding").count() == 1
    assert append_batch(rows.limit(0), folder) is None


def test_texts_are_not_shuffled_to_find_the_missing_ones(spark, plan):
    texts = materialise(spark.range(1000).selectExpr("id", "concat('text ', id % 700) as sentence"))
    stored = materialise(
        texts.where("id < 650").select(E.content_key(F.col("sentence"), "m").alias("key")).distinct()
    )
    keyed = texts.select(E.content_key(F.col("sentence"), "m").alias("key"), "id")
    first = plan(E.first_of_missing_keys(keyed, stored, "id"))
    for line in first.splitlines():
        if "Exchange" in line:
            assert "sentence" not in line
    # few are missing: the rows wanted go to the texts, which stay where they are
    misses = E.cache_misses(texts, stored, "m")
    rows = misses.collect()
    assert sorted(r.sentence for r in rows) == sorted(f"text {i}" for i in range(650, 700))
    final = misses._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in final
