"""Sources, prompts, model functions and whole runs."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from plumbline import fixed_values as fixed
from plumbline.operators.embedding import attach_embeddings, cache_misses, refresh_embeddings
from plumbline.operators.prompts import baseline_prompt, fill, generation_prompts, retrieval_prompt
from plumbline.operators.scoring import embed, score
from plumbline.plans import classification, generation
from plumbline.sources import tables

# the workers cannot import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def one_answer(prompts):
    return ['{"diagnosis": %d, "severity": 2, "confidence": 70}' % ("bad" in p) for p in prompts]


def letters(texts):
    return [[float(t.count(c)) for c in "abcde"] for t in texts]


@pytest.fixture
def test_table(spark):
    return spark.createDataFrame(
        [(1, "bad egg", "1"), (2, "fine cab", "0"), (3, "bad add", "0"), (4, " 　", "1"), (5, None, "1")],
        "id long, sentence string, dignosis string",
    )


# --- sources ---------------------------------------------------------------


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "test.csv"
    path.write_text('sentence,diagnosis\n"two\nlines, ""quoted""",1\nplain,0\n', encoding="utf-8")
    rows = tables.read_table(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [('two\nlines, "quoted"', "1"), ("plain", "0")]
    typed = tables.read_table(spark, str(path), "sentence string, diagnosis int")
    assert typed.schema["diagnosis"].dataType.typeName() == "integer"
    keyed = tables.write_keyed(typed, str(tmp_path / "keyed"))
    assert keyed.select("id").distinct().count() == 2
    assert tables.read_table(spark, str(tmp_path / "keyed")).count() == 2


def test_definitions(spark, tmp_path):
    path = tmp_path / "definition.txt"
    path.write_text("line one\nline two\n", encoding="utf-8")
    assert tables.read_definitions(spark, str(path)).collect()[0].definitions == "line one\nline two\n"
    for missing in (None, "", str(tmp_path / "none.txt"), str(tmp_path / "x.odt")):
        rows = tables.read_definitions(spark, missing).collect()
        assert [r.definitions for r in rows] == [fixed.DEFAULT_DEFINITIONS]


def test_column_checks(test_table):
    assert tables.require_column(test_table) is test_table
    with pytest.raises(ValueError, match="rag must contain column 'sentence'"):
        tables.require_column(test_table.drop("sentence"), name="rag")
    assert tables.first_present(test_table) == "dignosis"
    assert tables.first_present(test_table.withColumn("diagnosis", F.lit(1))) == "diagnosis"
    assert tables.first_present(test_table.select("id")) is None


def test_row_cap(test_table):
    assert sorted(r.id for r in tables.cap_rows(test_table, 2).collect()) == [1, 2]
    assert tables.cap_rows(test_table, None) is test_table


# --- prompts ---------------------------------------------------------------


def _value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_prompts(spark):
    text = "100% {user_text} {context} %s"
    assert _value(spark, baseline_prompt(F.lit(text))) == fixed.BASELINE_PROMPT.replace(
        "{user_text}", text
    )
    before, after = fixed.RETRIEVAL_PROMPT.split("{context}")
    made = _value(spark, retrieval_prompt(F.lit(text), F.lit("c1\n\n---\nc2")))
    assert made == before.replace("{user_text}", text) + "c1\n\n---\nc2" + after
    assert _value(spark, fill("{a}{b}{c}", a=F.lit("{b}"), b=2)) == "{b}2{c}"


def test_generation_grid(spark):
    rows = generation_prompts(tables.read_definitions(spark), n_delusional=3).collect()
    assert [r.type_requested for r in rows] == list(fixed.TYPES)
    for row in rows:
        assert [m.role for m in row.messages] == ["system", "user"]
        assert row.messages[1].content == row.prompt
        assert "EXACTLY 13 lines" in row.prompt and "Lines 4 to 13: NORMAL" in row.prompt
        assert f'"type": "{row.type_requested}"   #' in row.prompt
        assert fixed.DEFAULT_DEFINITIONS in row.prompt and fixed.SEVERITY_RUBRIC in row.prompt
        assert "{n_" not in row.prompt and "{type_name}" not in row.prompt


# --- model functions -------------------------------------------------------


def test_model_gets_batches_and_no_nulls(spark):
    df = spark.range(100).select(
        "id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("prompt")
    )

    def sizes(prompts):
        assert None not in prompts
        return [f"{p}/{len(prompts) <= 8}" for p in prompts]

    rows = score(df, sizes, batch_size=8, parallelism=2).collect()
    assert {r.id: r.response for r in rows} == {
        i: f"{i}/True" if i % 3 else None for i in range(100)
    }


def test_a_short_result_fails(spark):
    with pytest.raises(Exception, match="1 results for 2 inputs"):
        score(spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1),
              lambda prompts: ["x"]).collect()


def test_embedding_reuse_computes_new_texts_only(spark):
    texts = spark.createDataFrame(
        [(1, "abc"), (2, "abc"), (3, "dee"), (4, None)], "id int, sentence string"
    )
    nothing = spark.createDataFrame([], "key binary, embedding array<float>")
    first = refresh_embeddings(texts, nothing, letters, "m1").cache()
    assert first.count() == 2
    assert cache_misses(texts, first, "m1").count() == 0
    assert cache_misses(texts, first, "m2").count() == 2
    more = texts.union(spark.createDataFrame([(5, "new")], "id int, sentence string"))
    assert [r.sentence for r in cache_misses(more, first, "m1").collect()] == ["new"]
    got = {r.id: r.embedding for r in attach_embeddings(more, first, "m1").collect()}
    assert got == {1: [1, 1, 1, 0, 0], 2: [1, 1, 1, 0, 0], 3: [0, 0, 0, 1, 2], 4: None, 5: None}


# --- runs ------------------------------------------------------------------


def _corpus(spark):
    rows = [(10, "aaa"), (11, "bbb"), (12, "cab"), (13, "ddd")]
    return embed(spark.createDataFrame(rows, "id long, sentence string"), letters)


EXPECTED = {
    1: ("delusional", 2, 70, None, True),
    2: ("non-delusional", None, 70, None, True),
    3: ("delusional", 2, 70, None, False),
    4: (None, None, None, "Empty input.", False),
    5: (None, None, None, "Empty input.", False),
}


def _results(df):
    return {
        r.id: (r.pred_diagnosis, r.pred_severity, r.pred_confidence, r.pred_reasoning, r.pred_correct)
        for r in df.collect()
    }


def test_baseline_run_asks_once_per_row(spark, test_table, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counting(prompts):
        calls.add(len(prompts))
        return one_answer(prompts)

    done = classification.run(test_table, counting, str(tmp_path))
    assert calls.value == 3
    assert _results(done.predictions) == EXPECTED
    assert done.predictions.columns[:3] == test_table.columns
    assert {r.name: r.value for r in done.metrics.collect()}["accuracy"] == pytest.approx(2 / 3)
    assert done.report.where("line = 1").first().metrics == "Accuracy (valid rows only): 0.667"
    assert {r.gold: (r.delusional, r.non_delusional) for r in done.confusion.collect()} == {
        "delusional": (1, 0), "non-delusional": (1, 1),
    }


def test_ready_answers(spark, test_table):
    answers = spark.createDataFrame(
        [(1, '{"diagnosis": 1, "severity": 2, "confidence": 70}'), (3, "no idea")],
        "id long, response string",
    )
    got = classification.evaluate(classification.from_responses(test_table, answers))
    assert _results(got.predictions) == EXPECTED | {
        2: (None, None, None, None, False), 3: (None, None, None, None, False),
    }


def test_retrieval_run(spark, test_table, tmp_path):
    with_vectors = embed(test_table, letters)
    prompts = {
        r.id: r.prompt
        for r in classification.with_prompts(with_vectors, _corpus(spark), k=2).collect()
    }
    assert prompts[4] is None and prompts[5] is None
    assert "cab\n\n---\naaa" in prompts[2]
    done = classification.run(with_vectors, one_answer, str(tmp_path), _corpus(spark))
    assert _results(done.predictions) == EXPECTED


def test_run_without_labels_has_no_metrics(spark, test_table, tmp_path):
    done = classification.run(test_table.drop("dignosis"), one_answer, str(tmp_path))
    assert done.metrics is None and done.report is None and done.confusion is None
    assert done.predictions.count() == 5


def test_run_on_an_empty_table(spark, test_table, tmp_path):
    done = classification.run(test_table.limit(0), one_answer, str(tmp_path))
    assert done.predictions.count() == 0
    assert set(classification.PREDICTION_COLUMNS) < set(done.predictions.columns)
    assert done.report.first().metrics == fixed.NO_VALID_PREDICTIONS


def test_missing_text_column(test_table):
    with pytest.raises(ValueError, match="sentence"):
        classification.with_prompts(test_table.drop("sentence"))


def test_baseline_needs_no_shuffle(spark, test_table, plan):
    assert "Exchange" not in plan(classification.classify(test_table, one_answer))


def test_generation(spark, tmp_path):
    def generator(prompts):
        line = '{"id": 1, "label": "normal", "type": "Normal", "sentence": "hi there", "severity": 0}'
        return [f"```\n{line}\n{line}\n```" for _ in prompts]

    made = generation.generate(tables.read_definitions(spark), generator, "m", str(tmp_path))
    assert made.count() == 20
    assert {r.sentence_id for r in made.collect()} == {1, 2}


def test_run_from_text_embeds_every_text_once(spark, test_table, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def counting(texts):
        asked.add(len(texts))
        return letters(texts)

    corpus = _corpus(spark).drop("embedding").union(test_table.where("id = 2").select("id", "sentence"))
    search = {"embed_fn": counting, "embed_model": "m", "store": str(tmp_path / "store"), "k": 2}
    done = classification.run(test_table, one_answer, str(tmp_path / "a"), corpus, **search)
    assert _results(done.predictions) == EXPECTED
    assert asked.value == 7  # four or five of the corpus, three of the test table, one in both
    classification.run(test_table, one_answer, str(tmp_path / "b"), corpus, **search)
    assert asked.value == 7
    with pytest.raises(ValueError, match="store"):
        classification.classify(test_table, one_answer, corpus, embed_fn=counting)


def test_generation_asks_for_several_types_at_once(spark, tmp_path):
    def where(prompts):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        line = '{"id": 1, "label": "normal", "type": "Normal", "sentence": "%d", "severity": 0}'
        return [line % task for _ in prompts]

    made = generation.generate(tables.read_definitions(spark), where, "m", str(tmp_path))
    assert len({r.sentence for r in made.collect()}) > 1


def test_definitions_are_one_file(spark, tmp_path):
    folder = tmp_path / "many.txt"
    folder.mkdir()
    for name in "ab":
        (folder / name).write_text(name)
    with pytest.raises(ValueError, match="one text file"):
        tables.read_definitions(spark, str(folder))


def test_a_large_file_read_by_one_task_gets_a_warning(spark, tmp_path, monkeypatch):
    path = tmp_path / "test.csv"
    path.write_text("sentence\nplain\n")
    monkeypatch.setattr(tables, "LARGE_FILE", 4)
    with pytest.warns(UserWarning, match="multi_line=False"):
        tables.read_table(spark, str(path))
    assert tables.read_table(spark, str(path), multi_line=False).count() == 1


@pytest.mark.parametrize("multi_line", [True, False])
def test_a_csv_file_is_split_where_the_caller_says_so(spark, tmp_path, multi_line):
    path = tmp_path / "test.csv"
    path.write_text("id,sentence\n" + "".join(f'{i},"a ""quoted"" text, {i}"\n' for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        read = tables.read_table(spark, str(path), "id bigint, sentence string", multi_line)
        assert (read.rdd.getNumPartitions() == 1) == multi_line
        assert {r.id: r.sentence for r in read.collect()} == {i: f'a "quoted" text, {i}' for i in range(2000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_comparison_of_written_runs(spark, test_table, tmp_path):
    from plumbline.plans import comparison

    table = test_table.withColumn("severity", F.lit(3))
    runs = [
        classification.run(table, answers, str(tmp_path / name)).predictions
        for name, answers in (("a", one_answer), ("b", lambda prompts: ["no"] * len(prompts)))
    ]
    found = comparison.compare(*runs, path=str(tmp_path / "c"))
    t = {r.measure: r for r in found.paired_t.collect()}
    assert (t["correct"].n, t["correct"].mean) == (5, pytest.approx(0.4))
    assert (t["severity_error"].n, t["pred_confidence"].n) == (0, 0)
    described = {(r.run, r.measure): r for r in found.descriptives.collect()}
    assert described["first", "severity_error"].mean == 1.0
    assert described["second", "severity_error"].missing == 5
    bare = comparison.compare(*[run.select("id", "pred_diagnosis", "pred_severity", "pred_confidence") for run in runs])
    assert {r.n for r in bare.paired_t.collect()} == {0}
