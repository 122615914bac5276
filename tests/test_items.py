"""JSON-lines items, their numbering, and the checks of the contract."""

import pytest

from plumbline.operators import quality
from plumbline.operators.json_lines import DATASET_COLUMNS, append_datasets, explode_items
from plumbline.plans.generation import dataset


def _responses(spark, *texts, type_requested="Jealous"):
    rows = [(i, type_requested, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "n int, type_requested string, response string")


def _item(i, label="delusional", kind="Jealous", sentence=None, severity=1):
    sentence = f"s{i}" if sentence is None else sentence
    return (
        f'{{"id": {i}, "label": "{label}", "type": "{kind}", '
        f'"sentence": "{sentence}", "severity": {severity}}}'
    )


def _sentences(spark, text):
    return [r.sentence for r in explode_items(_responses(spark, text)).orderBy("sentence_id").collect()]


@pytest.mark.parametrize(
    "line",
    ["", "   ", "```json", "42", "null", "true", '"type sentence severity"',
     '["type", "sentence", "severity"]', '{"type": "a", "sentence": "b"}',
     '{"type": "a", "sentence": "b", "severity": 1', _item(1) + " trailing",
     _item(1) + "," + _item(2), "{'type': 1, 'sentence': 2, 'severity': 3}",
     '{"type": "a", "sentence": "b", "severity": NaN}'],
)
def test_lines_left_out(spark, line):
    assert _sentences(spark, f"{_item(7)}\n{line}\n{_item(8)}") == ["s7", "s8"]


@pytest.mark.parametrize(
    "end", ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", chr(0x2028), chr(0x2029)]
)
def test_line_ends(spark, end):
    assert _sentences(spark, end.join([_item(1), _item(2)])) == ["s1", "s2"]


def test_nulls_count_as_present_and_missing_rationale_is_empty(spark):
    text = '\t{"type": null, "sentence": null, "severity": null} \n' + (
        '{"type": "a", "sentence": "b", "severity": "2", "rationale": null}\n'
        '{"type": "a", "sentence": "b", "severity": "high", "rationale": "r"}'
    )
    rows = explode_items(_responses(spark, text)).orderBy("sentence_id").collect()
    assert [(r.sentence_id, r.type, r.severity, r.rationale) for r in rows] == [
        (1, None, None, ""), (2, "a", 2, None), (3, "a", None, "r"),
    ]


def test_numbers_follow_surviving_lines_of_each_response(spark):
    df = _responses(spark, f"x\n{_item(5)}\n\n{_item(9)}", _item(4), "nothing", None)
    rows = explode_items(df).collect()
    assert sorted((r.n, r.sentence_id, r.id) for r in rows) == [(0, 1, 5), (0, 2, 9), (1, 1, 4)]


def test_numbering_needs_no_shuffle(spark, plan):
    df = spark.range(3).selectExpr("id as n", "'T' as type_requested", "string(id) as response")
    assert "Exchange" not in plan(explode_items(df)) and "Python" not in plan(explode_items(df))


def test_dataset_columns(spark):
    long = " ".join(["word"] * 31)
    df = dataset(_responses(spark, _item(1, sentence=long) + "\n" + _item(2)), "m", 0.7)
    assert tuple(df.columns) == DATASET_COLUMNS
    rows = df.orderBy("sentence_id").collect()
    assert [(r.word_count, r.over_30_words) for r in rows] == [(31, True), (1, False)]
    assert {(r.model, r.temperature) for r in rows} == {("m", 0.7)}
    assert append_datasets(df, df, df).count() == 6


def test_word_count_splits_on_unicode_white_space(spark):
    texts = ["", "  ", "a", "a b", "a b　c\x1cd\x85e", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, sentence string")
    rows = quality.with_word_count(df).orderBy("i").collect()
    assert [r.word_count for r in rows] == [0, 0, 1, 2, 5, None]
    assert [r.word_count for r in rows[:-1]] == [len(t.split()) for t in texts[:-1]]


def _checks(spark, *texts):
    rows = quality.contract_checks(_responses(spark, *texts), n_delusional=2, n_normal=1).collect()
    return {r.check: r.n_bad for r in rows}


GOOD = "\n".join([_item(1), _item(2), _item(3, "normal", "Normal", severity=0)])
CLEAN = {"counts": 0, "ids": 0, "agreement": 0, "word_limit": 0, "repetition": 0}


def test_contract_kept(spark):
    assert _checks(spark, GOOD) == CLEAN


@pytest.mark.parametrize(
    "text, bad",
    [
        (GOOD.replace('"id": 2', '"id": 4'), {"ids": 1}),
        (GOOD.replace('"id": 2', '"id": 1'), {"ids": 1}),
        (GOOD.replace('"id": 2', '"id": "x"'), {"ids": 1}),
        (GOOD.replace('"severity": 0', '"severity": 1'), {"agreement": 1}),
        (GOOD.replace('"Jealous"', '"Mixed"'), {"agreement": 2}),
        (GOOD.replace('"severity": 1', '"severity": 4'), {"agreement": 2}),
        (GOOD.replace('"s2"', '"' + "w " * 31 + '"'), {"word_limit": 1}),
        (GOOD.replace('"s2"', '"s1"'), {"repetition": 1}),
        (GOOD.rsplit("\n", 1)[0], {"counts": 1}),
        (GOOD[:-10], {"counts": 1}),
        ("nothing", {"counts": 1}),
        (None, {"counts": 1}),
    ],
)
def test_contract_broken(spark, text, bad):
    assert _checks(spark, text) == CLEAN | bad


def test_repetition_counts_across_responses(spark):
    assert _checks(spark, GOOD, GOOD, GOOD)["repetition"] == 6


def test_class_balance(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "label string")
    rows = {r.label: (r.n, r.share) for r in quality.class_balance(df, "label").collect()}
    assert rows == {"a": (2, 0.5), "b": (1, 0.25), None: (1, 0.25)}
