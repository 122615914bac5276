"""Truth tables for reading one model answer."""

import pytest

from plumbline.fixed_values import NEGATIVE, POSITIVE
from plumbline.operators.responses import normalize_predictions

P, N = POSITIVE, NEGATIVE
NOTHING = (None, None, None, None)

CASES = [
    # numbers
    ('{"diagnosis": 1, "severity": 3, "confidence": 55, "reasoning": "r"}', (P, 3, 55, "r")),
    ('{"diagnosis": 0, "severity": 3, "confidence": 55, "reasoning": "r"}', (N, None, 55, "r")),
    ('{"diagnosis": 2}', (N, None, None, None)),
    ('{"diagnosis": -1}', (N, None, None, None)),
    ('{"diagnosis": 0.9}', (N, None, None, None)),
    ('{"diagnosis": 1.9}', (P, None, None, None)),
    ('{"diagnosis": 1.0}', (P, None, None, None)),
    ('{"diagnosis": true, "severity": true, "confidence": true}', (P, 1, 1, None)),
    ('{"diagnosis": false, "confidence": false}', (N, None, 0, None)),
    # words
    ('{"diagnosis": " Delusional\\n"}', (P, None, None, None)),
    ('{"diagnosis": "YES"}', (P, None, None, None)),
    ('{"diagnosis": "y"}', (P, None, None, None)),
    ('{"diagnosis": "true"}', (P, None, None, None)),
    ('{"diagnosis": "1"}', (P, None, None, None)),
    ('{"diagnosis": "normal"}', (N, None, None, None)),
    ('{"diagnosis": "Non-Delusional"}', (N, None, None, None)),
    ('{"diagnosis": "n"}', (N, None, None, None)),
    ('{"diagnosis": "1.0"}', NOTHING),
    ('{"diagnosis": "maybe"}', NOTHING),
    ('{"diagnosis": null}', NOTHING),
    ('{"diagnosis": [1]}', NOTHING),
    ('{"diagnosis": {"a": 1}}', NOTHING),
    ("{}", NOTHING),
    # severity
    ('{"diagnosis": 1, "severity": "2"}', (P, 2, None, None)),
    ('{"diagnosis": 1, "severity": " +2 "}', (P, 2, None, None)),
    ('{"diagnosis": 1, "severity": 2.7}', (P, 2, None, None)),
    ('{"diagnosis": 1, "severity": 3.99}', (P, 3, None, None)),
    ('{"diagnosis": 1, "severity": "2.0"}', (P, None, None, None)),
    ('{"diagnosis": 1, "severity": 4}', (P, None, None, None)),
    ('{"diagnosis": 1, "severity": 0.9}', (P, None, None, None)),
    ('{"diagnosis": 1, "severity": "0_2"}', (P, 2, None, None)),
    ('{"diagnosis": 1, "severity": "_2"}', (P, None, None, None)),
    ('{"diagnosis": 1, "severity": null}', (P, None, None, None)),
    ('{"diagnosis": 1, "severity": []}', (P, None, None, None)),
    ('{"diagnosis": "maybe", "severity": 2}', NOTHING),
    # confidence
    ('{"confidence": 130}', (None, None, 100, None)),
    ('{"confidence": -5}', (None, None, 0, None)),
    ('{"confidence": 88.9}', (None, None, 88, None)),
    ('{"confidence": 1e10}', (None, None, 100, None)),
    ('{"confidence": 1e400}', NOTHING),
    ('{"confidence": "99999999999"}', (None, None, 100, None)),
    ('{"confidence": "99999999999999999999999999999999999999999999"}', (None, None, 100, None)),
    ('{"confidence": 99999999999999999999999999999999999999999999}', (None, None, 100, None)),
    ('{"confidence": "2.0"}', NOTHING),
    ('{"confidence": "high"}', NOTHING),
    ('{"confidence": ""}', NOTHING),
    ('{"confidence": null}', NOTHING),
    # reasoning
    ('{"reasoning": "", "explanation": "e"}', (None, None, None, "e")),
    ('{"reasoning": null, "explanation": "e"}', (None, None, None, "e")),
    ('{"explanation": "e"}', (None, None, None, "e")),
    ('{"reasoning": 0, "explanation": "e"}', (None, None, None, "e")),
    ('{"reasoning": 0.0, "explanation": "e"}', (None, None, None, "e")),
    ('{"reasoning": false, "explanation": "e"}', (None, None, None, "e")),
    ('{"reasoning": [], "explanation": "e"}', (None, None, None, "e")),
    ('{"reasoning": {}, "explanation": "e"}', (None, None, None, "e")),
    ('{"reasoning": [null], "explanation": "e"}', NOTHING),
    ('{"reasoning": 7, "explanation": "e"}', NOTHING),
    ('{"reasoning": "", "explanation": ""}', (None, None, None, "")),
    ('{"reasoning": ""}', NOTHING),
    ('{"reasoning": "[]", "explanation": "e"}', (None, None, None, "[]")),
    # finding the object
    ('Sure: {"diagnosis": 1} done', (P, None, None, None)),
    ('```json\n{"diagnosis": 1}\n```', (P, None, None, None)),
    ('　{"diagnosis": 1}\x85 ', (P, None, None, None)),
    ('{"diagnosis": 1} trailing', NOTHING),
    ('{"diagnosis": 1}{"diagnosis": 1}', NOTHING),
    ('{"diagnosis": 1}, {"diagnosis": 1}', NOTHING),
    ('{"diagnosis": 1}], [{"diagnosis": 1}', NOTHING),
    ('a {"diagnosis": 1} b {"diagnosis": 0} c', NOTHING),
    ("} {", NOTHING),
    ("{", NOTHING),
    ("", NOTHING),
    (None, NOTHING),
    ("I cannot help.", NOTHING),
    ('["diagnosis"]', NOTHING),
    # what JSON allows
    ("{'diagnosis': 1}", NOTHING),
    ('{"diagnosis": NaN}', NOTHING),
    ('{"diagnosis": 1,}', NOTHING),
    ('{"diagnosis": 0, "diagnosis": 1}', (P, None, None, None)),
    ('{"diagnosis": 1, "x": {"diagnosis": 0}}', (P, None, None, None)),
]


@pytest.fixture(scope="module")
def results(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES)]
    df = normalize_predictions(spark.createDataFrame(rows, "id int, response string"))
    return {row.id: tuple(row)[1:] for row in df.collect()}


@pytest.mark.parametrize("index", range(len(CASES)))
def test_case(results, index):
    assert results[index] == CASES[index][1], CASES[index][0]


def test_stays_on_the_jvm_in_one_stage(spark, plan):
    df = spark.range(3).selectExpr("id", "string(id) as response")
    text = plan(normalize_predictions(df))
    assert "Python" not in text and "Exchange" not in text


def test_a_filter_does_not_parse_again(spark, plan):
    df = spark.range(3).selectExpr("id", "string(id) as response")
    filtered = normalize_predictions(df).where("pred_diagnosis = 'delusional'")
    assert plan(filtered).count("parseJson") == 1
