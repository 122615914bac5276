"""Scoring against human labels, by hand-worked tables."""

import pytest
from pyspark.sql import functions as F

from plumbline.fixed_values import NEGATIVE, NO_VALID_PREDICTIONS, POSITIVE
from plumbline.operators import evaluation as E

P, N = POSITIVE, NEGATIVE


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id int, gold string, pred_diagnosis string")


def test_gold_spellings(spark):
    given = {
        "0": N, "1": P, "0.0": N, "1.0": P, "Normal": N, " non delusional ": N,
        "non-delusion": N, "Delusion": P, "delusional": P, "Non-Delusional": N,
        "unsure": "unsure", "2": "2", None: None,
    }
    df = spark.createDataFrame([(k,) for k in given], "label string")
    got = {r.label: r.gold for r in E.with_gold(df, "label").collect()}
    assert got == given


@pytest.mark.parametrize("kind", ["int", "double", "decimal(3,1)", "boolean", "string"])
def test_gold_of_any_type_maps_both_labels(spark, kind):
    df = spark.createDataFrame([(1,), (0,)], "n int").select(
        "n", F.col("n").cast("int" if kind == "string" else kind).cast(kind).alias("label")
    )
    assert {r.n: r.gold for r in E.with_gold(df, "label").collect()} == {1: P, 0: N}


ROWS = [
    (1, P, P), (2, P, P), (3, P, N), (4, N, N), (5, N, P), (6, None, P),
    (7, "unsure", N), (8, P, None), (9, None, None), (10, N, "other"),
]


def test_metrics(spark):
    values = {r.name: r.value for r in E.metrics(_frame(spark, ROWS)).collect()}
    assert values == {
        "n_rows": 10.0,
        "n_valid": 7.0,
        "accuracy": pytest.approx(3 / 7),
        "precision": pytest.approx(2 / 4),
        "recall": pytest.approx(2 / 3),
        "precision_non_delusional": pytest.approx(1 / 3),
        "recall_non_delusional": pytest.approx(1 / 2),
    }


def test_confusion_cells_sum_to_valid_rows_and_give_the_accuracy(spark):
    cells = {
        r.gold: (r.delusional, r.non_delusional)
        for r in E.confusion_matrix(_frame(spark, ROWS)).collect()
    }
    assert cells == {P: (2, 1), N: (1, 1), None: (1, 0), "unsure": (0, 1)}
    total = sum(map(sum, cells.values()))
    assert total == 7
    assert (cells[P][0] + cells[N][1]) / total == pytest.approx(3 / 7)


def test_row_correctness_is_never_null(spark):
    rows = E.with_correctness(_frame(spark, ROWS)).collect()
    assert {r.id for r in rows if r.pred_correct} == {1, 2, 4}
    assert all(r.pred_correct is not None for r in rows)


def _lines(df):
    rows = sorted(E.report(df).collect(), key=lambda r: r.line)
    assert [r.line for r in rows] == list(range(1, len(rows) + 1))
    return [r.metrics for r in rows]


def test_report(spark):
    assert _lines(_frame(spark, ROWS)) == [
        "Accuracy (valid rows only): 0.429",
        "",
        "Confusion matrix:",
        "pred            delusional  non-delusional",
        "gold                                      ",
        "delusional               2               1",
        "non-delusional           1               1",
        "unsure                   0               1",
        "(no label)               1               0",
    ]
    one = _frame(spark, [(1, P, P), (2, P, P)])
    assert _lines(one)[3:] == ["pred        delusional", "gold                  ", "delusional           2"]
    many = _frame(spark, [(i, f"label {i:03}", P) for i in range(300)])
    assert _lines(many)[-1] == "label 299           1" and len(_lines(many)) == 305
    none = _frame(spark, [(1, P, None)])
    assert _lines(none) == [NO_VALID_PREDICTIONS]
    assert E.accuracy(none).first().accuracy is None
    labels = {r.label: r for r in E.precision_recall(none).collect()}
    assert labels[P].precision is None and labels[P].recall is None


def test_evaluation_is_one_partial_aggregation(spark, plan):
    text = plan(E.metrics(_frame(spark, ROWS)))
    assert "Python" not in text and text.count("Exchange") == 1
