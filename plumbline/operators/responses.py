"""Normalise a column of model answers into typed predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import answers
from plumbline.session import keep_last_duplicate_key

PREDICTION_COLUMNS = (
    "pred_diagnosis",
    "pred_severity",
    "pred_confidence",
    "pred_reasoning",
)


FIELDS = ("severity", "confidence", "reasoning", "explanation")


def with_answer_object(df: DataFrame, response: str, name: str) -> DataFrame:
    """Add the JSON object found in ``response`` as a VARIANT column ``name``."""
    keep_last_duplicate_key(df)
    parsed, mark = answers.sealed(F.col("_text"))
    answer = F.when(
        answers.is_sealed(F.col("_parsed"), F.col("_mark")),
        answers.member(F.col("_parsed"), "$[0]"),
    )
    return (
        df.withColumn("_text", answers.object_text(F.col(response)))
        .withColumns({"_parsed": parsed, "_mark": mark})
        .withColumn(name, answer)
        .drop("_text", "_parsed", "_mark")
    )


def _with_values(df: DataFrame, answer: str, fields: tuple[str, ...]) -> DataFrame:
    """Add kind, text and number of each field, in steps that each mention a column once."""
    members = {f"_{f}": answers.member(F.col(answer), f"$.{f}") for f in fields}
    kinds = {f"_{f}_kind": answers.kind_of(F.col(f"_{f}")) for f in fields}
    texts = {f"_{f}_text": answers.text_of(F.col(f"_{f}")) for f in fields}
    numbers = {
        f"_{f}_number": answers.number_of(F.col(f"_{f}_kind"), F.col(f"_{f}_text"))
        for f in fields
    }
    return df.withColumns(members).withColumns(kinds | texts).withColumns(numbers)


def _value(field: str) -> answers.Value:
    return answers.Value(*[F.col(f"_{field}_{part}") for part in ("kind", "text", "number")])


def normalize_predictions(df: DataFrame, response: str = "response") -> DataFrame:
    """Replace ``response`` by the four prediction columns.

    An answer without a readable JSON object gives four nulls. Row by row on
    the JVM: no shuffle and no Python stage.

    The object and the diagnosis pass through a one-element ``inline``. A filter
    on the diagnosis then stays above it; pushed further down, it would parse
    the answer once for every mention in the condition.
    """
    kept = [c for c in df.columns if c != response]
    with_diagnosis = (
        _with_values(
            with_answer_object(df, response, "_answer"), "_answer", ("diagnosis",)
        )
        .withColumn("pred_diagnosis", answers.diagnosis(_value("diagnosis")))
        .select(*kept, F.inline(F.array(F.struct("_answer", "pred_diagnosis"))))
    )
    return (
        _with_values(with_diagnosis, "_answer", FIELDS)
        .withColumns(
            {
                "_severity": answers.integer_of(_value("severity")),
                "_confidence": answers.integer_of(_value("confidence")),
                "pred_reasoning": answers.reasoning(
                    _value("reasoning"), _value("explanation")
                ),
            }
        )
        .withColumns(
            {
                "pred_severity": answers.severity(
                    F.col("_severity"), F.col("pred_diagnosis")
                ),
                "pred_confidence": answers.confidence(F.col("_confidence")),
            }
        )
        .select(*kept, *PREDICTION_COLUMNS)
    )
