"""Score predictions against human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.fixed_values import (
    ACCURACY_LINE,
    GOLD_SPELLINGS,
    LABELS,
    MATRIX_LINE,
    NEGATIVE,
    NO_GOLD,
    NO_VALID_PREDICTIONS,
    POSITIVE,
)
from plumbline.functions.text import folded
from plumbline.operators.ordering import placed
from plumbline.session import materialise


def gold_label(value: Column, kind: T.DataType = T.StringType()) -> Column:
    """A human label in the words of the predictions.

    Known spellings map to the two labels; anything else stays as its stripped,
    lower-case text and a missing label stays null. ``kind`` is the type of the
    column: numbers and booleans map 1 and 0 whatever their width.
    """
    text = folded(value)
    mapped = text
    for spelling, label in GOLD_SPELLINGS.items():
        mapped = F.when(text == spelling, F.lit(label)).otherwise(mapped)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        number = value.cast("double")
        return (
            F.when(number == 1, F.lit(POSITIVE))
            .when(number == 0, F.lit(NEGATIVE))
            .otherwise(text)
        )
    return mapped


def with_gold(df: DataFrame, column: str, name: str = "gold") -> DataFrame:
    return df.withColumn(name, gold_label(F.col(column), df.schema[column].dataType))


def is_valid(pred: Column) -> Column:
    """True when a prediction is one of the two labels."""
    return F.coalesce(folded(pred).isin(*LABELS), F.lit(False))


def _is_correct(pred: Column, gold: Column) -> Column:
    return F.coalesce(folded(pred) == gold, F.lit(False))


def attach_predictions(test: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """All test rows with their prediction columns (null where there is none)."""
    return test.join(predictions, key, "left")


def with_correctness(
    df: DataFrame, gold: str = "gold", pred: str = "pred_diagnosis"
) -> DataFrame:
    """Add ``pred_correct`` for every row; false without a prediction or a label."""
    return df.withColumn("pred_correct", _is_correct(F.col(pred), F.col(gold)))


def _summary(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """All counts the metrics need, in one pass and one row."""
    g, p = F.col(gold), folded(F.col(pred))
    valid = is_valid(F.col(pred))

    def count(condition: Column) -> Column:
        return F.count_if(valid & F.coalesce(condition, F.lit(False)))

    columns = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(valid).alias("n_valid"),
        count(p == g).alias("n_correct"),
    ]
    for label, short in ((POSITIVE, "pos"), (NEGATIVE, "neg")):
        columns += [
            count((p == label) & (g == label)).alias(f"{short}_both"),
            count(p == label).alias(f"{short}_pred"),
            count(g == label).alias(f"{short}_gold"),
        ]
    return df.agg(*columns)


def metrics(
    df: DataFrame, gold: str = "gold", pred: str = "pred_diagnosis"
) -> DataFrame:
    """``(name, value)``: counts, accuracy, and precision and recall per label.

    Over rows with a valid prediction only; a row without a human label counts
    as wrong. A ratio over no rows is null.
    """
    ratios = {
        "n_rows": F.col("n_rows").cast("double"),
        "n_valid": F.col("n_valid").cast("double"),
        "accuracy": F.try_divide("n_correct", "n_valid"),
        "precision": F.try_divide("pos_both", "pos_pred"),
        "recall": F.try_divide("pos_both", "pos_gold"),
        "precision_non_delusional": F.try_divide("neg_both", "neg_pred"),
        "recall_non_delusional": F.try_divide("neg_both", "neg_gold"),
    }
    pairs = [x for name, value in ratios.items() for x in (F.lit(name), value)]
    return _summary(df, gold, pred).select(
        F.stack(F.lit(len(ratios)), *pairs).alias("name", "value")
    )


def accuracy(df: DataFrame, gold: str = "gold", pred: str = "pred_diagnosis") -> DataFrame:
    """One row: ``n_rows, n_valid, accuracy``."""
    return _summary(df, gold, pred).select(
        "n_rows", "n_valid", F.try_divide("n_correct", "n_valid").alias("accuracy")
    )


def precision_recall(
    df: DataFrame, gold: str = "gold", pred: str = "pred_diagnosis"
) -> DataFrame:
    """``(label, n_gold, n_pred, n_both, precision, recall)`` for both labels."""
    counts = [
        x
        for label, short in ((POSITIVE, "pos"), (NEGATIVE, "neg"))
        for x in (
            F.lit(label), F.col(f"{short}_gold"), F.col(f"{short}_pred"), F.col(f"{short}_both")
        )
    ]
    return (
        _summary(df, gold, pred)
        .select(F.stack(F.lit(2), *counts).alias("label", "n_gold", "n_pred", "n_both"))
        .withColumns(
            {
                "precision": F.try_divide("n_both", "n_pred"),
                "recall": F.try_divide("n_both", "n_gold"),
            }
        )
    )


def confusion_matrix(
    df: DataFrame, gold: str = "gold", pred: str = "pred_diagnosis"
) -> DataFrame:
    """One row per observed human label, one column per predicted label.

    Labels that map to neither word keep a row of their own. The two columns are
    fixed, so the table is one partial aggregation with a known schema.
    """
    return (
        df.where(is_valid(F.col(pred)))
        .groupBy(F.col(gold).alias("gold"))
        .agg(
            F.count_if(folded(F.col(pred)) == POSITIVE).alias("delusional"),
            F.count_if(folded(F.col(pred)) == NEGATIVE).alias("non_delusional"),
        )
    )


def report(df: DataFrame, gold: str = "gold", pred: str = "pred_diagnosis") -> DataFrame:
    """``(line, metrics)``: the accuracy line and the matrix, or why there is none."""
    return report_of(materialise(confusion_matrix(df, gold, pred)))


def report_of(confusion: DataFrame) -> DataFrame:
    """The report's lines from a written confusion table, one line per human label.

    Labels come in their order, rows without a label last; a predicted label that never
    occurs has no column. Only the totals reach the driver, in one row.
    """
    name = F.coalesce("gold", F.lit(NO_GOLD))
    hits = F.when(F.col("gold") == POSITIVE, F.col("delusional")).when(
        F.col("gold") == NEGATIVE, F.col("non_delusional")
    )
    totals = confusion.agg(
        F.coalesce(F.sum("delusional"), F.lit(0)).alias("delusional"),
        F.coalesce(F.sum("non_delusional"), F.lit(0)).alias("non_delusional"),
        F.coalesce(F.sum(hits), F.lit(0)).alias("correct"),
        F.max(F.greatest(F.length(name), F.lit(4))).alias("width"),
    ).first()
    predicted = {POSITIVE: "delusional", NEGATIVE: "non_delusional"}
    shown = {label: column for label, column in predicted.items() if totals[column]}
    n_valid = totals["delusional"] + totals["non_delusional"]
    spark = confusion.sparkSession
    if not n_valid:
        return spark.range(1).select(
            F.lit(1).cast("bigint").alias("line"), F.lit(NO_VALID_PREDICTIONS).alias("metrics")
        )
    width = totals["width"]
    accuracy = f"{ACCURACY_LINE}{totals['correct'] / n_valid:.3f}"
    heading = (accuracy + MATRIX_LINE).rstrip("\n").split("\n")
    heading.append("pred".ljust(width) + "".join(f"  {label}" for label in shown))
    heading.append("gold".ljust(width) + "".join(" " * (len(label) + 2) for label in shown))
    above = spark.range(1).select(
        F.posexplode(F.array(*[F.lit(text) for text in heading])).alias("line", "metrics")
    )
    cells = [
        F.concat(F.lit("  "), _right(F.col(column).cast("string"), label))
        for label, column in shown.items()
    ]
    rows = placed(confusion, F.col("gold").asc_nulls_last()).select(
        (F.col("_place") + len(heading) + 1).alias("line"),
        F.concat(F.rpad(name, width, " "), *cells).alias("metrics"),
    )
    return above.select((F.col("line") + 1).cast("bigint").alias("line"), "metrics").unionByName(rows)


def _right(value: Column, label: str) -> Column:
    """Right-aligned under the label's heading, wider if the number needs it."""
    return F.lpad(value, F.greatest(F.lit(len(label)), F.length(value)), " ")
