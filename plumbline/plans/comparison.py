"""Compare the written predictions of two runs over the same test table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.fixed_values import GOLD_COLUMNS
from plumbline.operators import comparison, evaluation
from plumbline.sources.tables import first_present, write_tables

#: What runs are compared by: right or wrong, distance to the human severity, confidence.
MEASURES = ["correct", "severity_error", "pred_confidence"]


class Comparison:
    """``descriptives`` has a row per run and measure, the others one per measure.

    Each table is worked out when it is first asked for; two of them start jobs of their
    own then.
    """

    def __init__(self, differences: DataFrame, long: DataFrame):
        self.differences = differences
        self._long = long

    @cached_property
    def descriptives(self) -> DataFrame:
        return comparison.descriptives(self._long)

    @cached_property
    def paired_t(self) -> DataFrame:
        return comparison.paired_t(self.differences, MEASURES)

    @cached_property
    def wilcoxon(self) -> DataFrame:
        return comparison.wilcoxon_signed_rank(self.differences, MEASURES)


@dataclass(frozen=True)
class WrittenComparison:
    """The same tables, read back from where they were written."""

    differences: DataFrame
    descriptives: DataFrame
    paired_t: DataFrame
    wilcoxon: DataFrame


def measured(
    predictions: DataFrame,
    gold_columns: tuple[str, ...] = GOLD_COLUMNS,
    severity: str = "severity",
) -> DataFrame:
    """A run's predictions with the three measures.

    ``correct`` is null in a table without human labels, ``severity_error`` in one
    without human severities.
    """
    gold = first_present(predictions, gold_columns)
    if gold is None:
        labelled = predictions.withColumn("correct", F.lit(None).cast("int"))
    else:
        labelled = evaluation.with_correctness(
            evaluation.with_gold(predictions, gold, "_gold"), "_gold"
        ).withColumn("correct", F.col("pred_correct").cast("int")).drop("_gold")
    if severity not in predictions.columns:
        return labelled.withColumn("severity_error", F.lit(None).cast("double"))
    return comparison.with_severity_error(labelled, severity)


def compare(
    first: DataFrame,
    second: DataFrame,
    names: tuple[str, str] = ("first", "second"),
    key: str = "id",
    gold_columns: tuple[str, ...] = GOLD_COLUMNS,
    severity: str = "severity",
    path: str | None = None,
) -> Comparison | WrittenComparison:
    """Descriptives of two runs, and tests of the rows that both have.

    ``first`` and ``second`` are ``predictions`` tables as ``classification.run`` writes
    them, with one row per ``key``; a key that a run has twice fails the job. With ``path`` the four tables are written there and
    read back.
    """
    runs = [measured(run, gold_columns, severity) for run in (first, second)]
    long = [comparison.measures_long(run, name, MEASURES) for run, name in zip(runs, names)]
    differences = comparison.paired_differences(*runs, MEASURES, key)
    if path is not None:
        folder = path.rstrip("/")
        write_tables(folder, differences=differences)
        differences = first.sparkSession.read.parquet(f"{folder}/differences")
    found = Comparison(differences, long[0].unionByName(long[1]))
    if path is None:
        return found
    names = ("descriptives", "paired_t", "wilcoxon")
    write_tables(folder, **{name: getattr(found, name) for name in names})
    read = first.sparkSession.read.parquet
    return WrittenComparison(differences, *[read(f"{folder}/{name}") for name in names])
