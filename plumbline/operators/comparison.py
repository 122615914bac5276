"""Compare two runs over the same rows, measure by measure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.distributions import normal_p, student_p
from plumbline.operators.ordering import prefix_sums
from plumbline.session import materialise


def with_severity_error(
    df: DataFrame, gold: str = "severity", pred: str = "pred_severity"
) -> DataFrame:
    """Add ``severity_error``, the absolute difference; null unless both are present."""
    return df.withColumn(
        "severity_error", F.abs(F.col(pred).cast("double") - F.col(gold).cast("double"))
    )


def _unpivot(measures: dict[str, Column], value: str) -> Column:
    pairs = [x for name, column in measures.items() for x in (F.lit(name), column)]
    return F.stack(F.lit(len(measures)), *pairs).alias("measure", value)


def measures_long(df: DataFrame, run: str, measures: list[str]) -> DataFrame:
    """``(run, measure, value)`` rows of one run, null where a measure is missing."""
    columns = {m: F.col(m).cast("double") for m in measures}
    return df.select(F.lit(run).alias("run"), _unpivot(columns, "value"))


def descriptives(long: DataFrame) -> DataFrame:
    """Per run and measure: n, missing, mean, standard deviation, range, median.

    The rows are read once and folded to counts of distinct values, which all
    figures are worked out from. So the median is exact, and yet no task holds
    all values of a group.
    """
    by = ["run", "measure"]
    counts = materialise(
        long.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_count"))
    )
    value, count = F.col("value"), F.col("_count")
    n = F.coalesce(F.sum(F.when(value.isNotNull(), count)), F.lit(0))
    # one row per run and measure
    moments = counts.groupBy(*by).agg(
        n.alias("n"),
        F.coalesce(F.sum(F.when(value.isNull(), count)), F.lit(0)).alias("missing"),
        F.try_divide(F.sum(value * count), n).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    present = counts.where(value.isNotNull())
    placed = prefix_sums(present, [F.col("value")], {"_before": count}, by).join(
        moments.select(*by, "n", "mean"), by
    )
    # the values at the two middle positions, counted from 0
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)

    def holds(position: Column) -> Column:
        return (F.col("_before") <= position) & (position < F.col("_before") + count)

    spread = placed.groupBy(*by).agg(
        F.sum(count * (value - F.col("mean")) * (value - F.col("mean"))).alias("_squares"),
        F.avg(F.when(holds(low) | holds(high), value)).alias("median"),
    )
    return moments.join(spread, by, "left").select(
        *by,
        "n",
        "missing",
        "mean",
        F.sqrt(F.try_divide(F.col("_squares"), F.col("n") - 1)).alias("sd"),
        "min",
        "max",
        "median",
    )


def _one_row_per_key(run: DataFrame, measures: list[str], key: str, side: str) -> DataFrame:
    """The measures by key; reading it fails on a repeated key and names it.

    The grouping by key is the one that the join needs, so it adds no shuffle.
    """
    columns = [F.any_value(F.col(m).cast("double")).alias(f"_{side}_{m}") for m in measures]
    message = F.concat(
        F.lit(f"{key} "), F.col(key).cast("string"), F.lit(f" occurs more than once in the {side} run")
    )
    once = F.when(F.col("_rows") > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    return (
        run.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"), *columns)
        .where(once)
        .drop("_rows")
    )


def paired_differences(
    first: DataFrame, second: DataFrame, measures: list[str], key: str = "id"
) -> DataFrame:
    """``(key, measure, d)``: first run minus second, for rows both runs have.

    A pair with a missing value on either side gives no row for that measure. A key that
    a run has twice fails the job; rows without a key pair with nothing.
    """
    left = _one_row_per_key(first, measures, key, "first")
    right = _one_row_per_key(second, measures, key, "second")
    differences = {m: F.col(f"_first_{m}") - F.col(f"_second_{m}") for m in measures}
    return (
        left.join(right, key)
        .select(key, _unpivot(differences, "d"))
        .where(F.col("d").isNotNull())
    )


def _for_all(
    tests: DataFrame, measures: list[str] | None, zeros: tuple[str, ...]
) -> DataFrame:
    """A row for every named measure, also for one without a pair."""
    if measures is None:
        return tests
    names = F.explode(F.array(*[F.lit(m) for m in measures])).alias("measure")
    named = tests.sparkSession.range(1).select(names)
    return named.join(tests, "measure", "left").na.fill(0, list(zeros))


def paired_t(differences: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """Paired t-test per measure: ``n, mean, sd, t, df, p``; t is null without spread.

    A measure of ``measures`` without a pair has n = 0 and no statistics.
    """
    tests = (
        differences.groupBy("measure")
        .agg(
            F.count("d").alias("n"),
            F.avg("d").alias("mean"),
            F.stddev_samp("d").alias("sd"),
        )
        .withColumn("t", F.try_divide("mean", F.col("sd") / F.sqrt("n")))
        .withColumn("df", F.col("n") - 1)
        .withColumn("p", student_p("t", F.col("df").cast("double")))
    )
    return _for_all(tests, measures, ("n",))


#: Differences other than zero for which the exact distribution is worked out.
MAX_EXACT = 1000


def _exact_p(table: pa.Table) -> pa.Table:
    """The two-sided p of one measure from the distribution of its rank sum.

    Under the null hypothesis every rank is added or not with equal chances. Ranks are
    doubled, since averages of ties end in halves; each one shifts and halves the
    distribution found so far.
    """
    rank, tied, positive = (table[name].to_numpy() for name in ("rank", "tied", "positive"))
    doubled = np.round(2 * rank).astype(np.int64)
    chances = np.zeros(int((doubled * tied).sum()) + 1)
    chances[0] = 1.0
    top = 0
    for value, count in zip(doubled.tolist(), tied.tolist()):
        for _ in range(count):
            added = chances[: top + 1] / 2
            chances[: top + 1] = added
            chances[value : value + top + 1] += added
            top += value
    plus = int((doubled * positive).sum())
    # the distribution is symmetric about half its top
    p = min(1.0, 2 * float(chances[: min(plus, top - plus) + 1].sum()))
    return pa.table({"measure": table["measure"].slice(0, 1), "exact_p": [p]})


def wilcoxon_signed_rank(
    differences: DataFrame, measures: list[str] | None = None, method: str = "normal"
) -> DataFrame:
    """Wilcoxon signed-rank test per measure: ``pairs, n, w_plus, w_minus, z, p``.

    Zeros are dropped, ties get their average rank. By the ``method`` "normal", p comes from z,
    the normal approximation with tie correction and without continuity correction; by "exact"
    it is that of the rank sum's own distribution, ties included, for at most ``MAX_EXACT``
    differences a measure. The differences are read once and folded to one row per
    distinct size; ranks are worked out on those. A measure of ``measures`` without a pair
    has zero pairs and no z.
    """
    if method not in ("normal", "exact"):
        raise ValueError("method must be normal or exact")
    counts = materialise(
        differences.groupBy("measure", F.abs("d").alias("size")).agg(
            F.count_if(F.col("d") > 0).alias("positive"),
            F.count(F.lit(1)).alias("tied"),
        )
    )
    present = counts.where(F.col("size") > 0)
    if method == "exact":
        largest = present.groupBy("measure").agg(F.sum("tied").alias("n")).agg(F.max("n")).first()[0]
        if (largest or 0) > MAX_EXACT:
            raise ValueError(f"the exact distribution is for at most {MAX_EXACT} differences, not {largest}")
    ranked = prefix_sums(
        present, [F.col("size")], {"smaller": F.col("tied")}, ["measure"]
    ).withColumn("rank", F.col("smaller") + (F.col("tied").cast("double") + 1) / 2)
    tied = F.col("tied").cast("double")
    positive = F.col("positive").cast("double")
    ranks = ranked.groupBy("measure").agg(
        F.sum("tied").alias("n"),
        F.sum(positive * F.col("rank")).alias("w_plus"),
        F.sum((tied - positive) * F.col("rank")).alias("w_minus"),
        F.sum(tied * tied * tied - tied).alias("_ties"),
    )
    if method == "exact":
        found = ranked.groupBy("measure").applyInArrow(_exact_p, "measure string, exact_p double")
        ranks = ranks.join(found, "measure")
    n = F.col("n").cast("double")
    # a measure whose differences are all zero still gets its row
    tests = (
        counts.groupBy("measure")
        .agg(F.sum("tied").alias("pairs"))
        .join(ranks, "measure", "left")
        .na.fill(0, ["n", "w_plus", "w_minus", "_ties"])
        .withColumn(
            "z",
            F.try_divide(
                F.col("w_plus") - n * (n + 1) / 4,
                F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48),
            ),
        )
        .withColumn("p", normal_p("z") if method == "normal" else F.col("exact_p"))
        .drop("_ties", "exact_p")
    )
    return _for_all(tests, measures, ("pairs", "n", "w_plus", "w_minus"))
