"""Checks on generated data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.fixed_values import (
    ITEM_NEGATIVE_LABEL,
    ITEM_POSITIVE_LABEL,
    ITEMS_PER_KIND,
    NORMAL_TYPE,
    WORD_LIMIT,
)
from plumbline.functions.text import over_word_limit, word_count
from plumbline.operators.json_lines import with_items


def with_word_count(df: DataFrame, text: str = "sentence") -> DataFrame:
    """Add ``word_count`` and ``over_30_words``."""
    words = word_count(F.col(text))
    return df.withColumns(
        {"word_count": words, f"over_{WORD_LIMIT}_words": over_word_limit(words)}
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, share)`` per class."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def _agrees(item: Column, requested: Column) -> Column:
    """True when label, type and severity of an item fit together."""
    positive = (
        (item["label"] == ITEM_POSITIVE_LABEL)
        & (item["type"] == requested)
        & item["severity"].between(1, 3)
    )
    normal = (
        (item["label"] == ITEM_NEGATIVE_LABEL)
        & (item["type"] == NORMAL_TYPE)
        & (item["severity"] == 0)
    )
    return F.coalesce(positive | normal, F.lit(False))


def contract_checks(
    responses: DataFrame,
    response: str = "response",
    requested: str = "type_requested",
    n_delusional: int = ITEMS_PER_KIND,
    n_normal: int = ITEMS_PER_KIND,
) -> DataFrame:
    """``(type, check, n_bad, passed)``: the rules of the prompt, per requested type.

    ``counts`` and ``ids`` count bad responses, ``agreement`` and ``word_limit``
    bad items, ``repetition`` surplus copies of a sentence within a type. The
    first four are settled inside each response row. Only the last needs a
    shuffle by sentence, and copies fold together before it.
    """
    items = F.col("items")

    def with_label(label: str) -> Column:
        return F.size(F.filter(items, lambda i: i["label"] == label))

    ids = F.transform(items, lambda i: i["id"])
    size = F.size(items)
    good_counts = (
        (size == n_delusional + n_normal)
        & (with_label(ITEM_POSITIVE_LABEL) == n_delusional)
        & (with_label(ITEM_NEGATIVE_LABEL) == n_normal)
    )
    # 1..n without gap or duplicate; no items, no fault
    good_ids = F.array_sort(ids).eqNullSafe(
        F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    )
    rows = (
        with_items(responses, response)
        .select(
            F.col(requested).alias("type"),
            good_counts.alias("good_counts"),
            good_ids.alias("good_ids"),
            F.posexplode_outer("items").alias("pos", "item"),
        )
        .withColumn("first", F.coalesce(F.col("pos"), F.lit(0)) == 0)
    )
    item = F.col("item")
    present = F.col("pos").isNotNull()
    by_sentence = rows.groupBy("type", item["sentence"].alias("sentence")).agg(
        F.count_if(F.col("first") & ~F.col("good_counts")).alias("counts"),
        F.count_if(F.col("first") & ~F.col("good_ids")).alias("ids"),
        F.count_if(present & ~_agrees(item, F.col("type"))).alias("agreement"),
        F.count_if(over_word_limit(word_count(item["sentence"]))).alias("word_limit"),
        F.count(item["sentence"]).alias("copies"),
    )
    checks = ["counts", "ids", "agreement", "word_limit"]
    by_type = by_sentence.groupBy("type").agg(
        *[F.sum(c).alias(c) for c in checks],
        F.sum(F.greatest(F.col("copies") - 1, F.lit(0))).alias("repetition"),
    )
    names = [*checks, "repetition"]
    pairs = [x for name in names for x in (F.lit(name), F.col(name))]
    return by_type.select(
        "type", F.stack(F.lit(len(names)), *pairs).alias("check", "n_bad")
    ).withColumn("passed", F.col("n_bad") == 0)
