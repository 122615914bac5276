"""Generated JSON-lines responses to one row per item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.fixed_values import GENERATION_TEMPERATURE
from plumbline.functions.items import json_items
from plumbline.functions.text import over_word_limit, word_count
from plumbline.session import keep_last_duplicate_key

DATASET_COLUMNS = (
    "type",
    "sentence_id",
    "sentence",
    "severity",
    "rationale",
    "model",
    "temperature",
    "word_count",
    "over_30_words",
)


def with_items(df: DataFrame, response: str = "response") -> DataFrame:
    """Replace ``response`` by ``items``, the array of its well-formed items."""
    keep_last_duplicate_key(df)
    return df.withColumn("items", json_items(F.col(response))).drop(response)


def explode_items(df: DataFrame, response: str = "response") -> DataFrame:
    """One row per well-formed item, numbered from 1 within its response.

    The number counts surviving items; the item's own ``id`` plays no part.
    Columns of ``df`` other than ``response`` are kept.
    """
    kept = [F.col(c) for c in df.columns if c != response]
    return (
        with_items(df, response)
        .select(*kept, F.posexplode("items").alias("_pos", "_item"))
        .select(*kept, (F.col("_pos") + 1).alias("sentence_id"), "_item.*")
    )


def tag_items(
    items: DataFrame,
    model: str,
    temperature: float = GENERATION_TEMPERATURE,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The generated dataset: tagged with model and temperature, and measured.

    ``keep`` names further columns of ``items`` to carry in front.
    """
    words = word_count(F.col("sentence"))
    return items.select(
        *keep,
        "type",
        "sentence_id",
        "sentence",
        "severity",
        "rationale",
        F.lit(model).alias("model"),
        F.lit(float(temperature)).alias("temperature"),
        words.alias("word_count"),
        over_word_limit(words).alias("over_30_words"),
    )


def append_datasets(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of separately generated datasets, one after another."""
    for other in others:
        first = first.unionByName(other)
    return first
