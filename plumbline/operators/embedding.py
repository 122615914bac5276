"""Embedding reuse: compute vectors only for texts not seen with this model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.fixed_values import EMBED_BATCH
from plumbline.operators.lookup import HOT_ROWS, lookup
from plumbline.operators.scoring import EmbedFunction, embed


def content_key(text: Column, model: str) -> Column:
    """32 bytes that name a text under a model; null for a missing text."""
    return F.unhex(F.sha2(F.concat(F.lit(model + "\x1f"), text), 256))


def first_of_missing_keys(
    keyed: DataFrame, stored: DataFrame, row_id: str, key: str = "key"
) -> DataFrame:
    """``key`` and the smallest ``row_id`` of every key that ``stored`` does not hold.

    Keys and ids are all that is shuffled. Copies fold together before, so a text that
    makes up a third of the rows is a row per task.
    """
    first = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row_id).alias(row_id))
    return first.join(stored.select(key), key, "left_anti")


def rows_of(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose ``keys`` are among ``wanted``; missing ids equal each other."""
    right = wanted.select([F.col(name).alias(f"_wanted_{name}") for name in keys])
    return df.join(right, [F.col(name).eqNullSafe(F.col(f"_wanted_{name}")) for name in keys], "left_semi")


def cache_misses(
    texts: DataFrame, stored: DataFrame, model: str, text: str = "sentence", row_id: str = "id"
) -> DataFrame:
    """``(key, text)`` of the distinct texts whose key ``stored`` does not hold.

    In two steps. The first settles by keys which texts are missing, and for each one row
    that has it. Only those rows' texts are asked for in the second, where Spark sends the
    wanted rows to the texts if they are few. ``row_id`` tells rows apart; where it does not, a
    text may come twice.
    """
    keyed = texts.select(content_key(F.col(text), model).alias("key"), row_id, text)
    wanted = first_of_missing_keys(keyed.select("key", row_id), stored, row_id)
    return rows_of(keyed, wanted, ["key", row_id]).select("key", text)


def refresh_embeddings(
    texts: DataFrame,
    stored: DataFrame,
    embed_fn: EmbedFunction,
    model: str,
    text: str = "sentence",
    batch_size: int = EMBED_BATCH,
    parallelism: int | None = None,
    row_id: str = "id",
) -> DataFrame:
    """``(key, embedding)`` rows to append to the store for these texts.

    Write the result to the store before using it: a model call is too dear to
    repeat when an executor is lost.
    """
    misses = cache_misses(texts, stored, model, text, row_id)
    return embed(misses, embed_fn, text, "embedding", batch_size, parallelism).select(
        "key", "embedding"
    )


def attach_embeddings(
    texts: DataFrame,
    stored: DataFrame,
    model: str,
    text: str = "sentence",
    row_id: str = "id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``texts`` with the stored vector of each row's text (null when absent).

    The store has one row per key. Rows of a very frequent text are dealt out to
    several tasks.
    """
    keyed = texts.withColumn("_key", content_key(F.col(text), model))
    vectors = stored.select(F.col("key").alias("_key"), "embedding")
    return lookup(keyed, vectors, "_key", row_id, "left", hot_rows).drop("_key")
