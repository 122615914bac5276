"""Exact deduplication that stands hot texts, by DataFrame functions alone.

Skew-safe combining: equal texts fold within each map task, groups of one digest that hold
many rows are dealt out over salts and merge there, and the salts' winners merge last.
Groups are keyed by the content itself besides its digest at every stage, so texts whose
digests collide stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import HOT_SHARE, discard, stored, texts_of

#: Parts that a hot digest's rows are dealt out to.
SALTS = 64


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_duplicates(
    docs: DataFrame,
    identifier: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per document: the identifier, ``keep_id``, ``group_size``, ``kept``, ``digest``.

    Texts are equal when they are identical; a null text is an empty one. Of equal texts
    the one with the largest identifier stays. Rows with a null identifier count and come
    out, but stay only where no other row of the group has one, and then all of them do;
    rows that repeat an identifier and its text stay or go together. An empty table gives
    no rows; other columns are not read.

    Only texts reach a shuffle once, folded by the map tasks before it. The rows meet
    their groups by digest. Digests that collide are known by then; their rows, if any,
    meet the groups by content.
    """
    texts = texts_of(docs, identifier, text)
    digests = stored(texts.select(identifier, digest(F.col(text)).alias("digest")))
    total = digests.count()
    limit = max(1, int(total * HOT_SHARE))
    # fewer than 1 / HOT_SHARE digests can have so many rows
    hot = stored(digests.groupBy("digest").count().where(F.col("count") > limit).select("digest"))
    is_hot = F.broadcast(hot.select("digest", F.lit(True).alias("_hot")))
    # a hot digest's rows go by their map task, so that each still folds to one row there
    salt = F.when(F.col("_hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0)
    newest = F.max(identifier).alias("keep_id")
    salted = (
        texts.withColumn("digest", digest(F.col(text)))
        .join(is_hot, "digest", "left")
        .groupBy("digest", salt.alias("_salt"), F.col("_hot"), text)
        .agg(newest, F.count(F.lit(1)).alias("group_size"))
    )
    merged = stored(salted.drop("_salt"))
    winners = (
        merged.where(F.col("_hot"))
        .groupBy("digest", text)
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    groups = merged.where(F.col("_hot").isNull()).drop("_hot").unionByName(winners)
    by_digest = stored(
        groups.groupBy("digest").agg(
            F.count(F.lit(1)).alias("contents"),
            F.max("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
        )
    )
    alone = by_digest.where(F.col("contents") == 1).drop("contents")
    collided = by_digest.where(F.col("contents") > 1).select("digest")
    rows = digests.join(is_hot, "digest", "left")
    found = (
        rows.where(F.col("_hot")).drop("_hot").join(F.broadcast(alone.join(is_hot, "digest", "left_semi")), "digest")
    ).unionByName(
        rows.where(F.col("_hot").isNull()).drop("_hot").join(alone, "digest")
    )
    if collided.isEmpty():
        discard(merged)
    else:
        found = found.unionByName(
            texts.withColumn("digest", digest(F.col(text)))
            .join(collided, "digest", "left_semi")
            .join(groups.join(collided, "digest", "left_semi"), ["digest", text])
            .drop(text)
        )
    kept = F.col(identifier).eqNullSafe(F.col("keep_id"))
    return found.select(identifier, "keep_id", "group_size", kept.alias("kept"), "digest")
