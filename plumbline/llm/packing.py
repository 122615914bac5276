"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of length n belongs to class ``capacity // n``: that many pieces of the class
fit one sequence, whatever their exact lengths. Every class fills its sequences with
just that number of pieces, so a piece's place follows from its number within the class
alone, and workers need to know no more than how many pieces come before theirs.

Documents are cut to waste little: full sequences first, then, while the rest would leave
more than ``waste`` of a sequence empty in its class, a piece of the next reciprocal of
the capacity. Cuts depend on the document's own length only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import array_merging
from plumbline.llm.common import stored, texts_of
from plumbline.llm.texts import parts
from plumbline.llm.tokens import binaries, token_ids, vocabulary_in_task
from plumbline.llm.vocabulary import broadcast_file, from_json

#: Largest share of a sequence left empty in a class whose pieces are not cut further.
WASTE = 1 / 64
#: Pieces that one task numbers, and the least number of tasks.
SHARD_PIECES = 500_000
LEAST_SHARDS = 256


def piece_lengths(total: int, capacity: int, waste: float = WASTE) -> list[int]:
    """The lengths that a document of ``total`` tokens is cut into, in order."""
    lengths = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        fit = capacity // rest
        next_size = capacity // (fit + 1)
        if capacity - fit * rest <= waste * capacity or not next_size:
            lengths.append(rest)
            break
        lengths.append(next_size)
        rest -= next_size
    return lengths


def cut(
    docs: DataFrame,
    vocabulary_path: str,
    capacity: int,
    end_id: int,
    identifier: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of every document: its ids and then ``end_id``, cut for ``place``.

    Columns: the identifier, ``start``, ``length``, ``doc_tokens``, and ``ids`` as
    little-endian unsigned 32-bit integers in one binary. A null or empty text is the end
    id alone. One pass without a shuffle.
    """
    raw = broadcast_file(docs.sparkSession, vocabulary_path)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_in_task(from_json, raw.value)
        for batch in batches:
            for part in parts(batch.column(1)):
                ids, offsets = token_ids(vocabulary, part, array_merging.encode)
                ids = np.insert(ids, offsets[1:], end_id)
                totals = np.diff(offsets) + 1
                cuts = [piece_lengths(int(n), capacity) for n in totals]
                counts = np.array([len(c) for c in cuts])
                lengths = np.concatenate([np.array(c, dtype=np.int64) for c in cuts])
                ends = np.cumsum(lengths)
                document_starts = np.repeat(np.cumsum(totals) - totals, counts)
                rows = np.repeat(np.arange(len(part)), counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(part)).take(pa.array(rows)),
                        pa.array(ends - lengths - document_starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(np.repeat(totals, counts), pa.int64()),
                        binaries(ids.astype("<u4").view(np.uint8), np.append(0, ends) * 4),
                    ],
                    names=[identifier, "start", "length", "doc_tokens", "ids"],
                )

    source = texts_of(docs, identifier, text)
    kind = source.schema[identifier].dataType.simpleString()
    return source.mapInArrow(
        pieces, f"`{identifier}` {kind}, start bigint, length bigint, doc_tokens bigint, ids binary"
    )


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with ``sequence_id``, ``offset`` in it, and ``padded_length``.

    Any columns besides ``length`` are carried along. Pieces are numbered within
    (class, shard); counts of the shards before give the number within the class, and
    class and number give the sequence. What does not fill a class's last sequence, less
    than one sequence's pieces per class and so a number that does not grow with the
    data, is packed by the longest first. A sequence whose length is a power of two needs
    no padding. No pieces give no rows.
    """
    added = ["sequence_id", "offset", "padded_length"]
    pieces = pieces.drop(*added)
    kept = stored(
        pieces.withColumn("_class", F.floor(F.lit(capacity) / F.col("length")).cast("int"))
        .withColumn("_piece", F.monotonically_increasing_id())
    )
    shards = max(LEAST_SHARDS, -(-kept.count() // SHARD_PIECES))
    sharded = kept.withColumn("_shard", F.pmod(F.xxhash64("_piece"), F.lit(shards)).cast("int"))
    # at most classes x shards rows; per class a running total over the shards
    earlier = Window.partitionBy("_class").orderBy("_shard")
    every = Window.partitionBy("_class")
    counts = stored(
        sharded.groupBy("_class", "_shard")
        .count()
        .select(
            "_class",
            "_shard",
            (F.sum("count").over(earlier) - F.col("count")).alias("_before"),
            F.floor(F.sum("count").over(every) / F.col("_class")).alias("_full"),
        )
    )
    # one row per class: how many full sequences the classes before it have
    classes = counts.select("_class", "_full").distinct()
    bases = classes.select(
        "_class", (F.sum("_full").over(Window.orderBy("_class")) - F.col("_full")).alias("_base")
    )
    full_sequences = classes.agg(F.sum("_full")).first()[0] or 0
    in_shard = Window.partitionBy("_class", "_shard").orderBy("_piece")
    numbered = stored(
        sharded.withColumn("_number", F.row_number().over(in_shard) - 1)
        .join(counts, ["_class", "_shard"])
        .join(F.broadcast(bases), "_class")
        .withColumn("_number", F.col("_number") + F.col("_before"))
        .withColumn("_bin", F.floor(F.col("_number") / F.col("_class")))
        .drop("_before", "_shard")
    )
    before = Window.partitionBy("_class", "_bin").orderBy("_number")
    filled = (
        numbered.where(F.col("_bin") < F.col("_full"))
        .withColumn("sequence_id", F.col("_base") + F.col("_bin"))
        .withColumn("offset", F.sum("length").over(before) - F.col("length"))
        .withColumn("_used", F.sum("length").over(Window.partitionBy("_class", "_bin")))
        .drop("_number", "_bin", "_full", "_base", "_class", "_piece")
    )
    rest = numbered.where(F.col("_bin") >= F.col("_full"))
    schema = "_piece bigint, sequence_id bigint, offset bigint, _used bigint"
    fitted = (
        rest.select("_piece", "length")
        .withColumn("_group", F.lit(0))
        .groupBy("_group")
        .applyInPandas(lambda group: _longest_first(group, capacity, full_sequences), schema)
    )
    leftover = rest.join(F.broadcast(fitted), "_piece").select(filled.columns)
    used = F.col("_used")
    is_power = used.bitwiseAND(used - 1) == 0
    return (
        filled.unionByName(leftover)
        .withColumn("padded_length", F.when(is_power, used).otherwise(F.lit(capacity).cast("bigint")))
        .drop("_used")
    )


def _longest_first(group: pd.DataFrame, capacity: int, first_id: int) -> pd.DataFrame:
    """First-fit decreasing over the leftover pieces."""
    group = group.sort_values(["length", "_piece"], ascending=[False, True])
    room: list[int] = []
    sequence, offset = [], []
    open_from = 0
    for length in group["length"]:
        at = next((i for i in range(open_from, len(room)) if room[i] >= length), len(room))
        if at == len(room):
            room.append(capacity)
        sequence.append(at)
        offset.append(capacity - room[at])
        room[at] -= length
        while open_from < len(room) and room[open_from] == 0:
            open_from += 1
    used = np.array([capacity - r for r in room], dtype=np.int64)
    sequence = np.array(sequence, dtype=np.int64)
    return pd.DataFrame(
        {
            "_piece": group["_piece"].to_numpy(),
            "sequence_id": sequence + first_id,
            "offset": offset,
            "_used": used[sequence],
        }
    )


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence: ``sequence_id``, its ``ids`` in order, ``padded_length``.

    A sequence holds at most its capacity of ids, so the lists are bounded.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"]))
    return placed.groupBy("sequence_id").agg(
        joined.alias("ids"), F.max("padded_length").alias("padded_length")
    )
