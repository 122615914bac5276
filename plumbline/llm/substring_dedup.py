"""Removal of passages that an earlier document has: prefix doubling over thinned positions.

Prefix doubling gives every position the rank of the bytes that begin there, pairs a
position's rank with the rank further on to double the length, and drops positions once
their rank is unique. Ranks here are names, equal for equal bytes; their order is not
needed. Positions are thinned first, since a table of every byte position is many times
the input: of the 16-byte grams in a window of the threshold's length, the one of lowest
hash is the window's anchor. Equal windows have equal anchors, so no match is lost.

1. Length 16: anchors are grouped by gram. Grams of one document are unique and go.
2. Length 50 to 84: an anchor's rank is paired with the rank of all bytes of the windows
   that it is the anchor of, its context. A context that an earlier document has too is
   past the threshold: all its windows are covered.
3. Length 50: contexts that share a gram but are not equal, at the edges of matches, are
   compared window by window. A window's rank is the pair of the ranks of its halves.

Each step groups and joins by hashed names, folded within map tasks; nothing but spans
and edge contexts is left to move after the second.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.array_merging import binary_arrays
from plumbline.llm.common import discard, stored
from plumbline.llm.ragged import take
from plumbline.llm.texts import Hashes, Part, parts
from plumbline.llm.tokens import binaries

GRAM = 16
#: Contexts of one gram that a task compares by itself; those of a gram with more are
#: compared by shuffling their windows.
TASK_CONTEXTS = 20_000
#: Bytes of contexts that a task compares at once, unless one gram has more.
SLICE_BYTES = 2_000_000
#: Stands for a missing identifier: after all others.
LAST = 2**63 - 1

_LOW = np.uint64(0xFFFFFFFF)


def anchors(part: Part, threshold: int, gram: int = GRAM):
    """Anchors of all windows: text, gram name, context name, first and last window.

    Windows are numbered by their first byte within the text; those that one anchor has
    are neighbours.
    """
    hashes = Hashes(part.data)
    grams = hashes.rolling(gram)
    count = len(part.data) - threshold + 1
    if count <= 0:
        nothing = np.zeros(0, dtype=np.int64)
        return nothing, nothing.astype(np.uint64), nothing.astype(np.uint64), nothing, nothing
    # the lowest upper half wins, then the leftmost place
    lowest = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width, reach = threshold - gram + 1, 1
    while reach * 2 <= width:
        lowest = np.minimum(lowest[:-reach], lowest[reach:])
        reach *= 2
    if reach < width:
        lowest = np.minimum(lowest[:count], lowest[width - reach :][:count])
    text = np.repeat(np.arange(len(part)), np.diff(part.offsets))[:count]
    window = np.flatnonzero(np.arange(count) + threshold <= part.offsets[text + 1])
    anchor, text = (lowest[window] & _LOW).astype(np.int64), text[window]
    opens = np.ones(len(window), dtype=bool)
    opens[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(window))[: len(first)] - 1
    low, high, text = window[first], window[last], text[first]
    names = grams[anchor[first]]
    return text, names, hashes.of(low, high + threshold), low - part.offsets[text], high - part.offsets[text]


def _anchor_rows(source: DataFrame, threshold: int, contexts: bool) -> DataFrame:
    """``gram, doc`` of every anchor, with ``context, row, span`` if asked.

    ``span`` is 256 times the first window plus the number of further windows.
    """
    names = ["gram", "doc", "context", "row", "span"] if contexts else ["gram", "doc"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for part in parts(batch.column(2)):
                text, gram, context, low, high = anchors(part, threshold)
                columns = [gram.view(np.int64), doc[part.first + text]]
                if contexts:
                    span = low * 256 + (high - low)
                    columns += [context.view(np.int64), row[part.first + text], span]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return source.select("doc", "row", "text").mapInArrow(
        find, ", ".join(f"{name} bigint" for name in names)
    )


def _context_bytes(source: DataFrame, wanted: DataFrame, threshold: int) -> DataFrame:
    """``gram, context, doc, bytes`` of the wanted contexts, cut from their documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch.column(1), 1):
                lists = batch.column(2).slice(part.first, len(part))
                found = lists.flatten()
                gram, context, span = (found.field(i) for i in range(3))
                spans = span.to_numpy()
                low = spans // 256
                high = low + spans % 256 + threshold
                pieces, offsets = _slices(part.data, low, high)
                doc = batch.column(0).slice(part.first, len(part)).take(pa.array(np.zeros(len(low), np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [gram, context, doc, binaries(pieces, offsets)],
                    names=["gram", "context", "doc", "bytes"],
                )

    lists = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("gram", "context", "span")).alias("found"))
    return (
        source.join(lists, ["doc", "row"])
        .select("doc", "text", "found")
        .mapInArrow(cut, "gram bigint, context bigint, doc bigint, bytes binary")
    )


def _slices(data: np.ndarray, low: np.ndarray, high: np.ndarray):
    """The bytes of the slices low..high one after the other: (bytes, offsets)."""
    bounds = np.column_stack([low, high]).reshape(-1)
    return take(data, bounds, 2 * np.arange(len(low)))


def _windows(batch: pa.RecordBatch, threshold: int):
    """Of every window of a batch of contexts: context's place, number, names of both halves."""
    part = _one_part(batch.column(3))
    half = threshold // 2
    hashes = Hashes(part.data)
    counts = np.maximum(np.diff(part.offsets) - threshold + 1, 0)
    place = np.repeat(np.arange(len(part)), counts)
    number = np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = part.offsets[place] + number
    return place, number, hashes.of(at, at + half), hashes.of(at + half, at + threshold)


def _one_part(column: pa.Array) -> Part:
    return Part(0, *binary_arrays(column))


def _ranges(place, number):
    """Runs of neighbouring windows: (place, first, last)."""
    opens = np.ones(len(place), dtype=bool)
    opens[1:] = (place[1:] != place[:-1]) | (number[1:] != number[:-1] + 1)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(place))[: len(first)] - 1
    return place[first], number[first], number[last]


_COVERED = "gram bigint, context bigint, first bigint, last bigint"


def _whole_grams(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram in slices that end where a gram does.

    A slice has at most ``slice_bytes`` bytes of contexts, or one gram's.
    """
    waiting: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        (batch,) = pa.Table.from_batches(waiting).combine_chunks().to_batches()
        return batch

    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        grams = batch.column(0).to_numpy()
        lengths = np.cumsum(pc.binary_length(batch.column(3)).to_numpy())
        ends = np.flatnonzero(grams[1:] != grams[:-1]) + 1
        if waiting and waiting[-1].column(0)[-1].as_py() != grams[0]:
            ends = np.concatenate([[0], ends])
        at = 0
        while len(ends):
            # as many whole grams as fit, one at least
            taken = lengths[ends - 1] * (ends > 0) - (lengths[at - 1] if at else 0)
            fit = max(1, int(np.searchsorted(taken, slice_bytes - held, side="right")))
            end = int(ends[fit - 1])
            if end > at:
                waiting.append(batch.slice(at, end - at))
            if waiting:
                yield joined()
            waiting, held, at, ends = [], 0, end, ends[fit:]
        waiting.append(batch.slice(at))
        held += int(lengths[-1] - (lengths[at - 1] if at else 0))
    if waiting:
        yield joined()


def _compared_in_tasks(contexts: DataFrame, threshold: int) -> DataFrame:
    """Runs of windows that an earlier document's context with the same gram has.

    ``contexts`` come sorted by gram. A task holds a slice of them, ``SLICE_BYTES`` or a
    gram at a time, however many it gets; a gram has at most ``TASK_CONTEXTS``.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_grams(batches, SLICE_BYTES):
            place, number, left, right = _windows(batch, threshold)
            doc = batch.column(2).to_numpy()[place]
            order = np.lexsort((doc, right, left))
            same = (left[order][1:] == left[order][:-1]) & (right[order][1:] == right[order][:-1])
            begins = np.concatenate([[True], ~same])[: len(order)]
            earliest = doc[order][np.flatnonzero(begins)][np.cumsum(begins) - 1]
            covered = np.zeros(len(order), dtype=bool)
            covered[order] = earliest < doc[order]
            row, first, last = _ranges(place[covered], number[covered])
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(first, pa.int64()),
                    pa.array(last, pa.int64()),
                ],
                names=["gram", "context", "first", "last"],
            )

    return contexts.select("gram", "context", "doc", "bytes").mapInArrow(compare, _COVERED)


def _compared_by_shuffle(contexts: DataFrame, threshold: int) -> DataFrame:
    """The same for grams with many contexts: windows meet by the names of their halves."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, number, left, right = _windows(batch, threshold)
            rows = pa.array(place)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(rows) for i in range(3)),
                    pa.array(number, pa.int64()),
                    pa.array(left.view(np.int64)),
                    pa.array(right.view(np.int64)),
                ],
                names=["gram", "context", "doc", "number", "left", "right"],
            )

    windows = stored(
        contexts.select("gram", "context", "doc", "bytes").mapInArrow(
            spread,
            "gram bigint, context bigint, doc bigint, number bigint, left bigint, right bigint",
        )
    )
    earliest = stored(windows.groupBy("left", "right").agg(F.min("doc").alias("earliest")))
    return (
        windows.join(earliest, ["left", "right"])
        .where("earliest < doc")
        .select("gram", "context", F.col("number").alias("first"), F.col("number").alias("last"))
    )


def covered_spans(source: DataFrame, threshold: int) -> DataFrame:
    """``doc, row, low, high``: byte spans of windows that a smaller ``doc`` has too."""
    shared = stored(
        _anchor_rows(source, threshold, contexts=False)
        .groupBy("gram")
        .agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
        .where("low < high")
        .select("gram")
    )
    found = stored(
        _anchor_rows(source, threshold, contexts=True).join(shared.hint("shuffle_hash"), "gram")
    )
    discard(shared)
    first = F.min(F.struct("doc", "row", "span")).alias("first")
    contexts = stored(
        found.groupBy("gram", "context")
        .agg(first)
        .select("gram", "context", "first.doc", "first.row", "first.span")
    )
    repeated = stored(
        found.join(contexts.select("gram", "context", F.col("doc").alias("earliest")), ["gram", "context"])
        .withColumn("_over", F.col("doc") > F.col("earliest"))
        .select(
            "doc",
            "row",
            "span",
            F.when(~F.col("_over"), F.col("gram")).alias("gram"),
            F.when(~F.col("_over"), F.col("context")).alias("context"),
        )
    )
    discard(found)
    grams = stored(contexts.groupBy("gram").count().where("count > 1"))
    edges = contexts.join(grams, "gram")
    pieces = stored(
        _context_bytes(source, edges, threshold).join(
            F.broadcast(
                # a gram of so many contexts is rare: at most one per TASK_CONTEXTS contexts
                grams.where(F.col("count") > TASK_CONTEXTS).select("gram", F.lit(True).alias("_many"))
            ),
            "gram",
            "left",
        )
    )
    discard(contexts)
    few = pieces.where("_many is null")
    sorted_few = few.repartition("gram").sortWithinPartitions("gram")
    covered = _compared_in_tasks(sorted_few, threshold)
    many = pieces.where("_many")
    if not many.isEmpty():
        covered = covered.unionByName(_compared_by_shuffle(many, threshold))
    covered = stored(covered)
    discard(pieces)
    whole = repeated.where("gram is null").select(
        "doc",
        "row",
        F.shiftright("span", 8).alias("low"),
        (F.shiftright("span", 8) + F.col("span") % 256 + threshold).alias("high"),
    )
    partly = (
        repeated.where("gram is not null")
        .join(covered, ["gram", "context"])
        .select(
            "doc",
            "row",
            (F.shiftright("span", 8) + F.col("first")).alias("low"),
            (F.shiftright("span", 8) + F.col("last") + threshold).alias("high"),
        )
    )
    return whole.unionByName(partly)


def remove_repeats(
    docs: DataFrame,
    threshold: int = 50,
    identifier: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] = (),
    whole_characters: bool = False,
) -> DataFrame:
    """One row per document: the identifier, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept``.

    Columns named in ``carry`` come along.

    A byte goes if a string of ``threshold`` bytes that covers it also begins in a
    document with a smaller identifier. ``n_spans`` counts maximal runs of removed bytes,
    ``kept`` holds the other bytes. Matches lie within texts and are judged on the input.
    With ``whole_characters`` a character goes if any of its bytes does, so that ``kept`` is
    text.

    A null text is an empty one. Rows that share an identifier do not count against each
    other; rows without one come after all others. An empty table gives no rows; other
    columns are not read.
    """
    carried = [F.col(name).alias(f"_carried{i}") for i, name in enumerate(carry)]
    number = F.col(identifier).cast("bigint")
    source = docs.select(
        F.col(identifier).alias("_id"),
        F.coalesce(number, F.lit(LAST)).alias("doc"),
        F.lit(0).cast("bigint").alias("row"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        *carried,
    )
    if not source.groupBy("doc").count().where("count > 1").isEmpty():
        # a number of its own for every row, fixed by writing it down
        source = stored(source.withColumn("row", F.monotonically_increasing_id()))
    spans = covered_spans(source, threshold)
    # as many spans as a document has anchors, at most
    lists = spans.groupBy("doc", "row").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch.column(1)):
                lists = batch.column(2).slice(part.first, len(part))
                counts = np.diff(part.offsets)
                change = np.zeros(len(part.data) + 1, dtype=np.int32)
                found = lists.flatten()
                owner = pc.list_parent_indices(lists).to_numpy()
                low = part.offsets[owner] + found.field(0).to_numpy()
                high = part.offsets[owner] + found.field(1).to_numpy()
                np.add.at(change, low, 1)
                np.add.at(change, high, -1)
                gone = np.cumsum(change[:-1]) > 0
                if whole_characters and len(gone):
                    leads = (part.data & 0xC0) != 0x80
                    leads[part.offsets[:-1][counts > 0]] = True
                    first = np.flatnonzero(leads)
                    gone = np.repeat(
                        np.logical_or.reduceat(gone, first), np.diff(np.append(first, len(gone)))
                    )
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                starts = part.offsets[:-1][counts > 0]
                opens[starts] = gone[starts]
                totals = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, opens)]
                removed, runs = (t[part.offsets[1:]] - t[part.offsets[:-1]] for t in totals)
                kept_offsets = np.concatenate([[0], np.cumsum(counts - removed)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(part)),
                        pa.array(counts, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(runs, pa.int64()),
                        binaries(part.data[~gone], kept_offsets),
                        *(column.slice(part.first, len(part)) for column in batch.columns[3:]),
                    ],
                    names=names,
                )

    long, fields = T.LongType(), [T.StructField(identifier, source.schema["_id"].dataType)]
    fields += [T.StructField(name, long) for name in ("n_bytes", "n_removed", "n_spans")]
    fields.append(T.StructField("kept", T.BinaryType()))
    fields += [T.StructField(name, source.schema[f"_carried{i}"].dataType) for i, name in enumerate(carry)]
    names = [field.name for field in fields]
    return (
        source.join(lists, ["doc", "row"], "left")
        .select("_id", "text", "spans", *(f"_carried{i}" for i in range(len(carry))))
        .mapInArrow(cut, T.StructType(fields))
    )
