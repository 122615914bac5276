"""Shards of near equal bytes that keep equal texts together.

Groups of equal texts are put in an order, and the order is cut into contiguous shards:
the smallest capacity for which cutting as late as possible needs no more than the wanted
shards is found by binary search.

The ends of the groups stay in Spark. The driver knows a bounded summary of them, the
first and the last end in each of some equal cells of the line, and works out the search
with both, which gives bounds of every position it needs. Cells in which a position is
still open are cut finer by one more pass over the ends, until none is open. So the cuts
are those of all single ends, though the driver never has more than ``CELLS`` of them
from a pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, prepare, stored
from plumbline.operators.ordering import prefix_sums

#: Cells that one pass over the ends may return to the driver.
CELLS = 1 << 16
#: Bytes a document counts besides its text.
OVERHEAD = 8


class _Ends:
    """What is known of the sorted ends: per cell the first and the last, and their rows."""

    def __init__(self, cells: np.ndarray):
        # columns: first end, last end, rows up to the first, rows up to the last
        self.cells = cells[np.argsort(cells[:, 0])]

    def last_up_to(self, limit: int, high: bool) -> int:
        """The last end up to ``limit``, from below or from above; 0 if there is none."""
        cell = int(np.searchsorted(self.cells[:, 0], limit, side="right")) - 1
        if cell < 0:
            return 0
        first, last = (int(x) for x in self.cells[cell, :2])
        if last <= limit:
            return last
        return min(limit, last) if high else first

    def first_from(self, limit: int, high: bool) -> int:
        """The first end from ``limit`` on, from below or from above; else the last one."""
        if limit <= 0:
            return 0
        cell = int(np.searchsorted(self.cells[:, 1], limit, side="left"))
        if cell == len(self.cells):
            return int(self.cells[-1, 1])
        first, last = (int(x) for x in self.cells[cell, :2])
        if first >= limit:
            return first
        return last if high else max(limit, first)

    def rows_up_to(self, end: int) -> int:
        if end == 0:
            return 0
        cell = int(np.searchsorted(self.cells[:, 0], end, side="right")) - 1
        return int(self.cells[cell, 2 if end == self.cells[cell, 0] else 3])

    def open_between(self, low: int, high: int) -> np.ndarray:
        """Numbers of the cells from ``low`` to ``high`` whose inside is not known."""
        inside = (self.cells[:, 0] <= high) & (self.cells[:, 1] >= low)
        return np.flatnonzero(inside & (self.cells[:, 1] - self.cells[:, 0] > 1))


def _reach(ends: _Ends, capacity: int, shards: int, high: bool) -> list[int]:
    """Where the shards end when each takes all it can, bounded from one side."""
    at = [0]
    for _ in range(shards):
        at.append(ends.last_up_to(at[-1] + capacity, high))
    return at[1:]


def _least_capacity(ends: _Ends, total: int, shards: int, high: bool) -> int:
    """The smallest capacity with which the shards reach the total."""
    low, top = -(-total // shards) - 1, total
    while top - low > 1:
        middle = (low + top) // 2
        if _reach(ends, middle, shards, high)[-1] >= total:
            top = middle
        else:
            low = middle
    return top


def _even_cuts(ends: _Ends, capacity: int, total: int, shards: int, high: bool) -> list[int]:
    """Cuts within the capacity, each near an even share of what is left.

    A shard ends at the last end within that share, but takes a group at least, does not
    end before the place from which the shards after it can still take the rest, and does
    not go beyond the capacity.
    """
    least = [total]
    for _ in range(shards - 1):
        least.append(ends.first_from(least[-1] - capacity, high))
    least.reverse()
    cuts = [0]
    for shard in range(shards):
        share = -(-(total - cuts[-1]) // (shards - shard))
        wanted = max(
            least[shard],
            ends.last_up_to(cuts[-1] + share, high),
            ends.first_from(cuts[-1] + 1, high),
        )
        cuts.append(min(wanted, ends.last_up_to(cuts[-1] + capacity, high)))
    return cuts[1:]


def _by_bucket(
    ranges: list[tuple[int, int]], width: int
) -> tuple[int, int, list[tuple[int, int, int, int]]]:
    """The ranges as rows to join with, however many there are.

    ``(base, bits, rows)``: an end lies in bucket ``(end - base) >> bits``. A row has a
    bucket, a range that meets it, and the number of the range's first cell. Buckets are
    at most as many as the ranges, so there are less than two rows for each range.
    """
    base, top = min(low for low, _ in ranges), max(high for _, high in ranges)
    bits = ((top - base) // len(ranges)).bit_length()
    rows, first = [], 0
    for low, high in ranges:
        for bucket in range((low - base) >> bits, ((high - base) >> bits) + 1):
            rows.append((bucket, low, high, first))
        first += (high - low) // width + 1
    return base, bits, rows


def _cells_of(ends: DataFrame, ranges: list[tuple[int, int]], cells: int) -> np.ndarray:
    """One pass: the first and last end in each of ``cells`` equal parts of the ranges."""
    length = sum(high - low + 1 for low, high in ranges)
    width = max(1, -(-length // max(1, cells - len(ranges))))
    base, bits, known = _by_bucket(ranges, width)
    names = ["_bucket", "_low", "_high", "_cell"]
    columns = [pa.array(column, pa.int64()) for column in zip(*known)]
    wanted = F.broadcast(ends.sparkSession.createDataFrame(pa.table(columns, names)))
    found = (
        ends.withColumn("_bucket", F.shiftright(F.col("end") - F.lit(base), bits))
        .join(wanted, "_bucket")
        .where(F.col("end").between(F.col("_low"), F.col("_high")))
        .withColumn("cell", F.col("_cell") + F.floor((F.col("end") - F.col("_low")) / F.lit(width)))
        .groupBy("cell")
        .agg(F.min("end"), F.max("end"), F.min("rows"), F.max("rows"))
        .drop("cell")
        .toArrow()
    )
    return np.stack([column.to_numpy() for column in found.columns], axis=1).astype(np.int64)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    joined: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if joined and low <= joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], max(high, joined[-1][1]))
        else:
            joined.append((low, high))
    return joined


def minimax_cuts(
    ends: DataFrame, total: int, shards: int, cells: int = CELLS
) -> tuple[int, list[int], list[int]]:
    """The least capacity, the shards' ends, and the rows up to each of them.

    ``ends`` has ``end, rows``: running totals of the ordered groups' bytes and rows, one
    row per group, all ends different, the last one ``total``. It is read once for every
    refinement: about log(total) / log(cells / shards ** 2) times.
    """
    known = _Ends(_cells_of(ends, [(1, total)], cells))
    while True:
        # more is reached with ends taken from above, so that capacity is a lower bound
        low = _least_capacity(known, total, shards, high=True)
        top = _least_capacity(known, total, shards, high=False)
        searched = [
            (a, b)
            for a, b in zip(
                [0, *_reach(known, low, shards, high=False)][:-1],
                [0, *_reach(known, top, shards, high=True)][:-1],
            )
        ]
        spans = [(a + low, b + top) for a, b in searched]
        if low == top:
            below = _even_cuts(known, low, total, shards, high=False)
            above = _even_cuts(known, low, total, shards, high=True)
            if below == above:
                return low, below, [known.rows_up_to(cut) for cut in below]
            spans = _even_spans(known, low, total, shards)
        opened = np.unique(np.concatenate([known.open_between(*span) for span in spans]))
        ranges = [(int(a) + 1, int(b) - 1) for a, b in known.cells[opened, :2]]
        # the two ends of an opened cell stay known beside what is found between them
        halves = known.cells[opened]
        firsts, lasts = halves[:, [0, 0, 2, 2]], halves[:, [1, 1, 3, 3]]
        found = _cells_of(ends, _merged(ranges), cells)
        rest = np.delete(known.cells, opened, axis=0)
        known = _Ends(np.concatenate([rest, firsts, lasts, found]))


def _even_spans(ends: _Ends, capacity: int, total: int, shards: int) -> list[tuple[int, int]]:
    """Where ``_even_cuts`` looks for ends, from its lower to its upper bounds."""
    lower = _LoggedEnds(ends)
    _even_cuts(lower, capacity, total, shards, high=False)
    upper = _LoggedEnds(ends)
    _even_cuts(upper, capacity, total, shards, high=True)
    return [(min(a, b), max(a, b)) for a, b in zip(lower.asked, upper.asked)]


class _LoggedEnds:
    """Ends that note at which limits they are asked."""

    def __init__(self, ends: _Ends):
        self._ends = ends
        self.asked: list[int] = []

    def last_up_to(self, limit: int, high: bool) -> int:
        self.asked.append(limit)
        return self._ends.last_up_to(limit, high)

    def first_from(self, limit: int, high: bool) -> int:
        self.asked.append(limit)
        return self._ends.first_from(limit, high)


def in_shards(
    docs: DataFrame,
    shards: int,
    identifier: str = "doc_id",
    text: str = "text",
    overhead: int = OVERHEAD,
    cells: int = CELLS,
) -> DataFrame:
    """``(identifier, size, text_crc32, shard, slot)``, a row for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus ``overhead`` (at least 1). Rows with equal texts
    share a shard. Groups are ordered by the SHA-256 of their text, rows within a group by
    identifier; ``slot`` is the row's place within its shard, from 0 without gaps. The
    fullest shard is as small as any contiguous cut of that order allows, and the others
    are as even as that leaves them; where one group is larger than an even share, its
    shard is that large. With fewer groups than shards some shards stay empty.

    A missing text counts as an empty one, a missing identifier is a value of its own, and
    repeated rows each get a slot. Other columns are left out, whatever they are called.
    No row gives no row. Texts are named by their SHA-256. A text of any length that Spark can hold
    is one row of fixed size from the first step on. A group that makes up a third of all
    rows is sorted by several tasks, since identifiers part its rows.
    """
    if shards < 1 or overhead < 1:
        raise ValueError("shards and overhead must be at least 1")
    spark = prepare(docs.sparkSession)
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    sized = stored(
        docs.select(
            F.col(f"`{identifier}`").alias("_id"),
            (F.octet_length(content) + F.lit(overhead)).cast("bigint").alias("_size"),
            F.crc32(content.cast("binary")).alias("_crc32"),
            F.unhex(F.sha2(content, 256)).alias("_digest"),
        )
    )
    placed = stored(
        prefix_sums(
            sized,
            [F.col("_digest"), F.col("_id")],
            {"_bytes": F.col("_size"), "_row": F.lit(1).cast("bigint")},
            keep=stored,
        )
    )
    discard(sized)
    ends = stored(
        placed.groupBy("_digest")
        .agg(
            F.max(F.col("_bytes") + F.col("_size")).alias("end"),
            F.max(F.col("_row") + 1).alias("rows"),
        )
        .drop("_digest")
    )
    total = ends.agg(F.max("end")).first()[0]
    before = [0] * shards
    if total is not None:
        _, _, rows = minimax_cuts(ends, total, shards, cells)
        before = [0, *rows[:-1]]
    starts = F.array(*[F.lit(start).cast("bigint") for start in before])
    # empty shards start where the next one does: the last start up to the row counts
    shard = F.size(F.filter(starts, lambda start: start <= F.col("_row"))) - 1
    return placed.withColumn("_shard", shard).select(
        F.col("_id").alias(identifier),
        F.col("_size").alias("size"),
        F.col("_crc32").alias("text_crc32"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_row") - F.get(starts, F.col("_shard"))).alias("slot"),
    )
