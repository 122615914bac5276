"""Exact positions in a global order without sending all rows to one task."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import materialise

#: Keys that a selection may bring to the driver.
SELECT_ROWS = 100_000
#: Keys sampled for splitters, and how many of those one pass counts by.
SAMPLE_ROWS = 1000
SPLITTERS = 31

def prefix_sums(
    df: DataFrame,
    order: list[Column],
    weights: dict[str, Column],
    by: list[str] | None = None,
    keep: Callable[[DataFrame], DataFrame] = materialise,
) -> DataFrame:
    """Add, for every name in ``weights``, the total of that column over the rows before.

    Before means earlier in ``order``, among the rows with the same ``by`` columns (none of
    them null). Rows that tie in the order come one after the other in some fixed order.

    A sort by range deals the rows out to tasks, as many as their bytes ask for, and
    ``keep`` writes the sorted table down, which fixes each row's task and its place there.
    Every task sums its own rows; the totals of the tasks before, one row per task and
    group, are added. So no task holds more than its range, whatever the groups' sizes.
    """
    by = by or []
    fixed = keep(
        df.orderBy(*[F.col(name) for name in by], *order).withColumn(
            "_at", F.monotonically_increasing_id()
        )
    )
    numbered = fixed.withColumn("_task", F.shiftright("_at", 33))
    within = (
        Window.partitionBy("_task", *by)
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    totals = numbered.groupBy("_task", *by).agg(
        *[F.sum(weight).alias(f"_of_{name}") for name, weight in weights.items()]
    )
    offsets = totals.select(
        "_task",
        *by,
        *[F.coalesce(F.sum(f"_of_{name}").over(earlier), zero).alias(f"_of_{name}") for name in weights],
    )
    sums = {
        name: F.coalesce(F.sum(weight).over(within), zero) + F.col(f"_of_{name}")
        for name, weight in weights.items()
    }
    return (
        numbered.join(offsets, ["_task", *by])
        .withColumns(sums)
        .drop("_task", "_at", *[f"_of_{name}" for name in weights])
    )


def nth_key(keys: DataFrame, n: int, select_rows: int = SELECT_ROWS):
    """The n-th smallest ``key`` and how many are smaller; None if there are fewer than n.

    ``keys`` has that one column, without nulls. While n is large, a sample of the keys
    still in question gives some splitters; one pass counts the keys below and up to each,
    and only the range between two of them goes on. A splitter that is itself the n-th key
    ends the search, however many rows share it. What reaches the driver are at most
    ``select_rows`` keys.
    """
    key, before = F.col("key"), 0
    while n - before > select_rows:
        wanted = n - before
        rows = keys.count()
        if rows < wanted:
            return None
        some = keys.sample(min(1.0, 2 * SAMPLE_ROWS / rows)).limit(4 * SAMPLE_ROWS)
        sample = [row.key for row in (some.orderBy("key").collect() or keys.take(1))]
        splitters = sample[:: math.ceil(len(sample) / SPLITTERS)]
        counts = keys.agg(
            *[F.count_if(key < F.lit(s)).alias(f"l{i}") for i, s in enumerate(splitters)],
            *[F.count_if(key <= F.lit(s)).alias(f"u{i}") for i, s in enumerate(splitters)],
        ).first()
        above, below = None, None
        for i, splitter in enumerate(splitters):
            smaller, upto = counts[f"l{i}"], counts[f"u{i}"]
            if smaller < wanted <= upto:
                return splitter, before + smaller
            if upto < wanted:
                above, passed = splitter, upto
            elif below is None:
                below = splitter
        if below is not None:
            keys = keys.where(key < F.lit(below))
        if above is not None:
            keys, before = keys.where(key > F.lit(above)), before + passed
    found = [row.key for row in keys.orderBy("key").limit(n - before).collect()]
    if len(found) < n - before:
        return None
    last = found[-1]
    ties = sum(1 for key in found if key == last or (key != key and last != last))
    return last, n - ties


def first_rows(df: DataFrame, n: int, key: str = "id", select_rows: int = SELECT_ROWS) -> DataFrame:
    """The ``n`` rows with the smallest ``key``, missing keys last.

    For any ``n`` and any key that can be ordered and compared. The n-th key is selected
    (see ``nth_key``), the rows up to it stay where they are; nothing is sorted as a whole. Of
    rows that share the n-th key, as many as are wanted come in the order of a hash of
    all their columns. ``df`` is read more than once.
    """
    name = F.col(f"`{key}`")
    present = df.where(name.isNotNull())
    found = nth_key(present.select(name.alias("key")), n, select_rows)
    if found is None:
        wanted, before, tied = n - present.count(), present, df.where(name.isNull())
    else:
        cut, smaller = found
        wanted, before, tied = n - smaller, df.where(name < F.lit(cut)), df.where(name == F.lit(cut))
    if wanted <= 0:
        return before
    hashed = F.xxhash64(*_hashable(df))
    if wanted <= select_rows:
        return before.unionByName(tied.orderBy(hashed).limit(wanted))
    within = nth_key(tied.select(hashed.alias("key")), wanted, select_rows)
    if within is None:
        return before.unionByName(tied)
    # rows of equal hash are as good as equal
    cut, smaller = within
    rest = tied.where(hashed == F.lit(cut)).limit(wanted - smaller)
    return before.unionByName(tied.where(hashed < F.lit(cut))).unionByName(rest)


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``_place``, its position in a global order from 0, ties as they come.

    A sort by range deals the rows out to tasks; each counts its rows, and the counts of
    the tasks before give the rest.
    """
    # fixed by writing it down: the task of a row, and its order there
    fixed = materialise(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    numbered = fixed.withColumn("_task", F.shiftright("_place", 33)).withColumn(
        "_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    )
    # one row per task of the sort
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = numbered.groupBy("_task").count().select(
        "_task", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        numbered.join(F.broadcast(before), "_task")
        .withColumn("_place", F.col("_place") + F.col("_before"))
        .drop("_task", "_before")
    )


def _hashable(df: DataFrame) -> list[Column]:
    """All columns in a form that has a hash; maps and variants as text."""
    return [
        F.col(f"`{field.name}`")
        if not isinstance(field.dataType, (T.MapType, T.VariantType))
        else F.to_json(F.col(f"`{field.name}`"))
        for field in df.schema.fields
    ]
