"""Exact nearest neighbours of short vectors, by regions of the corpus and their boxes.

The corpus is cut at medians of a sample into regions of some ten thousand rows, one table
row each, that know the box of their vectors. A query is searched in the region nearest to it,
which gives its limit, and then in the others whose boxes are within that limit: a few, however
many regions there are. Both searches are the same step. Within a region a tree of boxes rules
out all but some dozens of small leaves, see ``boxes.py``. So the work grows with the rows
times the logarithm of the corpus.

A task streams the queries of a region; a region that many queries visit is dealt out to
several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.boxes import apart, farthest, halved, searchable
from plumbline.functions.nearest import CHUNK_VALUES, unit_matrix, unit_rows
from plumbline.operators.blocks import MATCHES, PLACED, packed
from plumbline.session import materialise

#: Rows of a region, about, regions at most, and rows of the sample for each.
REGION_ROWS = 1 << 15
MAX_REGIONS = 4096
SAMPLED = 64
#: Queries of a region that one task is asked to take.
ASKED_ROWS = 1 << 16
#: With more regions a query than this, on average, boxes rule too little out.
MOST_VISITS = 32

_ASKED = "id bigint, embedding array<float>, floor double, block bigint"
_BOXES = "block bigint, low array<double>, high array<double>"
_FOUND = (
    "id bigint, embedding array<float>, found array<bigint>, similarities array<double>, "
    "visits array<bigint>"
)


def by_regions(
    queries: DataFrame, corpus: DataFrame, k: int, rows: int, region_rows: int = REGION_ROWS
) -> DataFrame | None:
    """``MATCHES`` of ``queries`` among ``corpus`` (both ``id, embedding``), some beyond rank k.

    None if queries would have to visit more than ``MOST_VISITS`` regions on average.
    """
    spark = queries.sparkSession
    cuts = spark.sparkContext.broadcast(_cuts(corpus, rows, region_rows))
    placed = materialise(corpus.mapInArrow(_placed(cuts), PLACED))
    regions = materialise(packed(placed, region_rows))
    # at most a few rows for each region
    boxes = regions.select("block", "vectors", "rows").mapInArrow(_boxes, _BOXES).toArrow()
    if not len(boxes):
        return spark.createDataFrame([], MATCHES)
    numbers = boxes["block"].to_numpy()
    sides = [np.array(boxes[side].to_pylist()) for side in ("low", "high")]
    known = spark.sparkContext.broadcast((numbers, *sides))
    asked = materialise(queries.mapInArrow(_nearest_region(known), _ASKED))
    first = materialise(_searched(asked, regions, k, known))
    visits = F.explode("visits").alias("block")
    floor = F.coalesce(F.get("similarities", F.lit(k - 1)), F.lit(-2.0)).alias("floor")
    asked = first.select("id", "embedding", floor, visits)
    n_asked, n_visits = first.select(F.count(F.lit(1)), F.sum(F.size("visits"))).first()
    if (n_visits or 0) > MOST_VISITS * n_asked:
        return None
    more = _searched(asked, regions, k, None)
    matches = F.arrays_zip("found", "similarities")
    return (
        first.select("id", "found", "similarities")
        .unionByName(more.select("id", "found", "similarities"))
        .select(F.col("id").alias("query_id"), F.posexplode(matches).alias("rank", "match"))
        .select(
            "query_id",
            (F.col("rank") + 1).alias("rank"),
            F.col("match.found").alias("corpus_id"),
            F.col("match.similarities").alias("similarity"),
        )
    )


def _cuts(corpus: DataFrame, rows: int, region_rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By level, the dimension and value at which each part is cut in two, from a sample."""
    depth = max(0, math.ceil(math.log2(max(1, min(MAX_REGIONS, rows / region_rows)))))
    if not depth:
        return []
    share = F.lit(max(1, rows // (SAMPLED << depth)))
    sample = corpus.where(F.pmod(F.xxhash64("id", "embedding"), share) == 0)
    units = unit_rows(sample.select("embedding").toArrow()["embedding"])
    parts, cuts = [np.arange(len(units))], []
    for _ in range(depth):
        dimensions, values, halves = [], [], []
        for part in parts:
            dimension = units[part].var(axis=0).argmax() if len(part) else 0
            pair = halved(units, part, 1) if len(part) > 1 else [part, part[:0]]
            dimensions.append(dimension)
            values.append(units[pair[1], dimension].min() if len(pair[1]) else 0.0)
            halves += pair
        cuts.append((np.array(dimensions), np.array(values)))
        parts = halves
    return cuts


def _placed(cuts):
    """Corpus rows with the number of their part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = unit_rows(batch["embedding"])
            part, every = np.zeros(len(units), dtype=np.int64), np.arange(len(units))
            for dimension, value in cuts.value:
                part = 2 * part + (units[every, dimension[part]] >= value[part])
            yield pa.record_batch(
                {
                    "id": batch["id"],
                    "embedding": batch["embedding"],
                    "cell": pa.array(part, pa.int32()),
                    "angle": pa.array(np.zeros(len(units))),
                }
            )

    return run


def _vectors(raw: bytes, rows: int) -> np.ndarray:
    return unit_matrix(np.frombuffer(raw, "<f4").astype(np.float64).reshape(rows, -1))


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            units = _vectors(row["vectors"], row["rows"])
            sides = [pa.array([side.tolist()]) for side in (units.min(axis=0), units.max(axis=0))]
            yield pa.record_batch([pa.array([row["block"]]), *sides], names=["block", "low", "high"])


def _gaps(units: np.ndarray, known) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances of queries from all regions, a slice of the queries at a time."""
    _, low, high = known.value
    step = max(1, CHUNK_VALUES // low.size)
    for start in range(0, len(units), step):
        part = slice(start, start + step)
        yield part, apart(units[part, None], low, high)


def _nearest_region(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nearest = [gaps.argmin(axis=1) for _, gaps in _gaps(unit_rows(batch["embedding"]), known)]
            yield pa.record_batch(
                {
                    "id": batch["id"],
                    "embedding": batch["embedding"],
                    "floor": pa.nulls(batch.num_rows, pa.float64()),
                    "block": pa.array(known.value[0][np.concatenate(nearest)]),
                }
            )

    return run


def _searched(asked: DataFrame, regions: DataFrame, k: int, known) -> DataFrame:
    """``_FOUND`` of queries (``_ASKED``) in their regions; with ``known``, what to visit next."""
    spark = asked.sparkSession
    # at most one row for each region
    counts = asked.groupBy("block").count().toArrow()
    shares = np.ceil(counts["count"].to_numpy() / ASKED_ROWS).astype(np.int64)
    places = pa.table(
        {"block": counts["block"], "_start": pa.array(np.cumsum(shares) - shares), "_shares": pa.array(shares)}
    )
    places = F.broadcast(spark.createDataFrame(places))
    share = F.pmod(F.xxhash64("id"), F.col("_shares"))
    nothing = {name: F.lit(None).cast("binary") for name in ("ids", "vectors")}
    asking = asked.join(places, "block").select(
        (F.col("_start") + share).alias("place"), "block", "id", "embedding", "floor", *_named(nothing)
    )
    searched = regions.join(places, "block").select(
        F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_shares") - 1)).alias("place"),
        "block",
        F.lit(None).cast("bigint").alias("id"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.lit(None).cast("double").alias("floor"),
        "ids",
        "vectors",
    )
    tasks = int(max(1, min(shares.sum(), 4 * spark.sparkContext.defaultParallelism)))
    return (
        searched.unionByName(asking)
        .repartitionById(tasks, F.pmod(F.col("place"), F.lit(tasks)).cast("int"))
        # a region comes before the queries that visit it
        .sortWithinPartitions("place", F.col("id").isNotNull())
        .mapInArrow(_search(k, known), _FOUND)
    )


def _named(columns: dict) -> list:
    return [column.alias(name) for name, column in columns.items()]


def _search(k: int, known):
    def found_of(batch: pa.RecordBatch, region) -> pa.RecordBatch:
        units, floor = unit_rows(batch["embedding"]), None
        if known is None:
            floor = batch["floor"].to_numpy()
        rows, similarities, found, _ = region.search(units, k, floor)
        ends = pa.array(np.searchsorted(rows, np.arange(len(units) + 1)), pa.int32())
        return pa.record_batch(
            {
                "id": batch["id"],
                "embedding": batch["embedding"] if known else pa.nulls(len(units), pa.list_(pa.float32())),
                "found": pa.ListArray.from_arrays(ends, pa.array(found, pa.int64())),
                "similarities": pa.ListArray.from_arrays(ends, pa.array(similarities, pa.float64())),
                "visits": _visits(units, rows, similarities, batch["block"][0].as_py())
                if known
                else pa.nulls(len(units), pa.list_(pa.int64())),
            }
        )

    def _visits(units, rows, similarities, here: int) -> pa.Array:
        """The other regions that may hold something better."""
        limit = np.full(len(units), -2.0)
        full = np.searchsorted(rows, np.arange(len(units)), side="right") - 1
        counts = np.bincount(rows, minlength=len(units))
        limit[counts == k] = similarities[full[counts == k]]
        numbers, parts = known.value[0], []
        for part, gaps in _gaps(units, known):
            near = gaps <= farthest(limit[part])[:, None]
            near[:, numbers == here] = False
            row, place = np.nonzero(near)
            parts.append((np.bincount(row, minlength=len(near)), numbers[place]))
        counts, visits = (np.concatenate(part) for part in zip(*parts))
        ends = np.concatenate([[0], np.cumsum(counts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(visits, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region = None
        for batch in batches:
            is_region = ~batch["id"].is_valid().to_numpy(zero_copy_only=False)
            places = batch["place"].to_numpy()
            # the batch cut where a region comes, or queries after one
            starts = np.flatnonzero(np.concatenate([[True], is_region[1:] | (places[1:] != places[:-1]) | is_region[:-1]]))
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                part = batch.slice(start, end - start)
                if is_region[start]:
                    ids = np.frombuffer(part["ids"][0].as_py(), "<i8")
                    region = searchable(_vectors(part["vectors"][0].as_py(), len(ids)), ids)
                else:
                    yield found_of(part, region)

    return run
