"""Exact cosine nearest neighbours of every query row, and context from them.

The search is exact for any sizes. What changes with them is where the rows go:

* a corpus below a checked size goes to every executor, queries stay in place; short vectors
  are searched there in a tree of boxes, see ``boxes.py``;
* else short vectors are searched by regions of the corpus, see ``regions.py``, unless the
  pairs are few;
* else queries below that size go to every executor, the corpus stays in place,
  and each task hands on its k best per query;
* else both sides are packed into blocks around pivot vectors, and blocks of queries
  visit blocks of the corpus from the nearest outwards, see ``blocks.py``. The layout
  "codes", on demand, moves 8-bit codes first and floats only for what these leave open.

No path pairs up single rows: blocks meet by an equi-key and only matches leave them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.fixed_values import CONTEXT_SEPARATOR, TOP_K
from plumbline.functions.boxes import BOX_LENGTH, searchable
from plumbline.functions.nearest import best_matches, keep_best, unit_rows
from plumbline.functions.text import clean
from plumbline.operators import blocks
from plumbline.operators.lookup import HOT_ROWS, HOT_SHARE, lookup
from plumbline.operators.regions import by_regions
from plumbline.session import materialise, written

# Vector values (rows x length) one side may have to be sent to every executor.
BROADCAST_VALUES = 8_000_000
# Vector values of the first corpus piece that gives the few-queries path a floor.
SAMPLE_VALUES = 1_000_000
# How much larger the next piece is.
SAMPLE_GROWTH = 16
# Bytes of corpus text that may go along.
BROADCAST_BYTES = 64 * 1024 * 1024
# Vector values in one block of the block path, and rows, at most: a block is what the
# search can rule out, so short vectors do not make it larger.
BLOCK_VALUES = 4_000_000
BLOCK_ROWS = 1024
# Pairs of queries and corpus rows up to which short vectors need no regions.
FEW_PAIRS = 10**10

# Where the rows go: the corpus or the queries to every executor, or both in blocks, of
# floats or of 8-bit codes, or to regions of the corpus.
LAYOUTS = ("corpus", "queries", "blocks", "codes", "regions")

_MATCHES = blocks.MATCHES


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    layout: str | None = None,
    broadcast_values: int = BROADCAST_VALUES,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """``(query_id, rank, corpus_id, similarity)``: the k nearest corpus rows per query.

    Both inputs have an integral ``id`` and an ``embedding`` array, taken as floats;
    rows without either take no part. Query ids must not repeat. A missing, infinite
    or NaN element fails the job and names its row. Similarity is rounded to six
    digits, then ties go to the smaller id. A query equal to a corpus row finds that
    row. A corpus of fewer than k rows gives all of them. All of this holds for every
    layout; the sizes choose one of ``LAYOUTS`` unless it is given. The inputs are read
    more than once, some of it before this returns; pass stored vectors, not a model yet
    to be run.
    """
    queries, corpus = vectors_of(queries, "query"), vectors_of(corpus, "corpus")
    return _search_layout(unique_ids(queries), corpus, k, layout, broadcast_values, block_values)


def _search_layout(queries, corpus, k, layout, broadcast_values, block_values) -> DataFrame:
    if layout is not None and layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {', '.join(LAYOUTS)}")
    n_corpus, length = size_of(corpus)
    if layout is None:
        if n_corpus * length <= broadcast_values:
            layout = "corpus"
        else:
            n_queries = queries.count()
            if length <= BOX_LENGTH and n_queries * n_corpus > FEW_PAIRS:
                layout = "regions"
            else:
                layout = "queries" if n_queries * length <= broadcast_values else "blocks"
    if layout == "corpus":
        return _against_small_corpus(queries, corpus, k)
    if layout == "queries":
        return _for_few_queries(queries, corpus, k, n_corpus, max(k, SAMPLE_VALUES // length))
    rows_per_block = max(k, min(BLOCK_ROWS, block_values // length))
    corpus = _without_surplus_copies(corpus, k)
    if layout == "regions":
        found = by_regions(queries, corpus, k, n_corpus)
        if found is not None:
            return _top(found, k)
    arguments = (queries.sparkSession, queries, corpus, k, n_corpus, length, rows_per_block)
    if layout == "codes":
        return _top(blocks.by_codes(*arguments), k)
    return blocks.one_search(*arguments)


def with_context(
    df: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    text: str = "sentence",
    separator: str = CONTEXT_SEPARATOR,
    layout: str | None = None,
    broadcast_values: int = BROADCAST_VALUES,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_values: int = BLOCK_VALUES,
    embedding: str = "embedding",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``context``: texts of the corpus rows nearest to ``embedding``, in rank order.

    Null where a row has no embedding, empty where the corpus has no row. The rules for
    vectors and corpus ids are those of ``knn_join``; the rows of ``df`` need no id and
    may repeat one. With a corpus whose vectors and texts are both of checked size, the
    context is worked out inside each row's task: no shuffle, no join. Otherwise every
    distinct vector is searched once by ``knn_join``'s layouts, and rows meet their
    context by their vector. A vector or corpus row that very many rows share is dealt
    out to several tasks.
    """
    # read several times below, and may be the result of a join that moves whole texts
    known = written(vectors_of(corpus, "corpus", clean(F.col(text)).alias("_text")))
    asking = df.withColumn("_vector", _checked(F.col(embedding), F.lit("of the table")))
    if layout in (None, "corpus"):
        rows, length = size_of(known)
        fits = rows * length <= broadcast_values
        if layout == "corpus" or (
            fits and (known.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) <= broadcast_bytes
        ):
            found = _context_from_shared(known, k, separator)(F.col("_vector"))
            return asking.withColumn("context", found).drop("_vector")
    # the one pass over the rows before the last: their vectors, and which are hot
    distinct = materialise(
        asking.where(F.col("_vector").isNotNull())
        .groupBy(F.col("_vector").alias("embedding"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    if layout is None and fits:
        layout = "corpus"  # the vectors may be sent about, though not the texts
    asked = _spread(distinct.select("id", "embedding"))
    matches = materialise(
        _search_layout(asked, known.drop("_text"), k, layout, broadcast_values, block_values)
    )
    keyed, asking = _keyed(distinct, asking, hot_rows)
    texts = known.select(F.col("id").alias("corpus_id"), "_text")
    found = lookup(matches.join(keyed, "query_id"), texts, "corpus_id", "query_id", "inner", hot_rows)
    # grouped by what the rows are joined by, so that a context stays in its task
    contexts = context_of(found, "_text", separator, ("_share", "_key"))
    nothing = F.when(F.col("_vector").isNotNull(), "")
    return (
        asking.join(contexts, ["_share", "_key"], "left")
        .withColumn("context", F.coalesce("context", nothing))
        .select(*df.columns, "context")
    )


def _spread(asked: DataFrame) -> DataFrame:
    """A checkpointed table in as many parts as there are cores at least.

    Spark merges parts by their bytes, and a megabyte of short vectors is much to search for.
    """
    tasks = asked.sparkSession.sparkContext.defaultParallelism
    return asked.repartition(tasks) if asked.rdd.getNumPartitions() < tasks else asked


def _vector_key(vector: Column) -> Column:
    """32 bytes that name a vector of floats, the zeros being equal; null for none."""
    values = F.transform(vector, lambda x: x + F.lit(0.0).cast("float"))
    return F.unhex(F.sha2(values.cast("string"), 256))


def _keyed(distinct: DataFrame, asking: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """``query_id, _share, _key`` of the distinct vectors, and the rows with ``_share, _key``.

    The key is a digest of the vector: Spark rewrites joins by floats, and would shuffle again.
    The rows of a vector that more than ``hot_rows`` (and ``HOT_SHARE`` of all rows) have are
    dealt out to several parts, and rows without a vector spread.
    """
    total = distinct.agg(F.sum("_rows")).first()[0] or 0
    per_part = max(hot_rows, int(total * HOT_SHARE))
    parts = F.ceil(F.col("_rows") / F.lit(per_part)).cast("int")
    asking = asking.withColumn("_key", _vector_key(F.col("_vector")))
    key = _vector_key(F.col("embedding")).alias("_key")
    keyed = distinct.select(
        F.col("id").alias("query_id"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1)).alias("_share"),
        key,
    )
    number = F.monotonically_increasing_id()
    # at most 1 / HOT_SHARE vectors
    hot = distinct.where(F.col("_rows") > per_part).select(key, parts.alias("_parts"))
    found = hot.collect() if total > hot_rows else []
    part = F.lit(0)
    if found:
        asking = asking.withColumn("_number", number)
        dealt = F.broadcast(asking.sparkSession.createDataFrame(found, hot.schema))
        asking = asking.join(dealt, "_key", "left")
        part, number = F.pmod(F.xxhash64("_number"), F.coalesce("_parts", F.lit(1))), F.col("_number")
    spread = F.when(F.col("_vector").isNull(), number).otherwise(part).cast("bigint")
    return keyed, asking.withColumn("_share", spread).drop("_number", "_parts")


def retrieve_context(
    queries: DataFrame, corpus: DataFrame, k: int = TOP_K, text: str = "sentence", **search
) -> DataFrame:
    """``(query_id, context)`` of the queries that have an embedding."""
    return (
        with_context(queries.select("id", "embedding"), corpus, k, text, **search)
        .where(F.col("context").isNotNull())
        .select(F.col("id").alias("query_id"), "context")
    )


def _context_from_shared(known: DataFrame, k: int, separator: str):
    """A function of the embedding column that has the corpus at hand."""
    table = known.orderBy("id").toArrow()
    # positions stand for the ids they are ordered by
    units = searchable(unit_rows(table["embedding"]), np.arange(len(table)))
    content = (units, table["_text"].to_pylist())
    shared = known.sparkSession.sparkContext.broadcast(content)

    def contexts(column: pa.Array) -> pa.Array:
        units, texts = shared.value
        asked = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        found: list[str | None] = [None] * len(column)
        for row in asked:
            found[row] = ""
        if len(asked) and len(texts):
            rows, _, positions, _ = units.search(unit_rows(column.drop_null()), k)
            cuts = np.searchsorted(rows, np.arange(1, len(asked)))
            for row, best in zip(asked, np.split(positions, cuts)):
                found[row] = separator.join(texts[position] for position in best)
        return pa.array(found, pa.string())

    @F.arrow_udf(T.StringType())
    def lookup(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield contexts(column)

    return lookup


def context_of(
    matches: DataFrame,
    text: str,
    separator: str = CONTEXT_SEPARATOR,
    query: tuple[str, ...] = ("query_id",),
) -> DataFrame:
    """Join the texts of a query's matches, at most k of them, in rank order."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("text"))))
    return matches.groupBy(*query).agg(
        F.array_join(F.transform(ranked, lambda m: m["text"]), separator, "").alias("context")
    )


def _checked(embedding: Column, name: Column) -> Column:
    """The vector as floats; the job fails on an element that is no finite number."""
    floats = embedding.cast("array<float>")
    finite = F.forall(
        floats, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.when(finite, floats).when(
        floats.isNotNull(),
        F.raise_error(F.concat(F.lit("vector "), name, F.lit(" has an element that is no finite number"))),
    )


def vectors_of(df: DataFrame, side: str, *more: Column) -> DataFrame:
    """``id, embedding`` of the rows that have both, checked; ``side`` is for messages."""
    kind = df.schema["id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"{side} ids must be integers, not {kind.simpleString()}")
    name = F.concat(F.lit(f"of {side} row "), F.col("id").cast("string"))
    return df.where(F.col("embedding").isNotNull() & F.col("id").isNotNull()).select(
        F.col("id").cast("bigint").alias("id"),
        _checked(F.col("embedding"), name).alias("embedding"),
        *more,
    )


def unique_ids(queries: DataFrame) -> DataFrame:
    """``queries``; fails if an id occurs more than once."""
    repeated = queries.groupBy("id").count().where(F.col("count") > 1).take(1)
    if repeated:
        raise ValueError(f"query id {repeated[0]['id']} occurs more than once")
    return queries


def size_of(df: DataFrame) -> tuple[int, int]:
    """Rows, those without a vector included, and the length of a vector.

    Neither needs the vectors read: the count comes from file footers where
    ``df`` is a plain scan, and the length from the first row that has one.
    """
    first = df.where(F.col("embedding").isNotNull()).select(F.size("embedding")).first()
    return df.count(), max(1, first[0]) if first else 1


def _block(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return table["id"].to_numpy(), unit_rows(table["embedding"])


def _match_batch(query_ids, similarities, corpus_ids, ranks) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "query_id": pa.array(query_ids, pa.int64()),
            "rank": pa.array(ranks, pa.int32()),
            "corpus_id": pa.array(corpus_ids, pa.int64()),
            "similarity": pa.array(similarities, pa.float64()),
        }
    )


def _against_small_corpus(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Corpus of checked size on every executor; one pass, no shuffle."""
    context = queries.sparkSession.sparkContext
    ids, units = _block(corpus.toArrow())
    shared = context.broadcast((searchable(units, ids), len(ids)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = shared.value
        if rows == 0:
            return
        for batch in batches:
            if batch.num_rows:
                rows, similarities, found, ranks = known.search(unit_rows(batch["embedding"]), k)
                yield _match_batch(
                    batch["id"].to_numpy()[rows], similarities, found, ranks
                )

    return queries.mapInArrow(search, _MATCHES)


def _for_few_queries(
    queries: DataFrame, corpus: DataFrame, k: int, n_corpus: int, sample_rows: int
) -> DataFrame:
    """Queries of checked size on every executor; the corpus stays in place.

    Samples of the corpus by a hash of the id, each ``SAMPLE_GROWTH`` times the one before,
    are searched first while they are a small part of it: the k-th similarity in one is a
    floor under the final one, and what does not reach it goes no further. Tasks are as
    many as the cluster has cores, times two, and merge the k best of all they read; so
    the shuffle gets a number of candidates per query that does not grow with the corpus.
    """
    context = queries.sparkSession.sparkContext
    ids, units = _block(queries.orderBy("id").toArrow())
    floor = np.full(len(ids), -np.inf)
    while sample_rows * SAMPLE_GROWTH <= n_corpus:
        share = F.lit(math.ceil(n_corpus / sample_rows))
        sampled = corpus.where(F.pmod(F.xxhash64("id"), share) == 0)
        best = _top(_candidates(sampled, context.broadcast((ids, units, floor)), k), k)
        reached = best.where(F.col("rank") == k).select("query_id", "similarity").toArrow()
        places = np.searchsorted(ids, reached["query_id"].to_numpy())
        floor = floor.copy()
        floor[places] = np.maximum(floor[places], reached["similarity"].to_numpy())
        sample_rows *= SAMPLE_GROWTH
    return _top(_candidates(corpus, context.broadcast((ids, units, floor)), k), k)


def _candidates(corpus: DataFrame, shared, k: int) -> DataFrame:
    """The k best rows per query of everything that a task reads, above the query's floor."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, units, floor = shared.value
        limit, best = floor.copy(), None
        for batch in batches:
            if not batch.num_rows or not len(query_ids):
                continue
            ids, block = _block(batch)
            rows, similarities, found, _ = best_matches(units, block, ids, k, limit)
            if best is not None:
                rows = np.concatenate([best[0], rows])
                similarities = np.concatenate([best[1], similarities])
                found = np.concatenate([best[2], found])
            best = keep_best(rows, similarities, found, k)
            # what the task has found raises its own floor
            full = best[3] == k
            limit[best[0][full]] = np.maximum(limit[best[0][full]], best[1][full])
        if best is not None:
            yield _match_batch(query_ids[best[0]], best[1], best[2], best[3])

    tasks = 2 * corpus.sparkSession.sparkContext.defaultParallelism
    return corpus.coalesce(tasks).mapInArrow(search, _MATCHES)


def _top(matches: DataFrame, k: int) -> DataFrame:
    """The k best of several partial results per query; pruned before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "corpus_id")
    return (
        matches.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "corpus_id", "similarity")
    )


def _without_surplus_copies(corpus: DataFrame, k: int) -> DataFrame:
    """Of equal vectors keep the k smallest ids; no other can be among k matches.

    Each map task hands on at most k rows per vector, so a vector that makes up a
    third of the corpus is a handful of rows at the shuffle. The hash leads the
    key to make the sort cheap; the vector itself decides.
    """
    copies = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("id")
    return (
        corpus.withColumn("_copy", F.row_number().over(copies))
        .where(F.col("_copy") <= k)
        .drop("_copy")
    )
