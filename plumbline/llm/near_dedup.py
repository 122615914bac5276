"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification.

Texts with equal shingle sets are one class from the start. Classes that share a band
are candidates; links between them are confirmed on whole sets, in two steps that never
write out the pairs of a large group:

1. In every bucket of a band, all members are compared with one of them. The links found
   join most of each group of near copies.
2. What is left are buckets whose members belong to several components. Those of a
   dozen members or less give their pairs from different components to the same
   confirmation. Of larger ones, tasks take the sets in blocks of a bounded number and
   compare members of different components by one matrix product over the shingles they
   share; they return links that join components, not pairs.

After both, any two candidates are in one component or are known not to be linked. Two
linked sets share none of the bands with a probability of at most
``(1 - 0.8 ** ROWS) ** BANDS``, 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import attach, discard, stored, texts_of
from plumbline.llm.components import components
from plumbline.llm.minhash import BANDS, ROWS, band_hashes, set_keys, shingle_sets, signatures
from plumbline.llm.texts import parts

#: Members of a bucket that one block holds; a task compares at most two blocks.
BLOCK = 1000
#: Buckets of at most so many members name their few pairs instead.
SMALL = 12


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _keys(shingles: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in set_keys(shingles, offsets)], pa.binary())


def signed(docs: DataFrame, identifier: str, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """``identifier, n_shingles, key, bands`` of every document; no bands without shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch.column(1)):
                sets, offsets = shingle_sets(part, shingle)
                hashes = band_hashes(signatures(sets, offsets, bands * rows), bands, rows)
                filled = np.diff(offsets) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(part)),
                        pa.array(np.diff(offsets), pa.int64()),
                        _keys(sets, offsets),
                        _lists(hashes[filled].reshape(-1), np.append(0, np.cumsum(filled * bands))),
                    ],
                    names=[identifier, "n_shingles", "key", "bands"],
                )

    source = texts_of(docs, identifier, text)
    kind = source.schema[identifier].dataType.simpleString()
    return source.mapInArrow(
        sign, f"`{identifier}` {kind}, n_shingles bigint, key binary, bands array<bigint>"
    )


def _sets(docs: DataFrame, needed: DataFrame, identifier: str, text: str, shingle: int) -> DataFrame:
    """``node, n, members`` of the needed classes (``first_id, key, node``).

    A class's text is found again by its first identifier, and by its key where rows
    repeat an identifier.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch.column(0)):
                sets, offsets = shingle_sets(part, shingle)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(part.first, len(part)),
                        batch.column(2).slice(part.first, len(part)),
                        _keys(sets, offsets),
                        _lists(sets.view(np.int64), offsets),
                    ],
                    names=["node", "key", "found", "members"],
                )

    texts = texts_of(docs, identifier, text).withColumnRenamed(identifier, "first_id")
    found = (
        texts.join(needed, "first_id")
        .select(text, "node", "key")
        .mapInArrow(collect, "node bigint, key binary, found binary, members array<bigint>")
    )
    return (
        found.where("key = found")
        .dropDuplicates(["node"])
        .select("node", F.size("members").alias("n"), "members")
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets are similar enough."""
    both = pairs.join(sets.toDF("a", "n_a", "set_a"), "a").join(sets.toDF("b", "n_b", "set_b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def _new_links(nodes, labels, sides, sets, percent: int, same_block: bool) -> list[tuple[int, int]]:
    """Links that join components, among the members of two blocks (or of one)."""
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    members = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), np.diff(offsets))
    sizes = np.diff(offsets)
    # only members that two sets share can be in an intersection
    _, place, counts = np.unique(members, return_inverse=True, return_counts=True)
    common = counts[place] >= 2
    reach = np.bincount(owner[common], minlength=len(sets))
    able = 100 * reach >= percent * sizes
    use = common & able[owner]
    columns, column = np.unique(place[use], return_inverse=True)
    row_of = np.cumsum(able) - 1
    rows = np.flatnonzero(able)
    if len(rows) < 2:
        return []
    shared = np.zeros((len(rows), len(rows)), dtype=np.float32)
    step = max(1, 4_000_000 // len(rows))
    order = np.argsort(column, kind="stable")
    bounds = np.searchsorted(column[order], np.arange(0, len(columns) + step, step))
    for low, high, base in zip(bounds[:-1], bounds[1:], range(0, len(columns), step)):
        some = order[low:high]
        present = np.zeros((len(rows), step), dtype=np.float32)
        present[row_of[owner[use][some]], column[some] - base] = 1
        shared += present @ present.T
    sizes, label, side = sizes[rows], labels[rows], sides[rows]
    union = sizes[:, None] + sizes[None, :] - shared
    linked = (100 * shared >= percent * union) & (label[:, None] != label[None, :])
    if not same_block:
        linked &= side[:, None] != side[None, :]
    found, parent = [], {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        a, b = root(label[i]), root(label[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append((nodes[rows[i]], nodes[rows[j]]))
    return found


def _more_links(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between different components in buckets that still hold several."""
    labelled = stored(
        members.join(labels, "node", "left").select(
            "bucket", "node", "n", F.coalesce("label", "node").alias("label")
        )
    )
    mixed = stored(
        labelled.groupBy("bucket")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
        .where("low <> high")
        .select("bucket", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    few = labelled.join(mixed.where(F.col("size") <= SMALL).select("bucket"), "bucket")
    near_size = 100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")
    pairs = (
        few.withColumnRenamed("node", "a")
        .join(few.toDF("bucket", "b", "n_b", "label_b"), "bucket")
        .where((F.col("a") < F.col("b")) & (F.col("label") != F.col("label_b")) & near_size)
        .select("a", "b")
        .distinct()
    )
    many = mixed.where(F.col("size") > SMALL).drop("size")
    in_blocks = _linked_in_blocks(labelled.drop("n"), many, sets, percent)
    return _confirmed(pairs, sets, percent).unionByName(in_blocks)


def _linked_in_blocks(labelled: DataFrame, mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of the larger buckets, found in blocks."""
    block = F.pmod(F.hash("node"), F.col("blocks"))
    # a member meets every block of its bucket once: (lower block, higher block)
    met = F.expr("sequence(0, blocks - 1)")
    dealt = (
        labelled.join(mixed, "bucket")
        .withColumn("side", block)
        .withColumn("other", F.explode(met))
        .withColumn("low", F.least("side", "other"))
        .withColumn("high", F.greatest("side", "other"))
        .join(sets.select("node", F.col("members")), "node")
        .select("bucket", "low", "high", "node", "label", "side", "members")
    )

    def compare(group: pa.Table) -> pa.Table:
        columns = group.combine_chunks()
        sets_here = [np.array(m.values) for m in columns["members"]]
        numbers = [columns[name].to_numpy() for name in ("node", "label", "side")]
        same = columns["low"][0].as_py() == columns["high"][0].as_py()
        links = _new_links(*numbers, sets_here, percent, same)
        return pa.table(
            {
                "a": pa.array([a for a, _ in links], pa.int64()),
                "b": pa.array([b for _, b in links], pa.int64()),
            }
        )

    return dealt.groupBy("bucket", "low", "high").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    identifier: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: the identifier, ``n_shingles``, ``component_id``, ``kept``.

    Words are runs of characters other than blank and tab to carriage return, after A-Z
    became lower case. A document's set holds its distinct runs of ``shingle`` words; with
    fewer words all of them are one shingle. Documents are linked if 100 times the
    intersection is at least ``percent`` times the union. ``component_id`` is the smallest
    identifier that can be reached; the document that has it is kept.

    A null, empty or blank text has an empty set, is linked with nothing and kept. Rows
    that repeat an identifier and its text are kept together. A row without an identifier
    has the component of those with its very set and is not kept; if none of them has an
    identifier it is linked with nothing, has no component and is kept. An empty table
    gives no rows; other columns are not read.
    """
    documents = stored(signed(docs, identifier, text, shingle, bands, rows))
    classes = stored(
        documents.where("n_shingles > 0")
        .groupBy("key")
        .agg(
            F.min(identifier).alias("first_id"),
            F.count(F.lit(1)).alias("size"),
            F.max("n_shingles").alias("n"),
            F.any_value("bands").alias("bands"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    in_bands = classes.where("first_id is not null").select(
        "node", "n", F.explode("bands").alias("bucket")
    )
    shared = stored(
        in_bands.groupBy("bucket")
        .agg(F.min(F.struct("node", "n")).alias("centre"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
        .select("bucket", F.col("centre.node").alias("centre"), F.col("centre.n").alias("centre_n"))
    )
    members = stored(in_bands.join(shared, "bucket"))
    discard(shared)
    needed = classes.join(members.select("node").distinct(), "node", "left_semi")
    sets = stored(_sets(docs, needed.select("first_id", "key", "node"), identifier, text, shingle))
    near_size = 100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")
    stars = (
        members.where("node <> centre")
        .where(near_size)
        .select(F.col("node").alias("a"), F.col("centre").alias("b"))
        .distinct()
    )
    links = stored(_confirmed(stars, sets, percent))
    labels = components(links)
    more = stored(_more_links(members, sets, labels, percent))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    named = stored(
        classes.select("node", "key", "size", "first_id")
        .join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    for table in (members, sets, links, more, labels, classes):
        discard(table)
    heads = stored(
        named.groupBy("label").agg(
            F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("classes")
        )
    )
    placed = stored(attach(named.select("key", "size", "label"), heads, "label", "classes"))
    discard(named)
    discard(heads)
    found = attach(
        documents.where("n_shingles > 0").select(identifier, "n_shingles", "key"),
        placed.select("key", "size", "component_id"),
        "key",
        "size",
    ).select(identifier, "n_shingles", "component_id")
    alone = documents.where("n_shingles = 0").select(
        identifier, "n_shingles", F.col(identifier).alias("component_id")
    )
    return found.unionByName(alone).withColumn(
        "kept", F.col(identifier).eqNullSafe(F.col("component_id"))
    )
