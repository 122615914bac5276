"""A stored index for exact nearest neighbours: fitted once, appended to, asked often.

The pivots are chosen when the index is made. Its rows are packed blocks (see
``blocks.py``), parted by cell, so that a search reads the folders of the cells that its
queries visit and, of the others, nothing. Appended rows go to the cells of the same
pivots, as a batch of blocks of their own; a batch that fails to be written does not
count (see ``batches.py``). However the corpus grows, the search stays exact: pivots only
steer it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.fixed_values import TOP_K
from plumbline.functions.nearest import unit_rows
from plumbline.operators import blocks
from plumbline.operators.retrieval import BLOCK_VALUES, size_of, unique_ids, vectors_of
from plumbline.session import materialise
from plumbline.sources.batches import append_batch, read_batches


def create_index(
    corpus: DataFrame, folder: str, block_values: int = BLOCK_VALUES, pivots: int | None = None
) -> None:
    """Make an index of ``corpus`` (``id, embedding``) in a new folder.

    ``pivots`` is the number of cells, by default one for each block of ``block_values``
    vector values, ``MAX_PIVOTS`` at most. Choose more for a corpus that is going to grow.
    """
    spark = corpus.sparkSession
    corpus = vectors_of(corpus, "corpus")
    rows, length = size_of(corpus)
    per_block = max(1, block_values // length)
    chosen = blocks.choose_pivots(corpus, rows if pivots is None else pivots * per_block, length, per_block)
    if not len(chosen):
        raise ValueError("an index needs at least one vector to choose pivots from")
    table = spark.createDataFrame(
        [(cell, [float(x) for x in vector]) for cell, vector in enumerate(chosen)],
        "cell int, embedding array<double>",
    )
    table.coalesce(1).write.parquet(f"{folder}/pivots")
    spark.createDataFrame([(per_block,)], "rows_per_block int").coalesce(1).write.parquet(f"{folder}/settings")
    append_to_index(corpus, folder)


def _opened(spark: SparkSession, folder: str) -> tuple[np.ndarray, int]:
    pivots = spark.read.parquet(f"{folder}/pivots").orderBy("cell").toArrow()
    return unit_rows(pivots["embedding"]), spark.read.parquet(f"{folder}/settings").first()[0]


def append_to_index(corpus: DataFrame, folder: str) -> None:
    """Add rows to an index. Ids should not be in it yet; a repeated one is found twice."""
    spark = corpus.sparkSession
    pivots, per_block = _opened(spark, folder)
    placed = materialise(blocks.in_cells(vectors_of(corpus, "corpus"), spark.sparkContext.broadcast(pivots)))
    append_batch(blocks.packed(placed, per_block), folder, by=("cell",))


def search_index(queries: DataFrame, folder: str, k: int = TOP_K) -> DataFrame:
    """The rows of ``knn_join(queries, corpus)``, the corpus being what the index holds.

    Reads the blocks' ranges, a few numbers each, and the cells that queries visit.
    """
    spark = queries.sparkSession
    pivots, per_block = _opened(spark, folder)
    stored = read_batches(spark, folder, blocks.BLOCKS)
    queries = unique_ids(vectors_of(queries, "query"))

    def of_cells(cells: list[int]) -> DataFrame:
        # at most one number per pivot; a filter on the folders' names
        return stored.where(F.col("cell").isin(cells)).drop("batch")

    return blocks.search(queries, of_cells, blocks.cells_of(stored, pivots), k, per_block)
