"""The stored index against a search from scratch."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_retrieval import SCHEMA, _brute, _clustered, _frame, _rows

from plumbline.operators import blocks, vector_index
from plumbline.session import checkpoint_folder
from plumbline.sources import batches


@pytest.fixture
def folder(spark):
    return f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"


def test_appended_rows_are_found(spark, folder):
    corpus, queries = _clustered(1, 150), _clustered(2, 40)
    vector_index.create_index(_frame(spark, corpus[:60]), folder, block_values=8 * 16, pivots=9)
    assert _rows(vector_index.search_index(_frame(spark, queries), folder)) == _brute(queries, corpus[:60], 3)
    vector_index.append_to_index(_frame(spark, corpus[60:100], 60), folder)
    vector_index.append_to_index(_frame(spark, corpus[100:], 100), folder)
    for k in (1, 4):
        assert _rows(vector_index.search_index(_frame(spark, queries), folder, k)) == _brute(queries, corpus, k)


def test_an_append_that_fails_does_not_count(spark, folder):
    corpus = _clustered(3, 40)
    vector_index.create_index(_frame(spark, corpus), folder, block_values=8 * 16)
    broken = _frame(spark, corpus, 40).withColumn(
        "embedding", F.when(F.col("id") < 79, F.col("embedding")).otherwise(F.array(F.lit(1.0).cast("float")))
    )
    with pytest.raises(Exception):
        vector_index.append_to_index(broken, folder)
    # a batch that was written but not put down as committed
    placed = batches.read_batches(spark, folder, blocks.BLOCKS).drop("batch")
    placed.write.partitionBy("cell").parquet(f"{folder}/rows/batch=halfway")
    assert _rows(vector_index.search_index(_frame(spark, corpus), folder)) == _brute(corpus, corpus, 3)


def test_search_reads_only_visited_cells(spark, folder, monkeypatch, plan):
    chance = np.random.default_rng(0)
    middle = chance.normal(size=(12, 8)) * 5
    corpus = middle[np.arange(480) % 12] + chance.normal(size=(480, 8)) * 0.05
    vector_index.create_index(_frame(spark, corpus), folder, block_values=8 * 10)
    read = []
    one = blocks._round

    def noting(opened, of_cells, known, k, quota, codes=False):
        def noted(cells):
            found = of_cells(cells)
            assert "PartitionFilters: [isnotnull(cell" in plan(found) or "PartitionFilters: [cell" in plan(found)
            read.append((set(cells), {row.cell for row in found.select("cell").distinct().collect()}))
            return found

        return one(opened, noted, known, k, quota)

    monkeypatch.setattr(blocks, "_round", noting)
    queries = corpus[:3] + 0.01
    assert _rows(vector_index.search_index(_frame(spark, queries), folder)) == _brute(queries, corpus, 3)
    asked = set().union(*(a for a, _ in read))
    assert all(a == b for a, b in read) and len(asked) <= 24  # of some 48 cells


def test_empty_index_and_no_queries(spark, folder):
    with pytest.raises(ValueError):
        vector_index.create_index(spark.createDataFrame([], SCHEMA), folder)
    vector_index.create_index(_frame(spark, [[1.0, 0.0]]), folder)
    assert vector_index.search_index(spark.createDataFrame([], SCHEMA), folder).collect() == []
    assert _rows(vector_index.search_index(_frame(spark, [[0.0, 0.0]]), folder)) == [(0, 1, 0, 0.0)]


def test_two_writers_of_one_table(spark, folder):
    one, two = (spark.range(5).select((F.col("id") + 10 * i).alias("x")) for i in (1, 2))
    first = batches.append_batch(one, folder)
    second = batches.append_batch(two, folder)
    assert batches.batches(spark, folder) == sorted([first, second])
    rows = batches.read_batches(spark, folder, "x bigint").collect()
    assert {(r.x, r.batch) for r in rows} == {(10 + i, first) for i in range(5)} | {(20 + i, second) for i in range(5)}
    assert batches.read_batches(spark, folder + "-none", "x bigint").columns == ["x", "batch"]
