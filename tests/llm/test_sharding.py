import bisect
import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from compare import connect, differences
from conftest import FOLDER
from pyspark.sql import functions as F

from plumbline.llm import sharding
from plumbline.llm.queries import QUERIES, SHARDS, SQL


def least_capacity(sizes, shards):
    """The least capacity of a contiguous cut, by trying every sum of neighbours."""
    n = len(sizes)
    before = [0]
    for size in sizes:
        before.append(before[-1] + size)
    best = [0] + [float("inf")] * n
    for _ in range(shards):
        best = [0] + [
            min(max(best[j], before[i] - before[j]) for j in range(i + 1)) for i in range(1, n + 1)
        ]
    return best[n]


def check(rows, texts, shards):
    """``texts``: (identifier, text) of every row."""
    digest = lambda text: hashlib.sha256((text or "").encode()).digest()
    left = defaultdict(list)
    for i, text in texts:
        left[i].append(text or "")
    of_digest, filled, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for row in rows:
        text = next(
            t for t in left[row.doc_id]
            if (len(t.encode()) + 8, zlib.crc32(t.encode())) == (row.size, row.text_crc32)
        )
        left[row.doc_id].remove(text)
        of_digest[digest(text)].add(row.shard)
        filled[row.shard] += row.size
        slots[row.shard].append(row.slot)
    assert not any(left.values())
    assert all(len(found) == 1 for found in of_digest.values())
    for shard, found in slots.items():
        assert 0 <= shard < shards and sorted(found) == list(range(len(found)))
    sizes = defaultdict(int)
    for _, text in texts:
        sizes[digest(text)] += len((text or "").encode()) + 8
    if sizes:
        assert max(filled.values()) == least_capacity([sizes[d] for d in sorted(sizes)], shards)
    return filled


def test_query_equals_sql(spark):
    found = QUERIES["op12_sharding"](spark, FOLDER)
    assert differences(found, connect(FOLDER), SQL["op12_sharding"]) == []


def test_query_has_least_fullest_shard(spark, documents):
    filled = check(QUERIES["op12_sharding"](spark, FOLDER).collect(), documents.items(), SHARDS)
    assert len(filled) == SHARDS


@pytest.mark.parametrize("shards", [1, 2, 5, 40])
def test_odd_texts(spark, odd, shards):
    texts = [(row.doc_id, row.text) for row in odd.collect()]
    check(sharding.in_shards(odd, shards).collect(), texts, shards)


def test_no_rows_and_wrong_counts(spark, no_docs):
    assert sharding.in_shards(no_docs, 3).collect() == []
    with pytest.raises(ValueError):
        sharding.in_shards(no_docs, 0)


def test_missing_identifiers_and_repeated_rows(spark):
    texts = [(None, "a"), (None, "a"), (1, "b"), (1, "b"), (1, "c"), (2, None), (2, "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    check(sharding.in_shards(docs, 2).collect(), texts, 2)


@pytest.mark.parametrize("seed", range(4))
def test_refined_cells_find_the_same_cuts(spark, seed):
    chance = random.Random(seed)
    sizes = [chance.choice([1, 2, 3, 50, 7, 900 if seed % 2 else 9]) for _ in range(400)]
    at, rows = 0, []
    for number, size in enumerate(sizes):
        at += size
        rows.append((at, 2 * number + 2))
    ends = spark.createDataFrame(rows, "end bigint, rows bigint").repartition(3).cache()
    shards = 5
    coarse = sharding.minimax_cuts(ends, at, shards, cells=24)
    fine = sharding.minimax_cuts(ends, at, shards, cells=1 << 16)
    assert coarse == fine
    capacity, cuts, upto = fine
    assert capacity == least_capacity(sizes, shards)
    assert cuts[-1] == at and all(dict(rows).get(c, 0) == r for c, r in zip(cuts, upto))
    assert max(b - a for a, b in zip([0, *cuts], cuts)) <= capacity


def reached(ends, capacity, shards):
    """Where the shards end when each takes all of the sorted ends that it can."""
    at = 0
    for _ in range(shards):
        place = bisect.bisect_right(ends, at + capacity)
        at = ends[place - 1] if place else 0
    return at


def test_many_open_ranges(spark):
    chance = random.Random(7)
    sizes = [chance.randint(1, 5000) for _ in range(60_000)]
    ends = list(itertools.accumulate(sizes))
    rows = [(end, number + 1) for number, end in enumerate(ends)]
    table = spark.createDataFrame(rows, "end bigint, rows bigint").repartition(3).cache()
    # some thousand cells of many ends each are open after the first pass
    capacity, cuts, upto = sharding.minimax_cuts(table, ends[-1], 60, cells=8192)
    assert reached(ends, capacity, 60) == ends[-1] > reached(ends, capacity - 1, 60)
    assert max(b - a for a, b in zip([0, *cuts], cuts)) <= capacity
    assert cuts[-1] == ends[-1] and [ends[row - 1] for row in upto] == cuts
    assert (capacity, cuts, upto) == sharding.minimax_cuts(table, ends[-1], 60, cells=1 << 20)
    table.unpersist()


@pytest.mark.parametrize("count", [1, 2, 900])
def test_cells_of_ranges(spark, count):
    chance = random.Random(count)
    # far apart and side by side, some of one end only
    borders = sorted(chance.sample(range(1, 1 << 40), count) + chance.sample(range(1, 5000), count))
    ranges = list(zip(borders[::2], borders[1::2]))
    ends = {end for low, high in ranges for end in (low - 1, low, (low + high) // 2, high, high + 1)}
    ends = sorted(ends - {0})
    table = spark.createDataFrame(
        [(end, number + 1) for number, end in enumerate(ends)], "end bigint, rows bigint"
    )
    cells = 2000
    width = -(-sum(high - low + 1 for low, high in ranges) // (cells - count))
    expected = defaultdict(list)
    for number, end in enumerate(ends):
        for at, (low, high) in enumerate(ranges):
            if low <= end <= high:
                expected[at, (end - low) // width].append((end, number + 1))
    found = sharding._cells_of(table, ranges, cells)
    assert sorted(map(tuple, found.tolist())) == sorted(
        (inside[0][0], inside[-1][0], inside[0][1], inside[-1][1]) for inside in expected.values()
    )


def test_one_group_with_a_third_of_all_rows(spark):
    rows = [(i, "the same words" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    filled = check(sharding.in_shards(docs, 8).collect(), rows, 8)
    # the others are even though one group is larger than a share
    others = sorted(filled.values())[:-1]
    assert len(others) == 7 and others[-1] < 1.2 * others[0]


def test_long_text(spark):
    docs = spark.range(3).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789abcdef"), 1 << 20).alias("text")
    )
    rows = sharding.in_shards(docs, 2).collect()
    assert {row.size for row in rows} == {(16 << 20) + 8} and len({row.shard for row in rows}) == 1
