"""Nearest neighbours by every path against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import boxes as X
from plumbline.functions.vectors import dot, l2_normalize
from plumbline.operators import blocks as B
from plumbline.operators import regions as G
from plumbline.operators import retrieval as R
from plumbline.session import materialise
from plumbline.operators.retrieval import context_of, knn_join, retrieve_context, with_context

SCHEMA = "id long, embedding array<float>"


def _frame(spark, matrix, first_id=0):
    rows = [(first_id + i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def _brute(queries, corpus, k, first_query=0):
    def unit(m):
        m = np.asarray(m, dtype=np.float32).astype(np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm == 0, 1, norm)

    similar = np.round(unit(queries) @ unit(corpus).T, 6) + 0.0
    rows = []
    for q, line in enumerate(similar):
        best = sorted(range(len(line)), key=lambda c: (-line[c], c))[:k]
        rows += [(first_query + q, rank, c, line[c]) for rank, c in enumerate(best, 1)]
    return rows


def _rows(df):
    return sorted(
        (r.query_id, r["rank"], r.corpus_id, r.similarity) for r in df.collect()
    )


def _clustered(seed, n, length=8, centres=6):
    chance = np.random.default_rng(seed)
    middle = chance.normal(size=(centres, length)) * 5
    data = middle[chance.integers(centres, size=n)] + chance.normal(size=(n, length)) * 0.3
    data[: n // 3] = data[0]  # a third of all rows are copies
    data[-1] = 0
    return data


PATHS = {
    "small corpus": {},
    "blocks": {"broadcast_values": 0, "block_values": 8 * 16},
    "blocks of k rows": {"broadcast_values": 0, "block_values": 8},
    "one block": {"broadcast_values": 0},
}


@pytest.mark.parametrize(
    "path, k",
    [("small corpus", 1), ("small corpus", 3), ("blocks", 3), ("blocks of k rows", 1),
     ("one block", 3)],
)
def test_paths_equal_brute_force(spark, path, k):
    corpus, queries = _clustered(1, 120), _clustered(2, 50)
    found = knn_join(_frame(spark, queries, 1000), _frame(spark, corpus), k, **PATHS[path])
    assert _rows(found) == _brute(queries, corpus, k, 1000)


@pytest.mark.parametrize("k, values", [(3, 8 * 16), (1, 8), (3, 8000)])
def test_codes_equal_brute_force(spark, k, values):
    corpus, queries = _clustered(1, 120), _clustered(2, 50)
    corpus[40:44] = corpus[40] + 1e-7  # closer than codes can tell
    found = knn_join(_frame(spark, queries, 1000), _frame(spark, corpus), k, layout="codes", block_values=values)
    assert _rows(found) == _brute(queries, corpus, k, 1000)


def test_codes_are_a_quarter_and_their_errors_hold():
    chance = np.random.default_rng(5)
    units = B.unit_matrix(np.vstack([chance.normal(size=(300, 64)), np.zeros((2, 64)), np.eye(64)[:3]]))
    raw = B.coded(units)
    assert len(raw) <= 0.29 * 4 * units.size
    stand_ins, error = B.decoded(raw, len(units))
    asked = B.unit_matrix(chance.normal(size=(200, 64)))
    assert (np.abs(asked @ stand_ins.T - asked @ units.T) <= error).all()
    assert error.max() < 0.02


def test_few_floats_are_fetched_after_codes(spark):
    chance = np.random.default_rng(8)
    data = chance.normal(size=(400, 32))
    frame = _frame(spark, data)
    pairs = B.one_search(spark, frame, frame, 3, 400, 32, 50, codes=True)
    assert 3 * 400 <= pairs.count() < 8 * 400


def test_few_queries_path(spark):
    corpus, queries = _clustered(3, 200), _clustered(4, 20)
    found = knn_join(
        _frame(spark, queries), _frame(spark, corpus), 3, broadcast_values=20 * 8
    )
    assert _rows(found) == _brute(queries, corpus, 3)


@pytest.mark.parametrize("sample", [4, 8, 40])
def test_floors_from_growing_samples(spark, monkeypatch, sample):
    monkeypatch.setattr(R, "SAMPLE_VALUES", sample * 8)
    monkeypatch.setattr(R, "SAMPLE_GROWTH", 3)
    corpus, queries = _clustered(3, 300), _clustered(4, 20)
    found = knn_join(_frame(spark, queries), _frame(spark, corpus), 3, layout="queries")
    assert _rows(found) == _brute(queries, corpus, 3)


def test_candidates_do_not_grow_with_the_corpus(spark):
    chance = np.random.default_rng(2)
    queries = chance.normal(size=(5, 4))
    cores = spark.sparkContext.defaultParallelism
    shared = spark.sparkContext.broadcast((np.arange(5), R.blocks.unit_matrix(queries), np.full(5, -np.inf)))
    counts = []
    for rows in (2_000, 20_000):
        corpus = spark.range(rows, numPartitions=rows // 100).select(
            "id", F.array(*[F.randn(i).cast("float") for i in range(4)]).alias("embedding")
        )
        counts.append(R._candidates(corpus, shared, 3).count())
    assert max(counts) <= 2 * cores * 5 * 3


def test_unclustered_vectors_by_blocks(spark):
    chance = np.random.default_rng(7)
    corpus, queries = chance.normal(size=(150, 8)), chance.normal(size=(60, 8))
    found = knn_join(_frame(spark, queries), _frame(spark, corpus), 3, **PATHS["blocks"])
    assert _rows(found) == _brute(queries, corpus, 3)


@pytest.mark.parametrize("path", ["small corpus", "blocks"])
def test_corpus_smaller_than_k(spark, path):
    corpus, queries = [[1.0] * 8, [0.0] * 8], [[2.0] * 8, [-1.0] * 8, [0.0] * 8]
    found = knn_join(_frame(spark, queries), _frame(spark, corpus), 3, **PATHS[path])
    assert _rows(found) == _brute(queries, corpus, 3)


def _visit_counts(monkeypatch):
    """Cells that blocks of queries visit, counted round by round."""
    rounds = []
    one = B._round

    def counting(opened, blocks, known, k, quota, codes=False):
        visits = opened.select("block", "cell", "nearest", "farthest", "done", "bound").mapInArrow(
            B._next_visits(known, quota), B._VISITS
        ).where("dealt = 0")
        rounds.append((opened.count(), visits.count()))
        return one(opened, blocks, known, k, quota)

    monkeypatch.setattr(B, "_round", counting)
    return rounds


def test_most_cells_are_not_visited_in_clustered_data(spark, monkeypatch):
    rounds = _visit_counts(monkeypatch)
    chance = np.random.default_rng(0)
    middle = chance.normal(size=(12, 8)) * 5
    data = middle[chance.integers(12, size=600)] + chance.normal(size=(600, 8)) * 0.1
    frame = _frame(spark, data)
    found = knn_join(frame, frame, 3, broadcast_values=0, block_values=8 * 20)
    assert _rows(found) == _brute(data, data, 3)
    blocks_of_queries, first = rounds[0]
    assert first == blocks_of_queries  # each begins with the cell next to it
    cells = 600 // 20
    assert sum(visits for _, visits in rounds) < blocks_of_queries * cells / 2


def test_rounds_grow_from_the_nearest_cells(spark, monkeypatch):
    rounds = _visit_counts(monkeypatch)
    chance = np.random.default_rng(7)
    corpus = chance.normal(size=(300, 8))
    frame = _frame(spark, corpus)
    found = knn_join(frame, frame, 3, broadcast_values=0, block_values=8 * 10)
    assert _rows(found) == _brute(corpus, corpus, 3)
    for number, (opened, visits) in enumerate(rounds):
        assert visits <= opened * B.GROWTH**number


def test_visits_carry_no_vectors(spark, plan):
    chance = np.random.default_rng(7)
    frame = B.in_cells(
        _frame(spark, chance.normal(size=(40, 4))), spark.sparkContext.broadcast(np.eye(4))
    )
    packed = materialise(B.packed(materialise(frame), 10))
    known = spark.sparkContext.broadcast(B.cells_of(packed, np.eye(4)))
    opened = materialise(packed.mapInArrow(B._first_state(2), B._STATE))
    text = plan(B._round(opened, packed, known, 2, 4))
    # the visits are worked out once, and rows of them hold numbers alone
    assert text.count("MapInArrow") == 2 and "Generate" not in text
    assert "binary" not in B._VISITS and "array" not in B._VISITS


@pytest.mark.parametrize("layout", ["blocks", "codes"])
def test_a_cell_of_most_rows_is_dealt_out(spark, monkeypatch, layout):
    monkeypatch.setattr(B, "DEALT_BLOCKS", 2)
    chance = np.random.default_rng(1)
    data = np.vstack([chance.normal(size=(300, 6)) * 0.05 + 5, chance.normal(size=(60, 6))])
    frame = _frame(spark, data)
    monkeypatch.setattr(B, "MAX_PIVOTS", 3)
    placed = B.in_cells(frame, spark.sparkContext.broadcast(B.unit_matrix(data[[0, 301, 302]])))
    assert B.cells_of(B.packed(placed, 20), data[[0, 301, 302]]).dealt.max() >= 7
    found = knn_join(frame, frame, 2, layout=layout, block_values=6 * 20)
    assert _rows(found) == _brute(data, data, 2)


def test_bounds_between_cells_hold(spark):
    chance = np.random.default_rng(11)
    pivots = R.blocks.unit_matrix(chance.normal(size=(6, 5)))
    data = R.blocks.unit_matrix(np.vstack([chance.normal(size=(200, 5)), np.zeros((3, 5))]))
    to_pivots = B.angles(data, pivots)
    cell = to_pivots.argmin(axis=1)
    ranges = [[f(to_pivots[cell == c, c], initial=i) for c in range(6)] for f, i in ((np.min, np.inf), (np.max, -np.inf))]
    cells = B.Cells(pivots, *map(np.array, ranges), np.ones(6, int))
    for c in range(6):
        mine = data[cell == c]
        order, _, bound = cells.order(c, cells.nearest[c], cells.farthest[c])
        assert order[0] == c and (np.diff(bound) >= 0).all()
        for other, least in zip(order, bound):
            assert B.angles(mine, data[cell == other]).min() >= least - 1e-6


def test_empty_sides(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = _frame(spark, [[1.0, 2.0]])
    for left, right in ((empty, some), (some, empty), (empty, empty)):
        assert knn_join(left, right).collect() == []
        assert knn_join(left, right, broadcast_values=0).collect() == []
        assert knn_join(left, right, layout="codes").collect() == []


def test_missing_vectors_take_no_part(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], SCHEMA)
    assert _rows(knn_join(df, df)) == [(1, 1, 1, 1.0)]


def test_normalisation_keeps_zero(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], SCHEMA)
    got = {r.id: r.u for r in df.select("id", l2_normalize(F.col("embedding")).alias("u")).collect()}
    assert got == {1: [pytest.approx(0.6), pytest.approx(0.8)], 2: [0.0, 0.0]}
    assert df.select(dot("embedding", "embedding").alias("d")).first().d == 25.0


def test_context_is_in_rank_order(spark):
    matches = spark.createDataFrame(
        [(1, 2, "b"), (1, 10, "d"), (1, 1, "a"), (1, 3, None)],
        "query_id long, rank int, t string",
    )
    assert context_of(matches, "t", "|").first().context == "a|b||d"


SEARCHES = [{}, {"broadcast_bytes": 0}, {"broadcast_values": 0, "block_values": 16}]


@pytest.mark.parametrize("search", SEARCHES)
def test_context_by_every_path(spark, search):
    corpus = spark.createDataFrame(
        [(10 + i, f"t{i}" if i else None, [1.0, i / 4]) for i in range(8)]
        + [(50, "no vector", None)],
        "id long, sentence string, embedding array<float>",
    )
    queries = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.75]), (4, None)], SCHEMA
    )
    contexts = {
        r.query_id: r.context
        for r in retrieve_context(queries, corpus, 3, separator="|", **search).collect()
    }
    assert contexts == {1: "|t1|t2", 2: "t7|t6|t5", 3: "t3|t4|t2"}


def test_context_of_an_empty_corpus(spark):
    corpus = spark.createDataFrame([], "id long, sentence string, embedding array<float>")
    frame = _frame(spark, [[1.0, 2.0]])
    assert with_context(frame, corpus).first().context == ""


def test_context_from_a_small_corpus_needs_no_shuffle(spark, plan):
    corpus = spark.createDataFrame(
        [(1, "a", [1.0, 2.0])], "id long, sentence string, embedding array<float>"
    )
    one = spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)
    assert "Exchange" not in plan(with_context(one, corpus))


def test_small_corpus_needs_no_shuffle_of_queries(spark, plan):
    frame = _frame(spark, [[1.0, 2.0], [2.0, 1.0]])
    source = spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)
    assert "Exchange" not in plan(knn_join(source, frame))


def test_partial_results_are_pruned_before_the_shuffle(spark, plan):
    frame = _frame(spark, [[1.0, 2.0], [2.0, 1.0]])
    one = spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)
    assert "WindowGroupLimit" in plan(knn_join(one, frame, broadcast_values=2))


CORPUS = "id long, sentence string, embedding array<double>"
LAYOUTS = {
    "small": {},
    "few queries": {"layout": "queries"},
    "blocks": {"layout": "blocks", "block_values": 4},
}


@pytest.mark.parametrize("search", LAYOUTS.values(), ids=LAYOUTS)
class TestOneContract:
    """The same rows or the same error, wherever the rows go."""

    def corpus(self, spark, *more):
        rows = [(i, f"t{i}", [1.0, i / 10]) for i in range(8)] + list(more)
        return spark.createDataFrame(rows, CORPUS)

    def contexts(self, spark, rows, corpus, search, schema="id long, embedding array<double>"):
        queries = spark.createDataFrame(rows, schema)
        found = with_context(queries, corpus, 2, separator="|", **search).collect()
        return sorted(((r.id, r.context) for r in found), key=repr)

    def test_missing_repeated_and_text_ids_of_queries(self, spark, search):
        rows = [(None, [1.0, 0.0]), (7, [1.0, 0.7]), (7, [1.0, 0.0]), (9, None)]
        assert self.contexts(spark, rows, self.corpus(spark), search) == sorted(
            [(None, "t0|t1"), (7, "t7|t6"), (7, "t0|t1"), (9, None)], key=repr
        )
        assert self.contexts(
            spark, [("a", [1.0, 0.0])], self.corpus(spark), search, "id string, embedding array<float>"
        ) == [("a", "t0|t1")]

    def test_corpus_rows_without_id_take_no_part(self, spark, search):
        corpus = self.corpus(spark, (None, "lost", [1.0, 0.0]))
        assert self.contexts(spark, [(1, [1.0, 0.0])], corpus, search) == [(1, "t0|t1")]

    def test_corpus_ids_must_be_integers(self, spark, search):
        corpus = self.corpus(spark).withColumn("id", F.concat(F.lit("c"), "id"))
        with pytest.raises(ValueError, match="must be integers"):
            self.contexts(spark, [(1, [1.0, 0.0])], corpus, search)

    def test_zero_vector_and_ties(self, spark, search):
        corpus = self.corpus(spark, (-1, "zero", [0.0, 0.0]))
        assert self.contexts(spark, [(1, [0.0, 0.0])], corpus, search) == [(1, "zero|t0")]

    def test_no_match_is_an_empty_context(self, spark, search):
        corpus = self.corpus(spark).where("false")
        assert self.contexts(spark, [(1, [1.0, 0.0]), (2, None)], corpus, search) == [(1, ""), (2, None)]

    @pytest.mark.parametrize("element", [float("nan"), float("inf"), 1e300, None])
    def test_a_vector_that_is_no_vector_fails_by_name(self, spark, search, element):
        bad = (42, "bad", [element, 1.0])
        with pytest.raises(Exception, match="corpus row 42"):
            self.contexts(spark, [(1, [1.0, 0.0])], self.corpus(spark, bad), search)
        with pytest.raises(Exception, match="no finite number"):
            self.contexts(spark, [(1, [element, 0.0])], self.corpus(spark), search)

    def test_neighbours_too(self, spark, search):
        corpus = self.corpus(spark).select("id", "embedding")
        assert len(knn_join(corpus, corpus, 2, **search).collect()) == 16
        with pytest.raises(ValueError, match="more than once"):
            knn_join(corpus.union(corpus), corpus, 2, **search)


@pytest.mark.parametrize("layout", ["blocks", "codes"])
def test_a_block_travels_once_a_round_to_a_team_of_queries(spark, monkeypatch, layout):
    travelled, one = spark.sparkContext.accumulator(0), B._visited

    def counting(*arguments):
        run = one(*arguments)

        def counted(batches):
            def seen():
                for batch in batches:
                    travelled.add(sum(turn >= 0 for turn in batch["turn"].to_pylist()))
                    yield batch

            return run(seen())

        return counted

    monkeypatch.setattr(B, "_visited", counting)
    monkeypatch.setattr(B, "TEAMS_PER_CORE", 1, raising=False)
    data = np.random.default_rng(7).normal(size=(600, 8))
    frame = _frame(spark, data)
    found = knn_join(frame, frame, 3, layout=layout, block_values=8 * 10)
    assert _rows(found) == _brute(data, data, 3)
    cells, most_blocks, rounds = 60, 120, 4
    assert cells < travelled.value <= spark.sparkContext.defaultParallelism * most_blocks * rounds


def _hot_case(spark):
    corpus = spark.createDataFrame(
        [(i, f"t{i}", [1.0, i / 10]) for i in range(8)], "id long, sentence string, embedding array<float>"
    )
    rows = [(i, [1.0, 0.0] if i < 40 else None if i < 60 else [1.0, (i - 60) / 10]) for i in range(65)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), corpus


@pytest.mark.parametrize("hot_rows", [1, 7, 1000])
def test_contexts_of_hot_vectors(spark, hot_rows):
    asking, corpus = _hot_case(spark)
    got = with_context(asking, corpus, 2, separator="|", layout="blocks", hot_rows=hot_rows)
    found = {r.id: r.context for r in got.collect()}
    expected = {i: "t0|t1" if i < 40 else None for i in range(60)}
    near = {60: "t0|t1", 61: "t1|t2", 62: "t2|t3", 63: "t3|t4", 64: "t4|t5"}
    assert got.count() == 65 and found == expected | near


def test_contexts_are_shuffled_once(spark, plan):
    asking, corpus = _hot_case(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(with_context(asking, corpus, 2, layout="blocks"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the rows, and the texts that become contexts; not the contexts again
    assert text.count("Exchange hashpartitioning(_share") == 2


# --- short vectors: trees of boxes, and regions -----------------------------


def _units(seed, n, length):
    matrix = _clustered(seed, n, length)
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0, 1, norm)


@pytest.mark.parametrize("length", [1, 3, 8, 16])
@pytest.mark.parametrize("n", [1, 2, 33, 5000])
def test_a_tree_of_boxes_equals_a_table(n, length):
    corpus, queries = _units(5, n, length), _units(6, 300, length)
    ids = np.random.default_rng(7).permutation(n)
    table, tree = X.Table(corpus, ids), X.BoxTree(corpus, ids)
    for floor in (None, np.full(300, -2.0), np.full(300, 0.99)):
        for k in (1, 3, 40):
            found = [searched.search(queries, k, floor) for searched in (table, tree)]
            kept = [f[1] >= (-1.0 if floor is None else floor[0]) for f in found]
            for expected, got in zip(*found):
                assert (expected[kept[0]] == got[kept[1]]).all()


def test_leaves_compared_hardly_grow_with_the_corpus(monkeypatch):
    compared = []
    whole = X.BoxTree._compared

    def counted(self, units, rows, *more):
        compared[-1] += len(rows)
        return whole(self, units, rows, *more)

    monkeypatch.setattr(X.BoxTree, "_compared", counted)
    chance = np.random.default_rng(8)
    for n in (10_000, 160_000):
        corpus = chance.normal(size=(n, 3))
        corpus /= np.linalg.norm(corpus, axis=1, keepdims=True)
        compared.append(0)
        X.searchable(corpus, np.arange(n)).search(corpus[:1000], 3)
    assert compared[0] < 1000 * 10_000 / X.LEAF_ROWS / 10
    assert compared[1] < 2 * compared[0]


@pytest.mark.parametrize("n, length, region_rows", [(600, 8, 64), (600, 3, 64), (1500, 8, 10_000), (5, 8, 64)])
def test_regions_equal_brute_force(spark, monkeypatch, n, length, region_rows):
    corpus, queries = _clustered(1, n, length), _clustered(2, n // 2 + 1, length)
    monkeypatch.setattr(R, "by_regions", lambda *given: G.by_regions(*given, region_rows))
    # several tasks for a region
    monkeypatch.setattr(G, "ASKED_ROWS", 50)
    found = knn_join(_frame(spark, queries, 1000), _frame(spark, corpus), 3, layout="regions")
    assert _rows(found) == _brute(queries, corpus, 3, 1000)


def test_regions_that_rule_nothing_out_give_way_to_blocks(spark, monkeypatch):
    corpus = np.random.default_rng(3).normal(size=(400, 16))
    monkeypatch.setattr(R, "by_regions", lambda *given: G.by_regions(*given, 16))
    monkeypatch.setattr(G, "MOST_VISITS", 2)
    asked = []
    whole = B.one_search
    monkeypatch.setattr(B, "one_search", lambda *given: asked.append(1) or whole(*given))
    found = knn_join(_frame(spark, corpus), _frame(spark, corpus), 3, layout="regions")
    assert _rows(found) == _brute(corpus, corpus, 3) and asked


@pytest.mark.parametrize("length, pairs, expected", [(8, 100, True), (8, 10**10, False), (17, 100, False)])
def test_short_vectors_of_many_pairs_go_to_regions(spark, monkeypatch, length, pairs, expected):
    corpus = _clustered(4, 60, length)
    chosen = []
    monkeypatch.setattr(R, "by_regions", lambda *given: chosen.append(1) or G.by_regions(*given))
    monkeypatch.setattr(R, "FEW_PAIRS", pairs)
    found = knn_join(_frame(spark, corpus), _frame(spark, corpus), 3, broadcast_values=0)
    assert _rows(found) == _brute(corpus, corpus, 3)
    assert bool(chosen) == expected


def test_few_bytes_of_vectors_are_searched_by_all_cores(spark, monkeypatch):
    corpus = _frame(spark, _clustered(9, 300)).withColumn("sentence", F.col("id").cast("string"))
    tasks = []
    whole = R._against_small_corpus
    monkeypatch.setattr(
        R, "_against_small_corpus", lambda asked, *more: tasks.append(asked.rdd.getNumPartitions()) or whole(asked, *more)
    )
    assert with_context(corpus, corpus, broadcast_bytes=0).count() == 300
    assert tasks[0] >= spark.sparkContext.defaultParallelism
