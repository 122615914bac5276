import math

import numpy as np
import pytest
from conftest import FOLDER

from plumbline.llm import whitening as W
from plumbline.llm.queries import QUERIES


def brute(vectors):
    """Distinct whole-numbered vectors, covariance and its eigenvectors, falling."""
    x = np.array(sorted(set(vectors)), dtype=object)
    centred = np.array(
        [[float((int(a) * len(x) - int(s)) / len(x)) for a, s in zip(row, x.sum(axis=0))] for row in x]
    )
    covariance = centred.T @ centred / len(x)
    values, found = np.linalg.eigh(covariance)
    return x, covariance, values[::-1], found[:, ::-1]


def check(rows, table, components=4):
    """``table``: identifier -> vector or None; identifiers differ."""
    whole = {
        i: tuple(math.floor(256 * float(c)) for c in v)
        for i, v in table.items()
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    }
    x, covariance, values, vectors = brute(whole.values())
    n, sums = len(x), [sum(int(a) for a in column) for column in x.T]
    wanted = min(components, int((values > len(values) * 2.3e-16 * max(values[0], 0)).sum())) if values[0] > 0 else 0
    found = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(found) == len(whole) * wanted
    pairs = {}
    mean = np.array([s / n for s in sums])
    for (i, k), row in sorted(found.items()):
        vector = whole[i]
        assert (row.n, int(row.deviation)) == (n, sum((n * a - s) ** 2 for a, s in zip(vector, sums)))
        assert row.explained == pytest.approx(values[k - 1] / np.trace(covariance), rel=1e-9)
        assert 0 <= row.identity_error < 1e-9
        expected = (np.array(vector, float) - mean) @ vectors[:, k - 1] / math.sqrt(values[k - 1])
        pairs.setdefault(k, []).append((expected, row.whitened))
    for both in pairs.values():
        sign = math.copysign(1, math.prod(max(both, key=lambda pair: abs(pair[0]))))
        for expected, whitened in both:
            assert whitened == pytest.approx(sign * expected, abs=1e-6)


@pytest.mark.parametrize("length, spectrum", [(64, "spread"), (64, "flat"), (200, "spread"), (5, "flat"), (30, "ties")])
def test_jacobi_davidson_on_a_matrix(length, spectrum):
    chance = np.random.default_rng(length)
    basis = np.linalg.qr(chance.standard_normal((length, length)))[0]
    values = {
        "spread": 100 * 0.8 ** np.arange(length),
        "flat": 1 + 0.01 * np.arange(length)[::-1],
        "ties": np.repeat([5.0, 2.0, 1.0], length // 3),
    }[spectrum]
    matrix = (basis * values) @ basis.T
    passes = []

    def product(directions):
        passes.append(directions.shape[1])
        return matrix @ directions

    got, vectors = W.jacobi_davidson(product, length, 4)
    assert got == pytest.approx(values[:4], rel=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13
    assert np.linalg.norm(matrix @ vectors - vectors * got, axis=0).max() < 1e-12 * values[0]
    assert len(passes) < 250 and max(passes) <= 10
    if spectrum == "spread":
        assert np.abs(np.abs((vectors * basis[:, :4]).sum(axis=0)) - 1).max() < 1e-12


def test_rank_below_the_wanted_components():
    matrix = np.diag([3.0, 1.0] + [0.0] * 10)
    values, _ = W.jacobi_davidson(lambda d: matrix @ d, 12, 4)
    assert values == pytest.approx([3, 1, 0, 0], abs=1e-14)


def test_minres_solves_the_projected_equation():
    chance = np.random.default_rng(1)
    root = chance.standard_normal((12, 12))
    matrix, away = root + root.T, np.linalg.qr(chance.standard_normal((12, 2)))[0]
    residual = chance.standard_normal(12)
    solver = W._Minres(residual, away, 0.3)
    lengths = []
    for _ in range(10):
        solver.over = False
        solver.take(matrix @ solver.direction)
        lengths.append(np.linalg.norm(solver._left))
    project = np.eye(12) - away @ away.T
    assert np.all(np.diff(lengths) <= 1e-12) and lengths[-1] < 1e-8
    left = project @ (matrix - 0.3 * np.eye(12)) @ project @ solver.solution + project @ residual
    assert np.linalg.norm(left) < 1e-8


def test_query_against_eigh(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    check(QUERIES["op11_embedding_whitening"](spark, FOLDER).collect(), {r.vec_id: r.embedding for r in rows})


SCHEMA = "vec_id bigint, embedding array<float>"


def test_odd_rows(spark):
    chance = np.random.default_rng(3)
    good = {i: [float(np.float32(c)) for c in chance.standard_normal(6)] for i in range(40)}
    odd = {100: None, 101: [None] + [0.5] * 5, 102: [math.nan] * 6, 103: [math.inf] + [0.0] * 5,
           104: good[0], 105: good[0], 106: [-0.0] * 6, 107: [100.0, -100.0, 0.0, 0.0, 1e-30, -1e-30]}
    table = good | odd
    df = spark.createDataFrame([(i, v, "a", 1.0) for i, v in table.items()], SCHEMA + ", component string, x double")
    check(W.whiten(df).collect(), table)


@pytest.mark.parametrize("vectors", [[[0.5, 0.25], [0.1, 0.9]], [[1.0, 2.0, 3.0]] * 3, [[0.0], [1.0], [5.0]], [[]]])
def test_fewer_directions_than_components(spark, vectors):
    df = spark.createDataFrame(list(enumerate(vectors)), SCHEMA)
    rows = W.whiten(df).collect()
    distinct = len({tuple(v) for v in vectors})
    assert len(rows) == len(vectors) * min(len(vectors[0]), distinct - 1)
    if rows:
        check(rows, dict(enumerate(vectors)))


def test_no_rows_and_missing_identifiers(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []
    rows = W.whiten(spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [0.0, 1.0])], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in rows) == [(0, 1, 2), (0, 1, 2), (3, 1, 2)]


def test_lengths_that_differ_fail(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA)
    with pytest.raises(Exception, match="differ in length"):
        W.whiten(df).collect()


def test_sums_and_deviations_beyond_doubles(spark):
    big = [[3e12, 1.0, 0.5], [-1e12, 2.0, 0.25], [5e11, 3.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(big)), "vec_id bigint, embedding array<double>")
    check(W.whiten(df, 1).collect(), dict(enumerate(big)), 1)


def test_one_vector_in_a_third_of_the_rows_counts_once(spark):
    chance = np.random.default_rng(5)
    table = {i: [1.0, 0.0, 0.5] if i % 3 == 0 else chance.standard_normal(3).round(2).tolist() for i in range(600)}
    check(W.whiten(spark.createDataFrame(list(table.items()), "vec_id bigint, embedding array<double>")).collect(), table)
