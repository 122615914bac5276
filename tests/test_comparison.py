"""Statistics of two runs against plain Python."""

import math
import random
import statistics

import pytest

from pyspark.sql import functions as F

from plumbline.functions.distributions import normal_two_sided, student_two_sided
from plumbline.operators import comparison as C
from plumbline.operators import ordering
from plumbline.session import materialise


def _diffs(spark, values, measure="m"):
    return spark.createDataFrame(
        [(i, measure, float(v)) for i, v in enumerate(values)],
        "id long, measure string, d double",
    )


def _by_ranks(values):
    kept = [v for v in values if v]
    order = sorted(abs(v) for v in kept)
    def rank(v):
        first = order.index(abs(v))
        return first + (order.count(abs(v)) + 1) / 2
    plus = sum(rank(v) for v in kept if v > 0)
    minus = sum(rank(v) for v in kept if v < 0)
    return len(kept), plus, minus


@pytest.mark.parametrize("seed", range(3))
def test_wilcoxon(spark, seed):
    chance = random.Random(seed)
    values = [chance.choice([-2, -1, 0, 0, 1, 2, 3, 0.5]) for _ in range(80)]
    row = C.wilcoxon_signed_rank(_diffs(spark, values)).first()
    n, plus, minus = _by_ranks(values)
    assert (row.pairs, row.n, row.w_plus, row.w_minus) == (80, n, plus, minus)
    assert row.w_plus + row.w_minus == n * (n + 1) / 2
    assert row.p == pytest.approx(math.erfc(abs(row.z) / math.sqrt(2)))


def test_swapping_the_runs_negates(spark):
    values = [1, -1, 1, 1, 0, 2, -3]
    one, other = _diffs(spark, values), _diffs(spark, [-v for v in values])
    assert C.paired_t(one).first().t == pytest.approx(-C.paired_t(other).first().t)
    a, b = C.wilcoxon_signed_rank(one).first(), C.wilcoxon_signed_rank(other).first()
    assert (a.w_plus, a.w_minus) == (b.w_minus, b.w_plus)
    assert a.z == pytest.approx(-b.z)


def test_no_spread(spark):
    same = _diffs(spark, [0, 0, 0])
    t, w = C.paired_t(same).first(), C.wilcoxon_signed_rank(same).first()
    assert (t.t, t.p) == (None, None)
    assert (w.pairs, w.n, w.w_plus, w.w_minus, w.z, w.p) == (3, 0, 0, 0, None, None)
    assert C.paired_t(_diffs(spark, [1.0])).first().t is None


def test_paired_t_of_a_known_sample(spark):
    values = [1.2, 2.4, 1.3, 1.3, 0.0, 1.0, 1.8, 0.8, 4.6, 1.4]
    row = C.paired_t(_diffs(spark, values)).first()
    # the sleep data of Student (1908): t = 4.0621, df = 9, p = 0.002833
    assert row.t == pytest.approx(4.0621, abs=1e-4)
    assert row.df == 9
    assert row.p == pytest.approx(0.002833, abs=1e-6)


@pytest.mark.parametrize(
    "t, df, p",
    [(2.228139, 10, 0.05), (12.706205, 1, 0.05), (2.042272, 30, 0.05), (1.959964, 1e9, 0.05),
     (2.575829, 1e8, 0.01), (0.0, 5, 1.0), (3.169273, 10, 0.01), (1.983972, 100, 0.05)],
)
def test_student_table_values(t, df, p):
    assert student_two_sided(t, df) == pytest.approx(p, abs=1e-6)
    assert student_two_sided(-t, df) == pytest.approx(p, abs=1e-6)


def test_descriptives(spark):
    chance = random.Random(5)
    values = {
        "a": [chance.randint(0, 9) for _ in range(101)],
        "b": [chance.random() for _ in range(50)],
        "c": [4.0],
        "d": [],
    }
    rows = [("r", m, float(v)) for m, vs in values.items() for v in vs]
    rows += [("r", m, None) for m in values]
    df = spark.createDataFrame(rows, "run string, measure string, value double")
    got = {r.measure: r for r in C.descriptives(df).collect()}
    for measure, vs in values.items():
        row = got[measure]
        assert (row.n, row.missing) == (len(vs), 1)
        assert row.median == (pytest.approx(statistics.median(vs)) if vs else None)
        assert row.mean == (pytest.approx(statistics.mean(vs)) if vs else None)
        assert row.sd == (pytest.approx(statistics.stdev(vs)) if len(vs) > 1 else None)
        assert (row.min, row.max) == ((min(vs), max(vs)) if vs else (None, None))


def test_pairing_keeps_rows_both_runs_have(spark):
    first = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, None)], "id long, x double")
    second = spark.createDataFrame([(1, 0.0), (3, 1.0), (4, 1.0)], "id long, x double")
    rows = C.paired_differences(first, second, ["x"]).collect()
    assert [tuple(r) for r in rows] == [(1, "x", 1.0)]


def test_prefix_sums_over_several_tasks(spark):
    chance = random.Random(1)
    rows = sorted({(chance.choice("ab"), round(chance.gauss(0, 3), 2)) for _ in range(3000)})
    rows = [(g, v, chance.randint(1, 9)) for g, v in rows]
    expected, seen = set(), {"a": 0, "b": 0}
    for g, v, w in rows:
        expected.add((g, v, w, seen[g]))
        seen[g] += w
    df = spark.createDataFrame(chance.sample(rows, len(rows)), "g string, v double, w long")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else AQE makes one task of them
    try:
        summed = ordering.prefix_sums(df, [F.col("v")], {"before": F.col("w")}, ["g"])
        got = summed.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert {(r.g, r.v, r.w, r.before) for r in got} == expected and len(got) == len(expected)


def test_prefix_sums_of_two_weights_without_groups(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    summed = ordering.prefix_sums(df, [F.desc("v")], {"rows": F.lit(1), "total": F.col("v")})
    for row in summed.collect():
        assert row.rows == 999 - row.v
        assert row.total == sum(range(row.v + 1, 1000))


def test_a_repeated_key_fails_and_is_named(spark):
    first = spark.createDataFrame([(1, 1.0), (1, 0.0), (None, 1.0), (None, 2.0)], "id long, x double")
    second = spark.createDataFrame([(1, 0.0)], "id long, x double")
    with pytest.raises(Exception, match="id 1 occurs more than once in the first run"):
        C.paired_differences(first, second, ["x"]).collect()
    with pytest.raises(Exception, match="id 1 occurs more than once in the second run"):
        C.paired_differences(second, first, ["x"]).collect()


@pytest.mark.parametrize("n", [1, 11, 999, 1000, 2000])
def test_first_rows_equal_plain(spark, n):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 * 3 as id", "id as x")
    expected = sorted(r.id for r in df.collect())[:n]
    assert sorted(r.id for r in ordering.first_rows(df, n).collect()) == expected


@pytest.mark.parametrize("kind", ["string", "bigint", "double", "date"])
@pytest.mark.parametrize("n", [1, 4, 5, 7, 9, 20])
def test_first_rows_with_ties_and_missing_keys(spark, kind, n):
    keys = [5, 2, None, 2, 9, 2, None, 7, 2]
    rows = [(None if k is None else f"2020-01-0{k}" if kind == "date" else str(k), i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k string, x int").repartition(3)
    df = df.withColumn("k", df.k.cast(kind))
    found = [r.k for r in ordering.first_rows(df, n, "k").collect()]
    ordered = sorted((r.k for r in df.collect()), key=lambda k: (k is None, k or 0 if kind != "string" else k or ""))
    assert sorted(found, key=repr) == sorted(ordered[:n], key=repr)


def test_first_rows_twice_are_the_same_rows(spark):
    df = spark.range(300).selectExpr("id % 3 as k", "id as x").repartition(7)
    one, two = ({r.x for r in ordering.first_rows(df, 120, "k").collect()} for _ in range(2))
    assert one == two and len(one) == 120


@pytest.mark.parametrize("n", [1, 30, 99, 100, 101, 150, 250, 300])
def test_selection_by_splitters(spark, n):
    chance = random.Random(n)
    keys = [chance.choice([7.0, chance.random() * 20, None, math.nan]) for _ in range(260)]
    df = materialise(spark.createDataFrame(list(enumerate(keys)), "x int, k double").repartition(3))
    found = ordering.first_rows(df, n, "k", select_rows=5).collect()
    order = lambda k: (k is None, k is not None and k != k, 0 if k is None or k != k else k)
    expected = sorted(keys, key=order)[:n]
    assert sorted(map(order, (r.k for r in found))) == list(map(order, expected))
    assert len({r.x for r in found}) == len(found) == min(n, 260)


def test_selection_neither_sorts_nor_checkpoints(spark, monkeypatch, plan):
    monkeypatch.setattr(ordering, "materialise", None)
    df = spark.range(100_000).selectExpr("id * 7919 % 100000 as id", "id as x")
    cut = ordering.first_rows(df, 50)
    assert {r.id for r in cut.collect()} == set(range(50))
    assert "rangepartitioning" not in plan(cut)


def _p_by_enumeration(values):
    """Over all signs of the ranks: how often the rank sum is as far from its middle."""
    sizes = sorted(abs(v) for v in values if v)
    ranks = [2 * sizes.index(v) + sizes.count(v) + 1 for v in (abs(v) for v in values if v)]
    signs = [v > 0 for v in values if v]
    total = sum(ranks)
    far = abs(2 * sum(r for r, s in zip(ranks, signs) if s) - total)
    ways = [
        abs(2 * sum(r for i, r in enumerate(ranks) if mask >> i & 1) - total) >= far
        for mask in range(1 << len(ranks))
    ]
    return sum(ways) / len(ways)


def test_exact_wilcoxon_is_full_enumeration(spark):
    chance = random.Random(4)
    samples = {
        f"m{n}{kind}": [chance.choice([-3, -2, -1, 0, 1, 2, 2.5]) if kind == "t" else chance.gauss(0.4, 1) for _ in range(n)]
        for n in (1, 2, 5, 8, 12) for kind in ("t", "g")
    }
    rows = [(i, m, float(v)) for m, values in samples.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, measure string, d double")
    got = {r.measure: r for r in C.wilcoxon_signed_rank(df, [*samples, "none"], "exact").collect()}
    for measure, values in samples.items():
        if any(values):
            assert got[measure].p == pytest.approx(_p_by_enumeration(values), rel=1e-12)
        else:
            assert got[measure].p is None
    assert got["none"].p is None


def test_exact_wilcoxon_meets_normal_and_has_a_limit(spark, monkeypatch):
    chance = random.Random(9)
    values = [chance.gauss(0.1, 1) for _ in range(400)]
    exact = C.wilcoxon_signed_rank(_diffs(spark, values), method="exact").first()
    assert exact.p == pytest.approx(math.erfc(abs(exact.z) / math.sqrt(2)), abs=2e-3)
    monkeypatch.setattr(C, "MAX_EXACT", 399)
    with pytest.raises(ValueError, match="at most 399"):
        C.wilcoxon_signed_rank(_diffs(spark, values), method="exact")


@pytest.mark.parametrize("df", [1e6, 9.9e6, 1.01e7, 1e8, 1e10])
@pytest.mark.parametrize("t", [0.3, 1.5, 5.0, 20.0, 36.0])
def test_student_meets_normal_at_every_size(t, df):
    # first terms of the expansion about the normal tail
    z = normal_two_sided(t)
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    first = 2 * density * t * (t * t + 1) / (4 * df)
    second = 2 * density * t * (3 * t**6 - 7 * t**4 - 5 * t * t - 3) / (96 * df * df)
    assert student_two_sided(t, df) == pytest.approx(z + first + second, rel=1e-5)


@pytest.mark.parametrize("t, df, p", [(1.0, 1, 0.5), (math.sqrt(2), 2, 1 - math.sqrt(0.5)), (1e8, 1, 2e-8 / math.pi), (0.0, 3, 1.0), (math.inf, 3, 0.0), (1e-9, 5, 1.0)])
def test_student_in_closed_form(t, df, p):
    assert student_two_sided(t, df) == pytest.approx(p, rel=1e-9)


@pytest.mark.parametrize("df", [1, 3, 10, 49, 50, 99, 101, 1000])
@pytest.mark.parametrize("t", [0.1, 1.0, 3.0, 10.0])
def test_student_by_integration(t, df):
    norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    n = 20_000
    inside = sum(
        (4 if i % 2 else 2 if 0 < i < n else 1) * (1 + (t * i / n) ** 2 / df) ** (-(df + 1) / 2) for i in range(n + 1)
    )
    assert student_two_sided(t, df) == pytest.approx(1 - 2 * norm * inside * t / n / 3, abs=1e-9)


def test_a_measure_without_pairs_keeps_its_row(spark):
    diffs = _diffs(spark, [1.0, -2.0, 0.0])
    t = {r.measure: r for r in C.paired_t(diffs, ["m", "none"]).collect()}
    w = {r.measure: r for r in C.wilcoxon_signed_rank(diffs, ["m", "none"]).collect()}
    assert (t["m"].n, w["m"].pairs) == (3, 3)
    assert tuple(t["none"]) == ("none", 0, None, None, None, None, None)
    assert (w["none"].pairs, w["none"].n, w["none"].w_plus, w["none"].z, w["none"].p) == (0, 0, 0, None, None)
