"""Whitening against dense eigenvectors, and exact figures against Python's integers."""

import math

import numpy as np
import pytest

from quern.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, n int, x string, component int"


def matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        np.random.default_rng(1).uniform(1, 10, 64),
        np.full(64, 3.0),
        np.full(300, 3.0),
        np.concatenate([np.full(40, 9.0), np.random.default_rng(2).uniform(0, 1, 400)]),  # more copies than a block holds
        np.concatenate([np.full(24, 9.0), np.full(24, 5.0), np.random.default_rng(3).uniform(0, 1, 400)]),
        10.0 ** -np.linspace(0, 6, 400),
        np.concatenate([[5.0, 4.0, 3.0], np.zeros(200)]),  # every later block breaks down
        np.array([2.0]),
    ],
)
def test_lanczos_finds_all_of_the_largest(values):
    a = matrix(values)
    got, vectors = whitening.block_lanczos(lambda q: a @ q, len(values), 32)
    k = min(32, len(values))
    assert np.allclose(got, np.sort(values)[::-1][:k], atol=1e-12 * values.max(), rtol=0)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.linalg.norm(a @ vectors - vectors * got, axis=0).max() < 1e-10 * values.max()


def test_restarts_keep_the_basis_bounded():
    a, widest = matrix(np.random.default_rng(4).uniform(1, 10, 500)), []
    whitening.block_lanczos(lambda q: widest.append(q.shape[1]) or a @ q, 500, 8, 4)
    assert len(widest) > (4 * 8 + 4 * 4) // 4 and max(widest) <= 4


def expected(vectors):
    """Rows by position of the vectors that stay: exact n, deviations, and dense whitened coordinates."""
    stay = {i: [math.floor(64 * float(np.float32(e))) + 1000000 for e in v] for i, v in enumerate(vectors) if v is not None and all(e is not None and math.isfinite(e) for e in v)}
    n = len(stay)
    sums = [sum(c) for c in zip(*stay.values())]
    deviation = {i: sum((n * e - s) ** 2 for e, s in zip(v, sums)) for i, v in stay.items()}
    c = np.array([[(n * e - s) / n for e, s in zip(v, sums)] for v in stay.values()])
    values, axes = np.linalg.eigh(c.T @ c / n)
    return n, deviation, c, values[::-1], axes[:, ::-1], list(stay)


def test_query_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(5)
    vectors = [list(map(float, v)) for v in rng.normal(size=(300, 40)) * np.linspace(1, 3, 40)]
    vectors[3], vectors[5] = vectors[4], vectors[4]
    vectors += [None, [None] * 40, [float("nan")] + [0.0] * 39, [float("-inf")] + [0.0] * 39, vectors[0][:39] + [None]]
    df = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in enumerate(vectors)], SCHEMA)
    rows = whitening.query(df).collect()
    n, deviation, c, values, axes, ids = expected(vectors)
    assert len(rows) == n * 32 and {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1
    assert {(r.vec_id, r.deviation) for r in rows} == set(deviation.items())
    got = np.zeros((n, 32))
    for r in rows:
        got[ids.index(r.vec_id), r.component - 1] = r.whitened
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10
    want = c @ axes[:, :32] / np.sqrt(values[:32])
    sign = np.sign((got * want).sum(0))
    assert np.abs(got * sign - want).max() < 1e-8
    assert rows[0].identity_error < 1e-10 and np.abs(got.T @ got / n - np.eye(32)).max() < 1e-10


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_on_whole_tables(spark, folder):
    rows = queries.QUERIES["op11_whitening"](spark, f"/root/testdata/{folder}").toPandas()
    assert rows.identity_error.max() < 1e-10 and rows.groupby("component").whitened.std(ddof=0).sub(1).abs().max() < 1e-8
    assert rows.groupby("component").explained.first().is_monotonic_decreasing


def test_ranks_below_the_components_and_degenerate_tables(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in enumerate(rows)], SCHEMA)
    flat = whitening.query(make([[float(i), 2.0 * i, 1.0] for i in range(10)])).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    for rows in ([], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 3):
        assert whitening.query(make(rows)).count() == 0
    mixed = whitening.query(make([[1.0, 2.0], [2.0, 5.0], [3.0, 1.0], [7.0]])).collect()
    assert {r.vec_id for r in mixed} == {0, 1, 2} and {r.n for r in mixed} == {3}


def test_deviations_beyond_64_bits(spark):
    rows = [[1e12, 0.0], [-1e12, 1.0], [3.0, 2.0], [1e38, -1e38]]
    wide = spark.createDataFrame([(i, v) for i, v in enumerate(rows[:3])], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.query(wide).collect()}
    stay = [[math.floor(64 * e) + 1000000 for e in v] for v in rows[:3]]
    sums = [sum(c) for c in zip(*stay)]
    want = [sum((3 * e - s) ** 2 for e, s in zip(v, sums)) for v in stay]
    assert got == {i: w if w < 1 << 63 else None for i, w in enumerate(want)} and None in got.values()
    assert whitening.query(spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")).count() > 0
