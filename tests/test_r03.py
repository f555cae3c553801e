"""Findings of round 3: results on sizes and values that the small tables lack."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import boosting as B
from quern.operators import features as X
from quern.operators import learning as L
from quern.operators import networks as N
from quern.operators import rank_metrics
from quern.operators import resample as R
from quern.operators import selection as S
from quern.plans import fixtures, registry
from quern.sources import files


def test_closest_pairs_equal_all_pairs(spark):
    rng = random.Random(1)
    spot = lambda: [rng.gauss(0, 1) * rng.choice([1e-3, 1, 50]) for _ in range(3)]
    a, b = ([("g" if k % 3 else "h", k % 2, spot(), k) for k in range(150)] for _ in range(2))
    b += [("g", 0, a[2][2], 900), ("g", 0, a[2][2], 901), ("g", 1, None, 902), ("h", 1, [math.nan, 0.0, 0.0], 903), (None, 0, [0.0] * 3, 904), ("lone", 0, [0.0] * 3, 905)]
    make = lambda rows, key: spark.createDataFrame(rows, f"g string, {key} int, at array<double>, n int")
    got = {}
    for r in X.closest_pairs(make(a, "i"), make(b, "j"), "g", "i", "j").collect():
        got.setdefault((r.g, r.i, r.j), set()).add((r.a.n, r.b.n, r.d))
    want = {}
    for g, i, p, n in a:
        for h, j, q, m in b:
            if g == h and q and not math.isnan(q[0]):
                want.setdefault((g, i, j), []).append((math.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2), n, m))
    assert got == {k: {(n, m, d) for d, n, m in v if d == min(v)[0]} for k, v in want.items()}
    assert X.closest_pairs(make(a, "i"), make([], "j"), "g", "i", "j").count() == 0


def test_pdb_numbers_beyond_five_digits(spark):
    numbers = [0, 7, -3, 99_999, 100_000, 100_001, 125_000, 1_000_000, 43_770_015, 43_770_016, 87_440_031]
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint").withColumn("s", files.pdb_serial(F.col("n")))
    rows = df.withColumn("line", F.concat(F.lit("ATOM  "), "s", F.lit("  CA  GLY A   1    " + "   1.000" * 3 + " " * 22 + " C"))).drop("s")
    got = files.parse_pdb(rows).collect()
    assert sorted((r.n, r.serial, r.x, r.element) for r in got) == sorted((n, n, 1.0, "C") for n in numbers)
    assert {r.s for r in df.where("n >= 99999").collect()} >= {"99999", "A0000", "A0001", "ZZZZZ", "a0000", "zzzzz"}
    with pytest.raises(Exception, match="five columns"):
        spark.range(87_440_032, 87_440_033).select(files.pdb_serial(F.col("id"))).collect()


def test_searches_compare_in_blocks(spark):
    """Pairs are met inside tasks: no operator of the plan makes rows of them."""
    rng = np.random.default_rng(2)
    w = [int(v) for v in rng.integers(0, 1 << 12, 400)]
    train, asked = w[:300] + [0], w[300:] + [0, w[0], -1]
    t = lambda a, b: (a & b).bit_count() / (a | b).bit_count() if a | b else 1.0
    full = lambda v: v & (1 << 64) - 1
    want = {}
    for i, a in enumerate(asked):
        m = max(t(full(a), b) for b in train)
        want[i] = m, min(j for j, b in enumerate(train) if t(full(a), b) == m)
    make = lambda v, a, b: spark.createDataFrame([*enumerate(v), (999, None)], f"{a} bigint, {b} bigint")
    for rows in (100_000, 7):
        best = S.nearest_tanimoto(make(asked, "id", "w"), make(train, "train", "tw"), rows)
        assert {r.id: (r.t, r.nearest) for r in best.collect()} == want
        assert "Join" not in best._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in S.nearest_fingerprint(*(df.withColumn(c, F.array(c)) for df, c in ((make(asked, "id", "w"), "w"), (make(train, "train", "tw"), "tw"))), size=64)._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_carry_values_and_nearest_meet_few(spark, monkeypatch):
    rng = np.random.default_rng(3)
    at = rng.random((1500, 3))
    points = spark.createDataFrame([("g", i, *map(float, p), i % 7) for i, p in enumerate(at)], "g string, id int, x double, y double, z double, s int")
    assert all(r.s == r.b_key % 7 for r in X.pairs_within(points, "g", "id", 0.05, carry=("s",)).collect())
    met, own = [], X.pairs_within
    monkeypatch.setattr(X, "pairs_within", lambda *a, **k: met.append(own(*a, **k)) or met[-1])
    got = {(r.a_key, r.k): r.b_key for r in X.nearest_k(points, "g", "id", 3, 2.0).collect()}
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2)) + np.eye(1500) * 9
    assert got == {(i, k + 1): int(j) for i in range(1500) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    assert sum(m.count() for m in met) < 200 * 1500


def test_boosting_keeps_equal_rows_once(spark):
    df = spark.range(5000).select((F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), ((F.col("id") % 5 > 2) != (F.col("id") % 3 == 1)).cast("int").alias("y"))
    rows = df.select("a", "b", F.col("y").cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(False).alias("held"))
    binned = B._binned(rows, B.Model(["a", "b"], [[0.0, 1.0, 2.0, 3.0], [0.0, 1.0]], 0.0, []))
    assert binned.count() == 15 and binned.agg(F.sum("n")).first()[0] == 5000
    many, one = (B.fit(d, ["a", "b"], "y", leaves=8, rounds=4, rate=0.3, least_rows=n) for d, n in ((df, 200), (df.distinct().unionByName(df.distinct()), 1)))
    assert B.scored(df, many).where(((F.col("score") > 0.5).cast("int")) != F.col("y")).count() == 0
    assert [t.feature for t in many.trees][0] == [t.feature for t in one.trees][0]


def test_draws_spread_over_tasks(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), "id")
    plain = sorted(map(tuple, R.resampled_within(df, "g", "id", 7, "s").collect()))
    monkeypatch.setattr(R, "DRAWS_BLOCK", 100)
    assert sorted(map(tuple, R.resampled_within(df, "g", "id", 7, "s").collect())) == plain
    assert sum(r[-1] for r in plain) == 500 * 7
    assert R.resampled_within(df, "g", "id", 7, "s").count() == len(plain)


def test_complexes_are_dealt_by_their_number_of_items(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, fixtures.ranked_items(spark, sf).collect()))
    monkeypatch.setattr(fixtures, "TASK_ITEMS", 700)
    dealt = fixtures.ranked_items(spark, sf, dealt=True)
    assert dealt.rdd.getNumPartitions() == -(-len(want) // 700) and sorted(map(tuple, dealt.collect())) == want
    for name in ("fe4_context", "w3_w4_assayed_ranks", "m8_spearman", "a22_selection_conflicts"):
        assert "RepartitionByExpression" in registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_radial_columns_compile(spark):
    assert "lambda" not in registry.QUERIES["x5_radial_basis"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_merged_rows_leave_trees_and_gradients(spark):
    df = spark.range(4000).select((F.col("id") % 11).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), ((F.col("id") % 11 + F.col("id") % 7) > 8).cast("int").alias("y"), "id")
    a, b = (L.score_with(L.boosted_head(df, ["a", "b"], "y", trees=2, depth=2, merged=m), df, ["a", "b"]).orderBy("id").collect() for m in (False, True))
    assert [r.score for r in a] == pytest.approx([r.score for r in b], abs=1e-9)
    rows = df.select(F.col("id").alias("key"), F.array(F.array("a", "b")).alias("x"), F.array(F.col("y").cast("double")).alias("y"), F.array(F.lit(1.0)).alias("mask"))
    (u, p), (v, q) = (N.fit(rows, rows, ["key"], 2, 1, steps=5, look=5, merged=m) for m in (False, True))
    assert p == pytest.approx(q) and all(np.allclose(x, y) for x, y in zip(u, v))


def test_networks_take_sets_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(k, rng.random((k % 5 + 1, 3)).tolist(), [float(k % 2)], [1.0]) for k in range(60)], "key int, " + N.SCHEMA)
    w = N.start(3, 4, 1)
    loss, g = N._summed(rows, w)
    p = N.scored(rows, w, ["key"]).orderBy("key").collect()
    monkeypatch.setattr(N, "CHUNK_MEMBERS", 4)
    got, h = N._summed(rows, w)
    assert got == pytest.approx(loss) and np.allclose(g, h)
    assert [r.p[0] for r in N.scored(rows, w, ["key"]).orderBy("key").collect()] == pytest.approx([r.p[0] for r in p])


def test_logistic_grid_is_fitted_in_common_passes(spark):
    """Least losses for every C, as Spark's own fits with a narrow tolerance, in few jobs."""
    from pyspark.ml.classification import LogisticRegression

    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 3)) * [1, 4, 0.2]
    y = rng.random(900) < 1 / (1 + np.exp(-(x @ [2.0, -0.7, 3.0] - 2)))
    df = spark.createDataFrame([(*map(float, r), int(t), k) for k, (r, t) in enumerate(zip(x, y))], "a double, b double, c double, y int, id int").repartition(3).cache()
    train, valid, f = df.where("id % 3 > 0"), df.where("id % 3 = 0"), ["a", "b", "c"]
    spark.sparkContext.setJobGroup("logistic", "logistic")
    c, model, table = L.logistic_head(train, valid, f, "y")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("logistic")) < 50
    n = train.count()
    for k, (own, ap) in enumerate(table):
        fit = LogisticRegression(featuresCol="_x", labelCol="y", weightCol="_w", standardization=False, regParam=1 / (own * n), maxIter=1000, tol=1e-14).fit(L._vectors(L.balanced_weights(train, "y"), f))
        one = L.logistic_head(train, valid, f, "y", (own,))[1]
        assert one.weights == pytest.approx(list(fit.coefficients), abs=1e-5) and one.intercept == pytest.approx(fit.intercept, abs=1e-5)
        assert ap == pytest.approx(rank_metrics.pooled(L.score_with(fit, valid, f), "y", "score").first()["ap"], abs=1e-6)
    assert c == max(table, key=lambda t: (t[1], -t[0]))[0] and [t[0] for t in table] == [0.01, 0.1, 1.0, 10.0]


def test_logistic_head_of_odd_tables(spark):
    """Separable and constant columns, one class, and values that no head may take."""
    make = lambda rows: spark.createDataFrame(rows, "a double, b double, y int")
    apart = make([(float(k), 1.0, int(k >= 20)) for k in range(40)])
    _, model, table = L.logistic_head(apart, apart, ["a", "b"], "y", (1.0, 1e6))
    assert [t[1] for t in table] == [1.0, 1.0] and model.weights[0] > 0 and model.weights[1] == pytest.approx(0, abs=1e-3)
    for label in (0, 1):
        _, model, table = L.logistic_head(make([(1.0, 2.0, label), (2.0, 2.0, label)]), apart, ["a", "b"], "y", (1.0,))
        assert {r.score for r in L.score_with(model, apart, ["a", "b"]).collect()} == {float(label)} and table[0][1] == 0.5
    for odd in ((None, 1.0, 1), (math.nan, 1.0, 1), (1.0, math.inf, 0), (1.0, 1.0, 2), (1.0, 1.0, None)):
        with pytest.raises(Exception, match="finite"):
            L.logistic_head(apart.unionByName(make([odd])), apart, ["a", "b"], "y", (1.0,))
    with pytest.raises(Exception, match="finite"):
        L.logistic_head(apart, apart.unionByName(make([(None, 1.0, 1)])), ["a", "b"], "y", (1.0,))


def _two_columns(spark, n=24_000):
    u, v, w = F.col("id") * 7919 % 41, F.col("id") * 104_729 % 43, F.col("id") * 31 % 23
    return spark.range(n).select("id", (u / 41).alias("a"), (v / 43).alias("b"), F.lit(2.0).alias("same"), ((u * 2 + v + w) > 75).cast("int").alias("y"))


def test_boosted_grid_looks_at_all_rows_whatever_their_layout(spark):
    df, f = _two_columns(spark), ["a", "b", "same"]
    got = []
    for parts in (2, 5):
        rows = df.repartition(parts)
        setting, model, table = L.boosted_grid(rows.where("id % 3 > 0"), rows.where("id % 3 = 0"), f, "y", depths=(2,), steps=(0.3,), trees=3)
        got.append((setting, table, {r.id: r.score for r in L.score_with(model, df, f).collect()}))
        assert L.score_with(model, df, f).columns == [*df.columns, "score"]
    (s, t, p), (r, u, q) = got
    assert s == r and [x[-1] for x in t] == pytest.approx([x[-1] for x in u], abs=1e-9) and len(p) == 24_000
    assert all(p[k] == pytest.approx(q[k], abs=1e-9) for k in p)
    plain = rank_metrics.pooled(L.score_with(model, df, f), "y", "score").first()
    assert tuple(L.pooled_scores(model, df, f, "y").first()) == pytest.approx(tuple(plain)) and plain.n == 24_000 and plain.auroc > 0.8


def test_boosted_grid_of_equal_bins_is_that_of_all_rows(spark):
    """Bins with their numbers give the trees of the rows themselves, weighted or not; values that are no numbers stop the job."""
    df, f = _two_columns(spark, 6000), ["a", "b"]
    train, valid = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    for weighted in (False, True):
        _, model, table = L.boosted_grid(train, valid, f, "y", depths=(2,), steps=(0.3,), balanced=(weighted,), trees=3)
        rows, held = (L.balanced_weights(L._binned(d, f, model.cuts)[0].drop(*f), "y") for d in (train, valid))
        every = L.boosted_head(rows, ["_bin0", "_bin1"], "y", 3, 2, 0.3, held, "_w" if weighted else None)
        want = {r.id: r.score for r in L.score_with(every, held, ["_bin0", "_bin1"]).collect()}
        got = {r.id: r.score for r in L.score_with(model, valid, f).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
        assert table[0][-1] == pytest.approx(rank_metrics.pooled(L.score_with(every, held, ["_bin0", "_bin1"]), "y", "score").first()["ap"])
    lower, _ = L._binned(spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 7.0)], "a double"), ["a"], [[0.0, 1.0]])
    assert [r._bin0 for r in lower.orderBy("a").collect()] == [0, 0, 1, 1, 2]
    for odd in (None, math.nan):
        with pytest.raises(Exception):  # noqa: B017  Spark's own
            L.boosted_grid(train.unionByName(spark.createDataFrame([(1, odd, 1.0, 2.0, 1)], train.schema)), valid, f, "y", depths=(2,), steps=(0.3,), trees=2)
