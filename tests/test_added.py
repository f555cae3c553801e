"""Operators of the latest round against brute force."""

import math
import random
import time

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from quern.functions import geometry as G
from quern.operators import calibration as C
from quern.operators import features as X
from quern.operators import learning as L
from quern.operators import networks as N
from quern.operators import rank_metrics as M
from quern.operators import resample as R
from quern.operators import selection as S
from quern.operators.matching import match_on_line, matched_by_radius, matched_pairs, sections
from quern.plans import registry
from quern.sources import sinks


def fingerprints(n, seed):
    """Random 2,048-bit sets: families of like ones, common bits that a third have, equal ones, and an empty one."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        base = set(random.Random(k % 7).sample(range(2048), 40)) if k % 3 else set(rng.sample(range(2048), rng.choice([1, 5, 60])))
        for _ in range(rng.choice([0, 3, 15])):
            base ^= {rng.randrange(2048)}
        out.append(base | ({5, 63, 64, 2047} if k % 3 == 1 else set()))
    return [*out, set(), set(out[0])]


@pytest.mark.parametrize("rows", [20_000, 5])
def test_nearest_fingerprint_equals_all_pairs(spark, rows):
    train, asked = fingerprints(120, 1), [*fingerprints(60, 2), {1}, set()]
    make = lambda sets, a, b: spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], f"{a} bigint, bits array<int>").selectExpr(a, "bits").withColumn(b, G.packed_bits("bits")).drop("bits")
    t = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = {}
    for i, s in enumerate(asked):
        m = max(t(s, x) for x in train)
        want[i] = m, min(j for j, x in enumerate(train) if t(s, x) == m)
    got = {r.id: (r.t, r.nearest) for r in S.nearest_fingerprint(make(asked, "id", "w"), make(train, "train", "tw"), rows=rows).collect()}
    assert got == want
    assert S.nearest_fingerprint(make(asked, "id", "w"), make([], "train", "tw")).count() == 0


def test_bits_go_there_and_back(spark):
    sets = fingerprints(20, 3)
    df = spark.createDataFrame([(sorted(s),) for s in sets], "bits array<int>").withColumn("w", G.packed_bits("bits"))
    for r in df.select("bits", "w", G.bit_positions("w").alias("back"), G.bits_set("w").alias("n"), G.tanimoto_words("w", "w").alias("t")).collect():
        assert r.back == r.bits and r.n == len(r.bits) and len(r.w) == 32 and r.t == 1.0


def test_cluster_sign_flip(spark):
    rows = [("a", 1.0), ("a", 2.0), ("b", -0.5), (None, 4.0), ("c", None)]
    got = R.cluster_sign_flip(spark.createDataFrame(rows, "c string, d double"), "c", "d", 400, "s").first()
    assert (got.observed, got.n, got.clusters) == (6.5 / 4, 4, 3)
    # sums 3, -0.5, 4: of the eight sign patterns |null| reaches 6.5 in four (both large ones of one sign, whatever -0.5 has: 7.5, 6.5)
    assert abs(got.p - 0.5) < 0.08
    assert R.cluster_sign_flip(spark.createDataFrame([], "c string, d double"), "c", "d", 20, "s").first().n == 0


def test_nearest_k_ends_on_repeated_keys_and_far_points(spark):
    rows = [("g", 1, 0.0, 0.0, 0.0), ("g", 1, 9.0, 0.0, 0.0), ("g", 2, 1e6, 0.0, 0.0), ("h", 1, 0.0, 0.0, 0.0), ("h", 1, 0.0, 0.0, 0.0), ("g", None, 0.0, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0)]
    got = X.nearest_k(spark.createDataFrame(rows, "g string, id int, x double, y double, z double"), "g", "id", 3, 1.0).collect()
    assert sorted((r.g, r.a_key, r.b_key, r.distance) for r in got) == [("g", 1, 2, 1e6), ("g", 2, 1, 1e6)]


def test_a_cache_is_complete_or_refused(spark):
    source = spark.range(100).selectExpr("id", "id % 3 as k")
    path = sinks.scratch(spark, "cache")
    make = lambda s: s.groupBy("k").count()

    def breaks(s):
        return s.groupBy("k").count().selectExpr("k", "assert_true(k < 0) as x", "count")

    with pytest.raises(ValueError, match="finished"):
        sinks.read_cache(source, path)
    with pytest.raises(Exception, match="k < 0"):
        sinks.write_cache(source, path, "k", breaks)
    with pytest.raises(ValueError, match="finished"):
        sinks.read_cache(source, path)  # what broke off left nothing that is read
    assert sinks.write_cache(source, path, "k", make) == 3
    assert sinks.write_cache(source.repartition(5), path, "k", make) == 0  # the same rows in another order
    changed = source.where("id > 0")
    with pytest.raises(ValueError, match="another input"):
        sinks.read_cache(changed, path)
    assert sinks.write_cache(changed, path, "k", make) == 3
    assert sinks.read_cache(changed, path).agg({"count": "sum"}).first()[0] == 99
    spark.createDataFrame([(7, 7)], "k long, count long").write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="rows that its manifest"):
        sinks.read_cache(changed, path)


@pytest.mark.parametrize("name", ["r3_exact_sign_flip", "snk6_resumable", "r4_cluster_sign_flip"])
def test_whole_tables_at_the_larger_scale(spark, name):
    folder = "/root/testdata/sf0.1"
    duck = duckdb.connect()
    for t in ("supplier", "customer"):
        duck.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    rel = duck.sql(registry.ORACLE[name])
    got, want = registry.QUERIES[name](spark, folder).first(), rel.fetchall()[0]
    assert [got[c] for c in rel.columns] == pytest.approx(list(want), abs=2e-6)


@pytest.mark.parametrize("descending", [True, False])
def test_running_sums_in_pieces(spark, descending):
    """Large and small groups, disjoint ranges, a value that half of a group has, nulls, and a null group."""
    rng = random.Random(9)
    rows = [("a", rng.choice([0.5, rng.random()]), k, 1 + k % 3) for k in range(300)] + [("b", 100 + rng.random(), k, 1) for k in range(150)] + [(None, 7.0, k, 2) for k in range(120)] + [("c", None, 1, 5), ("a", None, 999, 4)]
    df = spark.createDataFrame(rows, "g string, v double, t int, n int")
    want = {}
    for g in {r[0] for r in rows}:
        total = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: ((-1e9 if r[1] is None else r[1]) * (-1 if descending else 1), r[2])):
            total += r[3]
            want[r[:3]] = total
    for size in (7, 40, 10_000):
        got = M.running_sums(df, ["g"], "v", {"s": "n"}, ("t",), descending, rows=size).collect()
        assert {(r.g, r.v, r.t): r.s for r in got} == want and len(got) == len(rows)
        placed, cut = M.in_pieces(df, ["g"], "v", ("t",), size)
        assert cut == (size < 300)
        if cut:  # pieces hold about as many rows as asked, also where a value repeats
            assert placed.groupBy("g", "_piece", "_sub").count().agg({"count": "max"}).first()[0] <= 3 * size


def least_cost(a, b):
    """Of matching all of the shorter side in order, by a table."""
    a, b = sorted((sorted(a), sorted(b)), key=len)
    cost = [0.0] * (len(b) + 1)
    for v in a:
        new = [math.inf]
        for j, w in enumerate(b):
            new.append(min(new[-1], cost[j] + abs(v - w)))
        cost = new
    return min(cost) if a else 0.0


def test_regret_matching_is_optimal_and_fast():
    rng = random.Random(3)
    for _ in range(1500):
        scale = rng.choice([3, 10, 1000])
        a, b = ([rng.randrange(scale) / 4 for _ in range(rng.randrange(9))] for _ in range(2))
        pairs = match_on_line(np.array(a), np.array(b))
        assert len(pairs) == min(len(a), len(b)) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        assert math.isclose(sum(abs(a[i] - b[j]) for i, j in pairs), least_cost(a, b), abs_tol=1e-9)
    times = []
    for n in (20_000, 80_000):
        a, b = np.random.default_rng(n).random((2, n))
        start = time.perf_counter()
        match_on_line(a, b)
        times.append(time.perf_counter() - start)
    assert times[1] < 10 * times[0]  # n x m would be 16 times


@pytest.mark.parametrize("share", [0.1, 0.45, 0.8])
def test_matching_in_sections_loses_nothing(spark, share):
    rng = random.Random(int(share * 100))
    rows = [("large", int(rng.random() < share), round(rng.random() * 40, 2), rng.random()) for _ in range(1500)]
    rows += [("small", k % 2, float(k), 0.5) for k in range(9)] + [("one", 1, 1.0, 1.0), (None, 0, 2.0, 0.0), (None, 1, 2.5, 0.0), ("small", 1, None, 0.5), ("small", None, 3.0, 0.5)]
    df = spark.createDataFrame(rows, "g string, y int, d double, s double")
    parts = sections(df.where("d is not null and y is not null"), "g", "y", "d", ["s"], rows=60)
    assert parts.where("g = 'large'").select("_section").distinct().count() > (1 if share != 0.45 else 0)
    got = matched_pairs(df, "g", "y", "d", "s", None, rows=60).collect()
    for g in ("large", "small", "one", None):
        pos, neg = ([r[2] for r in rows if r[0] == g and r[1] == y and r[2] is not None] for y in (1, 0))
        own = [r for r in got if r.g == g]
        assert len(own) == min(len(pos), len(neg))
        assert math.isclose(sum(r.gap for r in own), least_cost(pos, neg), abs_tol=1e-6)


def test_radii_and_calipers_from_one_matching(spark):
    rng = random.Random(8)
    rows = [(k % 3, int(rng.random() < 0.4), rng.random() * 9, rng.random(), rng.random()) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, y int, d double, u double, v double")
    got = matched_by_radius(df, "g", "y", "d", ["u", "v"], (6.0, 8.0), (0.05, 0.5)).collect()
    for radius in (6.0, 8.0):
        each = matched_pairs(df.where(f"d <= {radius}"), "g", "y", "d", ["u", "v"], None).collect()
        for caliper in (0.05, 0.5):
            want = sorted((r.g, r.gap, r.u_won, r.v_won) for r in each if r.gap <= caliper)
            assert want and sorted((r.g, r.gap, r.u_won, r.v_won) for r in got if (r.radius, r.caliper) == (radius, caliper)) == want


@pytest.mark.parametrize("kinds", [200_000, 3])
def test_even_folds_of_skewed_groups(spark, monkeypatch, kinds):
    monkeypatch.setattr(L, "KINDS", kinds)
    rng = random.Random(5)
    rows = []
    for g in range(160):
        n = int(min(400, rng.paretovariate(0.9)) * 2)
        share = rng.choice([0.0, 0.05, 0.3, 0.9])
        rows += [(f"g{g}", int(rng.random() < share)) for _ in range(n)]
    rows += [(None, 1)] * 3
    df = spark.createDataFrame(rows, "g string, y int")
    folds = {r.g: r.fold for r in L.even_folds(df, "g", "y", 5, "s").collect()}
    assert set(folds) == {r[0] for r in rows} and set(folds.values()) == set(range(5))
    for y in (0, 1):
        own = [sum(1 for g, v in rows if v == y and folds[g] == f) for f in range(5)]
        largest = max(sum(1 for g, v in rows if v == y and g == name) for name in folds)
        assert max(own) - min(own) <= largest, (y, own, largest)
    again = {r.g: r.fold for r in L.even_folds(df.repartition(7), "g", "y", 5, "s").collect()}
    assert again == folds != {r.g: r.fold for r in L.even_folds(df, "g", "y", 5, "t").collect()}


def test_minibatches_learn_and_end(spark):
    rng = np.random.default_rng(2)

    def rows(n, seed):
        rng = np.random.default_rng(seed)
        out = []
        for k in range(n):
            x = rng.normal(size=(rng.integers(1, 6), 3))
            out.append((k, x.tolist(), [float(x[:, 0].max() > 1.2)], [1.0]))
        return spark.createDataFrame(out, "k int, " + N.SCHEMA)

    train, valid, test = rows(1500, 1).repartition(3), rows(400, 2), rows(800, 3)
    weights, trace = N.fit_minibatches(train, valid, ["k"], 3, 1, ((8, 0.02), (4, 0.0)), epochs=8, patience=2, batch_sets=64)
    share = np.mean([r.y[0] for r in test.collect()])
    assert N.macro_ap(test, weights, ["k"]) > share + 0.4
    assert [t["epoch"] for t in trace if t["rate"] == 0.0] == [1, 2, 3]  # nothing moves: ended by patience
    first = [t for t in trace if t["rate"] > 0]
    assert first[-1]["loss"] < first[0]["loss"]
    again, _ = N.fit_minibatches(train, valid, ["k"], 3, 1, ((8, 0.02),), epochs=2, batch_sets=64)
    once, _ = N.fit_minibatches(train, valid, ["k"], 3, 1, ((8, 0.02),), epochs=2, batch_sets=64)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(again, once))


def test_sets_are_read_from_buffers():
    import pyarrow as pa

    x = [[[1.0, 2.0]], [[3.0, 4.0], [5.0, 6.0]], [[7.0, 8.0]]]
    batch = pa.RecordBatch.from_arrays([pa.array(x)], ["x"])
    for cut in (batch, batch.slice(1)):
        members, first = N._sets(cut)
        assert members.tolist() == [m for s in cut.column("x").to_pylist() for m in s]
        assert first.tolist() == np.cumsum([0, *map(len, cut.column("x").to_pylist())]).tolist()


@pytest.mark.parametrize("name", ["ml4_leafwise_two_input", "ml5_minibatch_set_head", "ml2_two_input_head", "ml3_ml4_boosted_head"])
def test_heads_beat_chance(spark, name):
    r = registry.QUERIES[name](spark, "/root/testdata/sf0.001").first()
    assert r.ap > r.prevalence + 0.02, r


def test_perceptron_beats_chance_and_platt_lowers_the_error(spark):
    r = registry.QUERIES["ml6_ml8_perceptron_head"](spark, "/root/testdata/sf0.001").first()
    assert r.ap > r.prevalence + 0.05 and r.auroc > 0.55, r
    platt = registry.QUERIES["m14_platt"](spark, "/root/testdata/sf0.001").first()
    assert platt.after < platt.before / 2, platt


def test_measured_repeats_and_records(spark):
    from quern.measure import measured

    calls = []
    got = measured(spark, lambda: calls.append(spark.range(50_000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count().collect()), repeats=4, warm=2)
    assert len(calls) == 6 and got["repeats"] == 4 and got["sd"] is not None
    assert got["jobs"] >= 1 and got["tasks"] >= 5 and got["shuffle_mb"] > 0 and got["task_s"] >= 0 and got["peak_mb"] >= 0
    once = measured(spark, lambda: calls.append(time.sleep(0.2)), repeats=9, most_s=0.3)
    assert once["repeats"] == 2 and once["tasks"] == 0
    assert measured(spark, lambda: None, repeats=1)["sd"] is None


@pytest.mark.parametrize("rows", [4000, 6])
def test_neighbours_in_uneven_density(spark, monkeypatch, rows):
    """A crowd, some points at one place, and far ones: pairs, nearest targets and nearest k equal brute force, also where cubes are dealt in blocks."""
    monkeypatch.setattr(X, "CUBE_ROWS", rows)
    rng = np.random.default_rng(4)
    xyz = np.concatenate([rng.normal(0, 0.4, (60, 3)), np.ones((9, 3)) * 0.5, rng.normal(0, 30, (25, 3))])
    group = ["g" if k % 4 else "h" for k in range(len(xyz))]
    df = spark.createDataFrame([(g, k, *map(float, p)) for k, (g, p) in enumerate(zip(group, xyz))], "g string, id int, x double, y double, z double")
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    near = {(r.a_key, r.b_key) for r in X.pairs_within(df, "g", "id", 2.0).collect()}
    assert near == {(a, b) for a in range(len(xyz)) for b in range(len(xyz)) if a != b and group[a] == group[b] and d[a, b] <= 2.0}
    got = {(r.a_key, r.k): r.distance for r in X.nearest_k(df, "g", "id", 3, 2.0).collect()}
    for a in range(len(xyz)):
        others = sorted(d[a, b] for b in range(len(xyz)) if b != a and group[b] == group[a])
        assert [got[a, k] for k in (1, 2, 3)] == pytest.approx(others[:3])
    found = {r.id: (r.target, r.distance) for r in X.nearest_within(df.where("id % 3 = 0"), df.where("id % 3 > 0"), "g", 2.0).collect()}
    for a in range(0, len(xyz), 3):
        options = sorted((d[a, b], b) for b in range(len(xyz)) if b % 3 and group[b] == group[a] and d[a, b] <= 2.0)
        assert (a in found) == bool(options) and (not options or found[a][1] == pytest.approx(options[0][0]))


def test_platt_calibration_lowers_the_error(spark):
    rng = np.random.default_rng(6)
    z = rng.normal(0, 1.2, 3000)
    y = rng.random(3000) < 1 / (1 + np.exp(-(z - 0.5)))
    df = spark.createDataFrame([(int(a), float(3 * b)) for a, b in zip(y, z)], "y int, z double")  # three times too sure, and off by a half
    slope, intercept = C.platt(df, "y", "z")
    assert abs(slope - 1 / 3) < 0.05 and abs(intercept + 0.5) < 0.15
    error = lambda p: C.ece(df.withColumn("p", p), [], "y", "p").first()["ece"]
    assert error(C.sigmoid(F.col("z") * slope + intercept)) < 0.3 * error(C.sigmoid(F.col("z")))
