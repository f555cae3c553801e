"""Operators against plain implementations on small tables, and the traps of their semantics."""

import collections
import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import calibration, cohorts, features, matching, rank_metrics, resample
from quern.sources import files, sinks


def plain_ap(y, s):
    positives, total, last, tp, n, area = sum(y), len(y), 0.0, 0, 0, 0.0
    if not positives:
        return None
    for _, rows in itertools.groupby(sorted(zip(s, y), reverse=True), key=lambda r: r[0]):
        rows = list(rows)
        tp, n = tp + sum(r[1] for r in rows), n + len(rows)
        area += (tp / positives - last) * tp / n
        last = tp / positives
    assert n == total
    return area


def plain_auroc(y, s):
    pos, neg = [a for a, b in zip(s, y) if b], [a for a, b in zip(s, y) if not b]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, int(rng.random() < 0.3) if g else 0, float(rng.integers(0, 6)), float(rng.random())) for g in range(5) for i in range(40)]
    return rows, spark.createDataFrame(rows, "g int, idx int, y int, s double, p double").cache()


def test_ap_and_auroc_merge_ties(items):
    rows, df = items
    ap = {r["g"]: r["ap"] for r in rank_metrics.average_precision(df, ["g"], "y", "s").collect()}
    au = {r["g"]: r["auroc"] for r in rank_metrics.auroc(df, ["g"], "y", "s").collect()}
    for g in range(5):
        y, s = [r[2] for r in rows if r[0] == g], [r[3] for r in rows if r[0] == g]
        for got, want in ((ap[g], plain_ap(y, s)), (au[g], plain_auroc(y, s))):
            assert got == pytest.approx(want) if want is not None else got is None


def test_pooled_equals_one_ranking(items):
    rows, df = items
    for score, k in (("s", 3), ("p", 4)):
        got = rank_metrics.pooled(df, "y", score, pieces=7).first()
        assert got["ap"] == pytest.approx(plain_ap([r[2] for r in rows], [r[k] for r in rows]))
        assert got["auroc"] == pytest.approx(plain_auroc([r[2] for r in rows], [r[k] for r in rows]))


def test_recall_divides_by_all_positives(spark):
    df = spark.createDataFrame([(0, i, int(i < 20), float(-i)) for i in range(30)], "g int, idx int, y int, s double")
    r = rank_metrics.top_metrics(df, ["g"], "y", "s", ["idx"], (10,)).first()
    assert (r["recall_at_10"], r["precision_at_10"], r["iou_at_p"], r["hit_at_1"]) == (0.5, 1.0, 1.0, 1.0)


def test_metrics_without_positives_are_null(spark):
    df = spark.createDataFrame([(0, i, 0, float(i)) for i in range(4)], "g int, idx int, y int, s double")
    assert rank_metrics.average_precision(df, ["g"], "y", "s").first()["ap"] is None
    r = rank_metrics.top_metrics(df, ["g"], "y", "s", ["idx"]).first()
    assert r["recall_at_5"] is None and r["iou_at_p"] is None and r["hit_at_5"] is None


def test_group_rank_of_one_row_is_a_half(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0), (1, 2.0)], "g int, v double")
    got = sorted(df.select("g", rank_metrics.group_rank(["g"], ["v"]).alias("r"), rank_metrics.group_zscore(["g"], "v").alias("z")).collect())
    assert [tuple(r) for r in got] == [(0, 0.5, 0.0), (1, 0.0, -1.0), (1, 1.0, 1.0)]


def test_ece_by_hand(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 0, 1.0), (0, 0, 0.0), (0, 0, 0.05)], "g int, y int, p double")
    assert calibration.ece(df, ["g"], "y", "p").first()["ece"] == pytest.approx(0.5 * 0.5 + 0.5 * 0.025)


def test_constant_difference_collapses_intervals(spark):
    df = spark.createDataFrame([(i, i % 3, 0.1) for i in range(6)], "id bigint, c bigint, delta double")
    for r in (resample.paired_bootstrap(df, "id", "delta", 50, "s").first(), resample.cluster_bootstrap(df, "c", "delta", 50, "s").first()):
        assert (r["low"], r["high"], r["part_above"]) == (pytest.approx(0.1), pytest.approx(0.1), 1.0)


def test_resampled_keeps_number_of_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(17)], "id bigint")
    totals = resample.resampled(df, "id", 30, "x").groupBy("b").agg(F.sum("times").alias("n")).collect()
    assert len(totals) == 30 and {r["n"] for r in totals} == {17}


def test_line_matching_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.random(rng.integers(1, 4)), rng.random(rng.integers(1, 6))
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        best = min(sum(abs(short[i] - long[j]) for i, j in enumerate(p)) for p in itertools.permutations(range(len(long)), len(short)))
        pairs = matching.match_on_line(a, b)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(short)
        assert sum(abs(a[i] - b[j]) for i, j in pairs) == pytest.approx(best)
    assert matching.match_on_line(np.zeros(0), np.ones(3)) == []


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    pts = [(g, i, *map(float, rng.uniform(-5, 5, 3))) for g in range(2) for i in range(60)]
    df = spark.createDataFrame(pts, "g int, id int, x double, y double, z double")
    got = {(r["g"], r["a_key"], r["b_key"]) for r in features.pairs_within(df, "g", "id", 2.0).collect()}
    assert got == {(a[0], a[1], b[1]) for a in pts for b in pts if a[0] == b[0] and a[1] != b[1] and math.dist(a[2:], b[2:]) <= 2.0}
    near = features.nearest_within(df.where("id < 20"), df.where("id >= 20"), "g", 2.0).collect()
    for r in near:
        p = next(a for a in pts if a[:2] == (r["g"], r["id"]))
        assert r["distance"] == pytest.approx(min(math.dist(p[2:], b[2:]) for b in pts if b[0] == r["g"] and b[1] >= 20))


def test_type_removal_makes_shared_columns_anew(spark):
    df = spark.createDataFrame([(0, 0, float(i), float(i), 0.99, 0.2, 0.2, 0.2, 0.2) for i in range(6)], "g int, res int, d double, e double, c1 double, c2 double, c3 double, c4 double, c5 double")
    residues = spark.createDataFrame([(0, 0), (0, 1)], "g int, res int")
    whole = features.typed_features(residues, df, ["g", "res"], ["c1", "c2", "c3", "c4", "c5"], "d", "e")
    less = features.typed_features(residues, df, ["g", "res"], ["c2", "c3", "c4", "c5"], "d", "e")
    assert (len(whole.columns) - 2, len(less.columns) - 2) == (48, 45)
    a, b = {r["res"]: r for r in whole.collect()}, {r["res"]: r for r in less.collect()}
    assert (a[0]["any_max"], b[0]["any_max"], a[1]["any_max"], a[1]["log_pairs"]) == (0.99, 0.2, 0.0, 0.0)


def test_spatial_features_of_one_residue(spark):
    r = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 0.7, 3.0)], "g int, id int, x double, y double, z double, s double, l double")
    f = features.spatial_features(r, "g", "id", "s", "l")
    got = f.first()
    assert len(f.columns) == 27 and got["nearest_6"] == got["knn8_distance"] == 80.0 and got["n_12"] == got["knn3_max"] == 0.0


def test_describe_and_label_overlap_edges(spark):
    df = spark.createDataFrame([(0, 1.0, 0, 0), (1, 2.0, 1, 0), (1, 4.0, 1, 1)], "g int, v double, a int, b int")
    d = {r["g"]: r for r in cohorts.describe(df, ["g"], "v").collect()}
    assert d[0]["sd"] == 0.0 and d[1]["sd"] == pytest.approx(math.sqrt(2))
    o = {r["g"]: r for r in cohorts.label_overlap(df, ["g"], "a", "b").collect()}
    assert o[0]["jaccard"] == 1.0 and (o[1]["jaccard"], o[1]["disagreements"]) == (0.5, 1)


def test_many_to_one_refuses_repeated_keys(spark):
    a = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        cohorts.many_to_one(a, spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), ["k"])


def test_pdb_lines(spark):
    lines = [
        "HEADER    X",
        "ATOM      1  CA  ALA A  10A     11.104   6.134  -6.504  1.00  0.00           C",
        "HETATM    2  O1  LIG B   1       1.000   2.000   3.000  1.00  0.00           O",
        "ATOM      x  CA  ALA A  10      11.104   6.134  -6.504",
    ]
    got = files.parse_pdb(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")).orderBy("line_no").collect()
    assert [(r["serial"], r["resname"], r["chain"], r["resnr"], r["x"], r["element"]) for r in got] == [(1, "ALA", "A", "10A", 11.104, "C"), (2, "LIG", "B", "1", 1.0, "O")]


def test_markdown_and_json(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double")
    assert sinks.to_markdown(df, 2) == "| k | v |\n|---|---|\n| a | 0.50 |\n| b | NA |"
    assert sinks.to_json(df) == '[{"k": "a", "v": 0.5}, {"k": "b", "v": null}]'


def test_entry_and_guards(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nearest_k_equals_all_pairs(spark):
    rng = random.Random(5)
    rows = [(g, 100 * g + i, rng.choice([0.0, 3.0, rng.uniform(-80, 80)]), rng.uniform(-2, 2), float(rng.randrange(3))) for g, n in ((1, 40), (2, 3), (3, 1)) for i in range(n)]
    points = spark.createDataFrame(rows, "g int, id int, x double, y double, z double")
    got = sorted((r["g"], r["a_key"], r["k"], r["b_key"]) for r in features.nearest_k(points, "g", "id", 4, 0.5).collect())
    want = []
    for g, i, *p in rows:
        near = sorted((math.dist(p, q), j) for h, j, *q in rows if h == g and j != i)[:4]
        want += [(g, i, k, j) for k, (_, j) in enumerate(near, 1)]
    assert got == sorted(want)


def test_running_sums_equal_one_window(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "b"]), float(rng.randrange(40)), i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, i int, n int")
    for down in (True, False):
        got = {r["i"]: r["s"] for r in rank_metrics.running_sums(df, ["g"], "v", {"s": "n"}, ("i",), down, pieces=7).collect()}
        for g, v, i, _ in rows:
            assert got[i] == sum(m for h, w, j, m in rows if h == g and ((w > v if down else w < v) or (w == v and j <= i)))


def test_ap_and_auroc_agree_with_the_separate_metrics(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(rng.randrange(4), rng.randrange(2), rng.randrange(30) / 30) for _ in range(600)] + [(9, 1, 0.5), (8, 0, 0.5)], "g int, y int, s double")
    both = {r["g"]: r for r in rank_metrics.ap_and_auroc(df, ["g"], "y", "s", 5).collect()}
    for r in rank_metrics.average_precision(df, ["g"], "y", "s").join(rank_metrics.auroc(df, ["g"], "y", "s"), "g").collect():
        assert both[r["g"]]["ap"] == pytest.approx(r["ap"]) and both[r["g"]]["auroc"] == pytest.approx(r["auroc"])
    pieced = {r["g"]: r["ap"] for r in rank_metrics.average_precision(df, ["g"], "y", "s", pieces=5).collect()}
    assert all(pieced[g] == pytest.approx(r["ap"]) for g, r in both.items())


def test_validated_pairs_refuse_what_is_not_a_pair(spark):
    ok = [(1, 0.0, 1.0), (2, 0.5, 0.25)]
    make = lambda rows: spark.createDataFrame(rows, "id int, a double, b double")
    assert resample.validated_pairs(make(ok), "id", ["a", "b"]).count() == 2
    for bad in ([], [*ok, (2, 0.1, 0.1)], [*ok, (None, 0.1, 0.1)], [*ok, (3, float("nan"), 0.1)], [*ok, (3, None, 0.1)], [*ok, (3, 0.1, 1.5)], [*ok, (3, -0.1, 0.5)], [*ok, (3, float("inf"), 0.5)]):
        with pytest.raises(ValueError):
            resample.validated_pairs(make(bad), "id", ["a", "b"])


def test_matching_of_long_sides_is_linear_in_memory():
    rng = np.random.default_rng(2)
    a, b = rng.uniform(size=1500), rng.uniform(size=4000)
    tracemalloc.start()
    pairs = matching.match_on_line(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len({i for i, _ in pairs}) == 1500 == len({j for _, j in pairs}) and most < 8_000_000


def test_matched_pair_queries_equal_brute_force(spark):
    """All of the query's table: each complex's matching by a plain table over sorted distances."""
    from quern.plans import fixtures, registry

    sf = "/root/testdata/sf0.001"
    rows = fixtures.ranked_items(spark, sf).where("d <= 8").select("g", "y", "d", "sb").collect()
    least = {}
    for g in {r["g"] for r in rows}:
        x, y = (sorted(r["d"] for r in rows if r["g"] == g and r["y"] == v) for v in (1, 0))
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        cost = [[0.0] * (len(y) + 1)]
        for i, v in enumerate(x):
            cost.append([math.inf] + [0.0] * len(y))
            for j, w in enumerate(y):
                cost[-1][j + 1] = min(cost[-1][j], cost[-2][j] + abs(v - w))
        least[g] = cost[-1][-1], len(x)
    near = fixtures.ranked_items(spark, sf).where("d <= 8")
    got = matching.matched_pairs(near, "g", "y", "d", "sb", math.inf).groupBy("g").agg(F.sum("gap").alias("cost"), F.count("*").alias("n")).collect()
    assert {r["g"]: (pytest.approx(r["cost"]), r["n"]) for r in got} == {g: v for g, v in least.items() if v[1]}
    pairs = {r["g"]: r for r in registry.QUERIES["r11_match_pairs"](spark, sf).collect()}
    kept = matching.matched_pairs(near, "g", "y", "d", "sb", 0.5).collect()
    assert {g: r["pairs"] for g, r in pairs.items()} == dict(collections.Counter(r["g"] for r in kept))
    assert all(r["gap"] <= 0.5 for r in kept)
    effects = registry.QUERIES["r12_matched_effects"](spark, sf).first()
    mean = sum(r["accuracy"] - 0.5 for r in pairs.values()) / len(pairs)
    assert effects["low"] <= mean <= effects["high"] and effects["replicates"] == 200


def test_boosted_grid_and_out_of_fold_find_a_signal(spark):
    from quern.operators import learning

    rng = random.Random(3)
    rows = [(i % 30, i, int((x := rng.random()) + rng.gauss(0, 0.15) > 0.6), x, rng.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, i int, y int, v double, noise double")
    setting, model, table = learning.boosted_grid(df.where("g % 3 = 0"), df.where("g % 3 = 1"), ["v", "noise"], "y", depths=(2,), steps=(0.3,), trees=8)
    assert len(table) == 2 and max(ap for *_, ap in table) == dict(((d, s, w), ap) for d, s, w, ap in table)[setting]
    assert rank_metrics.pooled(learning.score_with(model, df.where("g % 3 = 2"), ["v", "noise"]), "y", "score").first()["auroc"] > 0.9
    fit = lambda train, features, label: learning.boosted_head(train, features, label, trees=3, depth=2)
    out = learning.out_of_fold(df, ["g", "i"], "g", "y", ["v", "noise"], fit, folds=3, repeats=2)
    both = out.join(df.select("i", "y"), "i")
    assert both.count() == 900 and both.where("repeats = 2").count() == 900
    assert rank_metrics.pooled(both, "y", "score").first()["auroc"] > 0.9


def test_set_network_gradient_equals_differences_and_order_does_not_matter():
    from quern.operators import networks as N

    rng = np.random.default_rng(4)
    weights = N.start(3, 4, 2)
    x, first = rng.normal(size=(9, 3)), np.array([0, 1, 4, 9])
    y, mask = (rng.integers(0, 2, (3, 2)).astype(float) for _ in range(2))
    mask[0] = 1
    loss, grads = N.gradient(weights, x, first, y, mask)
    for i, grad in enumerate(grads):
        for k in range(grad.size):
            up, down = ([w.copy() for w in weights] for _ in range(2))
            up[i].reshape(-1)[k] += 1e-6
            down[i].reshape(-1)[k] -= 1e-6
            assert grad.reshape(-1)[k] == pytest.approx((N.gradient(up, x, first, y, mask)[0] - N.gradient(down, x, first, y, mask)[0]) / 2e-6, abs=1e-4)
    mixed = np.concatenate([x[:1], x[1:4][::-1], x[4:][[3, 1, 0, 4, 2]]])
    assert np.allclose(N.forward(weights, x, first)[0], N.forward(weights, mixed, first)[0])


def test_set_network_learns_what_means_do_not_show(spark):
    """Sets with one odd member, labelled by it: the learnt layer and the maximum tell them apart."""
    from quern.operators import networks as N

    rng = random.Random(2)
    rows = []
    for i in range(600):
        x = [[rng.uniform(0, 1), rng.uniform(0, 1)] for _ in range(rng.randrange(3, 8))]
        y = i % 2
        x[0] = [1.0, 1.0] if y else [1.0, 0.0]
        rows.append((i, x, [float(y)], [1.0]))
    df = spark.createDataFrame(rows, "key int, " + N.SCHEMA)
    weights, _ = N.fit(df.where("key % 3 = 0"), df.where("key % 3 = 1"), ["key"], 2, 1, steps=60, rate=0.05, look=30)
    assert N.macro_ap(df.where("key % 3 = 2"), weights, ["key"]) > 0.8


def test_heads_score_better_than_chance(spark):
    """Values of the fitted heads' queries, in place of any rows."""
    from quern.plans import registry

    sf = "/root/testdata/sf0.001"
    for name in ("ml2_two_input_head", "ml3_ml4_boosted_head", "ml4_two_input_boosted_head"):
        row = registry.QUERIES[name](spark, sf).first()
        assert 0 <= row["ap"] <= 1 and row["auroc"] > 0.5 and 0 < row["prevalence"] < 1, (name, row)
    for name in ("ml5_pooled_set_head", "ml6_ml8_perceptron_head"):
        row = registry.QUERIES[name](spark, sf).first()
        assert 0 <= row["ap"] <= 1 and 0 < row["prevalence"] < 1, (name, row)
    assert registry.QUERIES["ml6_pair_head"](spark, sf).first()["ap"] > 0.5
    ablated = {r["without"]: r["ap"] for r in registry.QUERIES["ml8_ablated_heads"](spark, sf).collect()}
    assert ablated["none"] > 0.8 and ablated["none"] > ablated["fingerprint"]
    grid = registry.QUERIES["ml1_logistic_head"](spark, sf).collect()
    assert [r["c"] for r in grid] == [0.01, 0.1, 1.0, 10.0] and sum(r["chosen"] for r in grid) == 1
    assert next(r["ap"] for r in grid if r["chosen"]) == max(r["ap"] for r in grid)
    platt = registry.QUERIES["m14_platt"](spark, sf).first()
    assert 0 <= platt["after"] <= 1 and platt["slope"] == platt["slope"]
