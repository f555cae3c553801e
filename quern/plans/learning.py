"""Fusion heads: fitted models are checked by rows and invariants, plain expressions by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import learning as L
from ..operators import networks as N
from ..operators import rank_metrics
from ..sources.sinks import scratch
from .fixtures import ITEMS, ranked_items, table
from .registry import query


def _matrix(spark, sf_dir):
    d = F.col("d")
    i = ranked_items(spark, sf_dir).select("g", "idx", ((F.col("y") == 1) != (F.col("d") < 10)).cast("int").alias("y"), F.col("sa").alias("v"), F.exp(-d / 12).alias("prior"), (1 / (1 + d)).alias("inverse"), (F.col("sb") / 1e5).alias("price"))
    return i.where("g % 3 = 0"), i.where("g % 3 = 1"), i.where("g % 3 = 2")


@query()
def ml1_logistic_head(spark, sf_dir):
    """C and validation AP of each head of the grid, and which is chosen."""
    train, valid, _ = _matrix(spark, sf_dir)
    features = ["v", "prior", "inverse", "price"]
    own = L.moments(train, features)
    c, _, table_ = L.logistic_head(L.standardised(train, features, own), L.standardised(valid, features, own), features, "y")
    return spark.createDataFrame([(a, float(b), a == c) for a, b in table_], "c double, ap double, chosen boolean")


@query()
def ml2_two_input_head(spark, sf_dir):
    """Test AP of a head on [score, prior]."""
    train, valid, test = _matrix(spark, sf_dir)
    f = ["v", "prior"]
    own = L.moments(train, f)
    c, model, _ = L.logistic_head(L.standardised(train, f, own), L.standardised(valid, f, own), f, "y")
    return rank_metrics.pooled(L.score_with(model, L.standardised(test, f, own), f), "y", "score").withColumn("c", F.lit(c))


@query()
def ml3_ml4_boosted_head(spark, sf_dir):
    """Test AP of boosted trees chosen on validation AP over depths, steps and class weights, and the choice."""
    train, valid, test = _matrix(spark, sf_dir)
    f = ["v", "prior", "inverse", "price"]
    (depth, step, balanced), model, _ = L.boosted_grid(train, valid, f, "y", depths=(2, 3), steps=(0.3,), trees=5)
    return L.pooled_scores(model, test, f, "y").select("*", F.lit(depth).alias("depth"), F.lit(step).alias("step"), F.lit(balanced).alias("balanced"))


@query()
def ml4_two_input_boosted_head(spark, sf_dir):
    """The same on [score, prior] alone."""
    train, valid, test = _matrix(spark, sf_dir)
    f = ["v", "prior"]
    (depth, step, balanced), model, _ = L.boosted_grid(train, valid, f, "y", depths=(2,), steps=(0.1, 0.3), balanced=(True,), trees=5)
    return L.pooled_scores(model, test, f, "y").select("*", F.lit(depth).alias("depth"), F.lit(step).alias("step"), F.lit(balanced).alias("balanced"))


@query()
def ml3_leafwise_grid(spark, sf_dir):
    """Leaf-wise boosting over leaves, least rows, L2 and class weights: validation AP of each setting, which is chosen, and its test AP."""
    train, valid, test = _matrix(spark, sf_dir)
    f = ["v", "prior", "inverse", "price"]
    chosen, model, table_ = B.grid(train, valid, f, "y", ((7, 20, 1.0), (15, 20, 10.0)), rounds=8, rate=0.3, bins=32)
    ap = rank_metrics.pooled(B.scored(test, model), "y", "score").first()["ap"]
    rows = [(leaves, least, l2, weighted, float(valid_ap), (leaves, least, l2, weighted) == chosen, float(ap)) for leaves, least, l2, weighted, valid_ap in table_]
    return spark.createDataFrame(rows, "leaves int, least_rows int, l2 double, balanced boolean, valid_ap double, chosen boolean, test_ap double")


@query()
def ml4_leafwise_two_input(spark, sf_dir):
    """Test AP of leaf-wise boosting on [score, prior], saved and loaded before it scores."""
    train, valid, test = _matrix(spark, sf_dir)
    path = scratch(spark, "model")
    B.fit(train, ["v", "prior"], "y", leaves=8, rounds=8, rate=0.3, valid=valid, bins=32).save(spark, path)
    model = B.load(spark, path)
    return rank_metrics.pooled(B.scored(test, model), "y", "score").withColumn("trees", F.lit(len(model.trees)))


@query()
def ml5_pooled_set_head(spark, sf_dir):
    """A perceptron on mean and max pools of encoded pairs."""
    p = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as g", "l_partkey % 20 as res", "l_quantity / 5 as d", "l_discount * 10 as c1", "l_tax * 12 as c2", "l_returnflag")
    d = F.col("d")
    x = L.pooled_set(p, ["g", "res"], ["c1", "c2"], [F.exp(-d / 2), F.exp(-d / 6)])
    y = p.groupBy("g", "res").agg((F.avg((F.col("l_returnflag") == "R").cast("int")) > 0.33).cast("int").alias("y"))
    rows = x.join(y, ["g", "res"])
    f = [c for c in x.columns if c not in ("g", "res")]
    train, test = rows.where("g % 2 = 0"), rows.where("g % 2 = 1")
    model = L.perceptron_head(L.standardised(train, f, train), f, "y", rounds=20)
    return rank_metrics.pooled(L.score_with(model, L.standardised(test, f, train), f), "y", "score")


@query()
def ml6_ml8_perceptron_head(spark, sf_dir):
    train, _, test = _matrix(spark, sf_dir)
    f = ["v", "prior", "inverse", "price"]
    model = L.perceptron_head(L.standardised(train, f, train), f, "y", rounds=20)
    return rank_metrics.pooled(L.score_with(model, L.standardised(test, f, train), f), "y", "score")


@query()
def ml5_set_head(spark, sf_dir):
    """Test AP of a network on the set of a residue's pairs: a layer of each pair, mean and maximum, a layer, the best step on validation AP."""
    d = F.col("l_quantity") / 5
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("g"), (F.col("l_partkey") % 20).alias("res"), F.array(F.col("l_discount") * 10, F.col("l_tax") * 12, F.exp(-d / 2), F.exp(-d / 6), (F.col("l_returnflag") == "A").cast("double")).alias("pair"), (F.col("l_returnflag") == "R").cast("int").alias("hit")
    )
    rows = p.groupBy("g", "res").agg(F.array_sort(F.collect_list("pair")).alias("x"), F.array((F.avg("hit") > 0.33).cast("double")).alias("y")).withColumn("mask", F.array(F.lit(1.0)))
    train, valid, test = (rows.where(F.col("g") % 3 == k) for k in range(3))
    weights, ap = N.fit(train, valid, ["g", "res"], 5, 1, steps=20)
    return spark.createDataFrame([(float(ap), float(N.macro_ap(test, weights, ["g", "res"])))], "valid_ap double, ap double")


@query()
def ml5_minibatch_set_head(spark, sf_dir):
    """The same network in minibatches: tasks step by themselves and their weights are averaged, epochs end by validation AP; over widths and rates."""
    d = F.col("l_quantity") / 5
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("g"), (F.col("l_partkey") % 20).alias("res"), F.array(F.col("l_discount") * 10, F.col("l_tax") * 12, F.exp(-d / 2), F.exp(-d / 6), (F.col("l_returnflag") == "A").cast("double")).alias("pair"), (F.col("l_returnflag") == "R").cast("int").alias("hit")
    )
    rows = p.groupBy("g", "res").agg(F.array_sort(F.collect_list("pair")).alias("x"), F.array((F.avg("hit") > 0.33).cast("double")).alias("y")).withColumn("mask", F.array(F.lit(1.0)))
    train, valid, test = (rows.where(F.col("g") % 3 == k) for k in range(3))
    weights, trace = N.fit_minibatches(train, valid, ["g", "res"], 5, 1, configurations=((8, 0.03), (16, 0.01)), epochs=4)
    best = max(t["valid_ap"] for t in trace)
    ap, prevalence = float(N.macro_ap(test, weights, ["g", "res"])), test.agg(F.avg(F.col("y")[0])).first()[0]
    return spark.createDataFrame([(float(best), ap, prevalence, len(trace))], "valid_ap double, ap double, prevalence double, epochs int")


def _typed_pairs(spark, sf_dir):
    """A pair's distance, two vectors and five masked labels."""
    r = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as g", "l_orderkey as o", "l_linenumber as n", "l_partkey as p", "l_quantity / 5 as d", "l_discount * 10 as u1", "l_tax * 12 as u2", "cast(l_partkey % 7 as double) / 7 as v1", "cast(l_orderkey % 5 as double) / 5 as v2", "l_extendedprice / 1e5 as price"
    )
    labels = F.array(*(((F.col("d") < 3 + k) & (F.col("u1") * 10 % 5 > k / 2)).cast("double") for k in range(5)))
    return r.withColumn("y", labels).withColumn("mask", F.array(*((F.col("p") % 6 != k).cast("double") for k in range(5)))).withColumn("key", F.xxhash64("g", "o", "n", "p", "d", "price"))


def _by_fold(rows):
    return (rows.where(F.col("g") % 3 == k).select("key", "x", "y", "mask") for k in range(3))


@query()
def ml6_pair_head(spark, sf_dir):
    """Test macro AP over five masked channels of a perceptron on two vectors and the distance's radial functions."""
    r = _typed_pairs(spark, sf_dir)
    parts = {"residue": [F.col("u1"), F.col("u2")], "ligand": [F.col("v1"), F.col("v2")], "distance": N.radial(F.col("d"), (1.0, 3.0, 5.0, 7.0, 9.0), 1.5)}
    train, valid, test = _by_fold(r.withColumn("x", N.ablated(parts)))
    weights, ap = N.fit(train, valid, ["key"], 9, 5, hidden=12, steps=30, merged=True)
    return spark.createDataFrame([(float(ap), float(N.macro_ap(test, weights, ["key"])))], "valid_ap double, ap double")


@query()
def ml8_ablated_heads(spark, sf_dir):
    """Test AP of a perceptron on fingerprint bits and a target vector, whole and with either part left out."""
    e = F.col("embedding")
    r = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("vec_id").alias("g"), *((e[i] > 0).cast("double").alias(f"b{i}") for i in range(8)), *(e[i].cast("double").alias(f"t{i}") for i in range(8, 12)))
    r = r.withColumn("y", F.array(((F.col("b0") + F.col("b1") + F.col("t8") * 4) > 1).cast("double"))).withColumn("mask", F.array(F.lit(1.0)))
    parts = {"fingerprint": [F.col(f"b{i}") for i in range(8)], "target": [F.col(f"t{i}") for i in range(8, 12)]}
    out = []
    for without in (None, *parts):
        train, valid, test = _by_fold(r.withColumn("x", N.ablated(parts, without)))
        weights, ap = N.fit(train, valid, ["key"], 12, 1, steps=20)
        out.append((without or "none", float(ap), float(N.macro_ap(test, weights, ["key"]))))
    return spark.createDataFrame(out, "without string, valid_ap double, ap double")


@query(
    """WITH p AS (SELECT l_suppkey AS g, l_partkey % 20 AS res, (1 / (1 + exp(-l_discount)) + 1 / (1 + exp(-l_tax))) / 2 AS p1, (1 / (1 + exp(-l_quantity / 50)) + 1 / (1 + exp(l_tax))) / 2 AS p2 FROM lineitem) SELECT g, res, round(max(greatest(p1, p2)), 6) AS score FROM p GROUP BY g, res"""
)
def ml9_ensemble_scores(spark, sf_dir):
    """Mean of sigmoids over models, then the greatest over pairs and channels of a residue."""
    s = lambda e: 1 / (1 + F.exp(-F.expr(e)))
    p1, p2 = (s("l_discount") + s("l_tax")) / 2, (s("l_quantity / 50") + s("-l_tax")) / 2
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_partkey") % 20).alias("res"), F.greatest(p1, p2).alias("p"))
    return p.groupBy("g", "res").agg(F.round(F.max("p"), 6).alias("score"))


@query(f"WITH {ITEMS} SELECT g, idx, round(0.55 * sa + 0.45 * exp(-d / 12), 6) AS score FROM items")
def ml12_guarded_inference(spark, sf_dir):
    """Scores of all items; one that is not finite stops the job."""
    return ranked_items(spark, sf_dir).select("g", "idx", F.round(L.finite(0.55 * F.col("sa") + 0.45 * F.exp(-F.col("d") / 12)), 6).alias("score"))


@query(
    f"""WITH {ITEMS}, m AS (SELECT g, y, greatest(least(sa * 8, 1 - 1e-7), 1e-7) AS p, CAST(d < 25 AS INT) AS mask FROM items) SELECT g, round(sum(mask * CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END) / greatest(sum(mask), 1), 5) AS loss FROM m GROUP BY g"""
)
def ml13_masked_loss(spark, sf_dir):
    return ranked_items(spark, sf_dir).groupBy("g").agg(F.round(L.masked_loss(F.col("y"), F.col("sa") * 8, (F.col("d") < 25).cast("int")), 5).alias("loss"))


@query()
def r13_grouped_out_of_fold(spark, sf_dir):
    """The mean out-of-fold score of each item over two repeats of five group-disjoint folds."""
    items = ranked_items(spark, sf_dir).select("g", "idx", "y", F.col("sa").alias("v"), F.exp(-F.col("d") / 12).alias("prior"))
    fit = lambda train, features, label: L.boosted_head(train, features, label, trees=2, depth=2, merged=True)
    return L.out_of_fold(items, ["g", "idx"], "g", "y", ["v", "prior"], fit, folds=5, repeats=2, seed="r13").select("g", "idx", F.round("score", 6).alias("score"), "repeats")


@query("SELECT l_suppkey AS g, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber, l_extendedprice, l_shipdate) AS idx, 2::BIGINT AS repeats FROM lineitem")
def r13_out_of_fold_audit(spark, sf_dir):
    """Every item is scored once a repeat."""
    return r13_grouped_out_of_fold(spark, sf_dir).select("g", "idx", "repeats")


@query("SELECT count(DISTINCT l_suppkey) AS groups, count(*) AS items, count(*) FILTER (l_returnflag = 'R') AS positives, true AS even FROM lineitem")
def r13_even_folds(spark, sf_dir):
    """Groups, items and positives over five folds; even: each fold's classes are within the largest group of a fifth."""
    items = ranked_items(spark, sf_dir)
    sizes = items.groupBy("g").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    each = sizes.join(L.even_folds(items, "g", "y", 5, "r13"), "g").groupBy("fold").agg(F.count("*").alias("groups"), F.sum("n").alias("items"), F.sum("p").alias("positives"), F.max("n").alias("most"))
    off = lambda c: F.max(F.abs(c - F.lit(0.2) * F.col("all"))) <= F.max("most")
    total = each.select(F.sum("groups").alias("groups"), F.sum("items").alias("items"), F.sum("positives").alias("positives"))
    all_p, all_n = (each.crossJoin(total.select(F.col(c).alias("all"))).agg(off(F.col(c)).alias(f"even_{c}")) for c in ("positives", "items"))
    return total.crossJoin(all_p).crossJoin(all_n).select("groups", "items", "positives", (F.col("even_positives") & F.col("even_items")).alias("even"))


@query("SELECT DISTINCT l_suppkey AS g, 1 AS folds FROM lineitem")
def r13_fold_audit(spark, sf_dir):
    """Every group lies in one fold."""
    items = ranked_items(spark, sf_dir)
    f = L.stratified_folds(items, "g", "y", 5, "r13")
    return f.groupBy("g").agg(F.countDistinct("fold").cast("int").alias("folds"))
