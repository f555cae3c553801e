"""Resampling statistics, sampling and matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import matching, rank_metrics
from ..operators import resample as R
from .fixtures import DELTAS, ITEMS, deltas, ranked_items, table
from .registry import query

B = 200


def draw_sql(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8))::BIGINT"


def _draws(rel: str, key: str, seed: str, columns: str) -> str:
    """Rows of rel drawn for each replicate, as SQL."""
    return f"""placed AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS place, count(*) OVER () AS n FROM {rel}),
 counter AS (SELECT b, i FROM range({B}) r(b) CROSS JOIN (SELECT place AS i FROM placed)),
 draws AS (SELECT b, {draw_sql(f"'{seed}'", 'b', 'i')} % (SELECT max(n) FROM placed) AS place FROM counter),
 boot AS (SELECT b, {columns} FROM draws JOIN placed USING (place))"""


_INTERVAL = """count(v) AS replicates, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(avg(CAST(v > 0 AS INT)), 6) AS part_above,
 round((count(*) FILTER (v <= 0) + 1)::DOUBLE / (count(v) + 1), 6) AS p_one_sided, round(stddev_samp(v), 6) AS sd"""


def _rounded(df, keep=()):
    return df.select(*keep, *(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes if c not in keep))


@query(f"WITH {DELTAS}, {_draws('deltas', 'id', 'r1', 'delta')}, m AS (SELECT b, avg(delta) AS v FROM boot GROUP BY b) SELECT {_INTERVAL} FROM m")
def r1_r6_r7_paired_bootstrap(spark, sf_dir):
    """Percentile interval, one-sided p and deviation of the mean difference."""
    return _rounded(R.paired_bootstrap(deltas(spark, sf_dir), "id", "delta", B, "r1"))


@query(
    f"""WITH {DELTAS}, o AS (SELECT avg(delta) AS observed, count(*) AS n FROM deltas), f AS (SELECT b, avg(delta * CASE WHEN {draw_sql("'r2'", 'b', 'id')} % 2 = 0 THEN 1 ELSE -1 END) AS v FROM deltas CROSS JOIN range({B}) r(b) GROUP BY b)
 SELECT round(observed, 6) AS observed, n, round((1 + count(*) FILTER (abs(v) >= abs(observed) - 1e-15))::DOUBLE / (count(*) + 1), 6) AS p FROM f CROSS JOIN o GROUP BY observed, n"""
)
def r2_sign_flip(spark, sf_dir):
    return _rounded(R.sign_flip(deltas(spark, sf_dir), "id", "delta", B, "r2"))


@query(
    f"""WITH {DELTAS}, m AS (SELECT cluster % 16 AS id, round(avg(delta), 9) AS delta FROM deltas GROUP BY 1), d AS (SELECT delta, row_number() OVER (ORDER BY id) - 1 AS place FROM m), k AS (SELECT count(*) AS k, avg(delta) AS observed FROM d),
 f AS (SELECT p, sum(delta * (1 - 2 * ((p >> place::INT) & 1))) / max(k) AS v, max(observed) AS observed FROM d CROSS JOIN k CROSS JOIN (SELECT unnest(range((1 << k)::BIGINT)) AS p FROM k) GROUP BY p)
 SELECT round(max(observed), 6) AS observed, round(count(*) FILTER (abs(v) >= abs(observed) - 1e-15)::DOUBLE / count(*), 6) AS p FROM f"""
)
def r3_exact_sign_flip(spark, sf_dir):
    """All sign patterns of the mean differences of 16 sets of clusters, however many complexes these hold."""
    means = deltas(spark, sf_dir).groupBy((F.col("cluster") % 16).alias("id")).agg(F.round(F.avg("delta"), 9).alias("delta"))
    return _rounded(R.exact_sign_flip(means, "id", "delta"))


@query(
    f"""WITH {DELTAS}, c AS (SELECT cluster, sum(delta) AS s, count(*) AS z FROM deltas GROUP BY cluster), {_draws('c', 'cluster', 'r4', 's, z')}, m AS (SELECT b, sum(s) / sum(z) AS v FROM boot GROUP BY b) SELECT {_INTERVAL} FROM m"""
)
def r4_cluster_bootstrap(spark, sf_dir):
    return _rounded(R.cluster_bootstrap(deltas(spark, sf_dir), "cluster", "delta", B, "r4"))


@query(
    f"""WITH {DELTAS}, c AS (SELECT cluster, sum(delta) AS s FROM deltas GROUP BY cluster), o AS (SELECT avg(delta) AS observed, count(*) AS n, count(DISTINCT cluster) AS clusters FROM deltas),
 f AS (SELECT b, sum(s * CASE WHEN {draw_sql("'r4f'", 'b', 'cluster')} % 2 = 0 THEN 1 ELSE -1 END) AS v FROM c CROSS JOIN range({B}) r(b) GROUP BY b)
 SELECT round(observed, 6) AS observed, n, clusters, round((1 + count(*) FILTER (abs(v / n) >= abs(observed) - 1e-15))::DOUBLE / {B + 1}, 6) AS p FROM f CROSS JOIN o GROUP BY observed, n, clusters"""
)
def r4_cluster_sign_flip(spark, sf_dir):
    """Two-sided p of flips of the sums of whole clusters."""
    return _rounded(R.cluster_sign_flip(deltas(spark, sf_dir), "cluster", "delta", B, "r4f"))


@query(
    f"""WITH {ITEMS}, gs AS (SELECT DISTINCT g FROM items), {_draws('gs', 'g', 'r5', 'g')}, m AS (SELECT b, g, count(*) AS times FROM boot GROUP BY b, g),
 t AS (SELECT b, sa, sum(tp * times) AS tp, sum(n * times) AS n FROM m JOIN (SELECT g, sa, sum(y) AS tp, count(*) AS n FROM items GROUP BY g, sa) USING (g) GROUP BY b, sa),
 w AS (SELECT b, tp, sum(tp) OVER (PARTITION BY b ORDER BY sa DESC) AS ctp, sum(n) OVER (PARTITION BY b ORDER BY sa DESC) AS cn, sum(tp) OVER (PARTITION BY b) AS p FROM t),
 a AS (SELECT b, sum(tp::DOUBLE / p * (ctp::DOUBLE / cn)) AS v FROM w WHERE p > 0 GROUP BY b) SELECT {_INTERVAL} FROM a"""
)
def r5_blocked_bootstrap_ap(spark, sf_dir):
    """Interval of the pooled AP, complexes resampled whole."""
    return _rounded(R.interval(R.blocked_bootstrap_ap(ranked_items(spark, sf_dir), "g", "y", "sa", B, "r5"), "ap"))


_RECALL = f"""{ITEMS}, k AS (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY sa DESC, idx) AS ra, row_number() OVER (PARTITION BY g ORDER BY sb DESC, idx) AS rb FROM items),
 d AS (SELECT g, round((sum(CASE WHEN ra <= 10 THEN y ELSE 0 END) - sum(CASE WHEN rb <= 10 THEN y ELSE 0 END))::DOUBLE / sum(y), 9) AS delta FROM k GROUP BY g HAVING sum(y) > 0)"""


@query(f"WITH {_RECALL}, {_draws('d', 'g', 'r8', 'delta')}, m AS (SELECT b, avg(delta) AS v FROM boot GROUP BY b) SELECT {_INTERVAL} FROM m")
def r8_budget_bootstrap(spark, sf_dir):
    """Interval of the difference in recall@10 of two methods."""
    items = ranked_items(spark, sf_dir)
    a, b = (rank_metrics.top_metrics(items, ["g"], "y", s, ["idx"]).where("positives > 0").select("g", F.col("recall_at_10").alias(s)) for s in ("sa", "sb"))
    d = a.join(b, "g").select("g", F.round(F.col("sa") - F.col("sb"), 9).alias("delta"))
    return _rounded(R.paired_bootstrap(d, "g", "delta", B, "r8"))


@query(
    f"""WITH {DELTAS}, d AS (SELECT *, CAST(id % 3 AS BIGINT) AS stratum, delta * 0.5 + 0.01 AS other FROM deltas), p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY stratum) AS n FROM d),
 r AS (SELECT stratum, b, {draw_sql("'r9'", 'stratum', 'b', 'place')} % n AS place FROM p CROSS JOIN range({B}) r(b)), f AS (SELECT r.stratum, b, avg(delta) AS delta, avg(other) AS other FROM r JOIN p USING (stratum, place) GROUP BY r.stratum, b),
 u AS (SELECT stratum, 'delta' AS method, delta AS v FROM f UNION ALL SELECT stratum, 'other', other FROM f) SELECT stratum, method, {_INTERVAL} FROM u GROUP BY stratum, method"""
)
def r9_strata_bootstrap(spark, sf_dir):
    """Intervals of two methods in each stratum, on the same draws."""
    d = deltas(spark, sf_dir).withColumn("stratum", (F.col("id") % 3).cast("bigint")).withColumn("other", F.col("delta") * 0.5 + 0.01)
    mean = lambda c: (F.sum(F.col(c) * F.col("times")) / F.sum("times")).alias(c)
    means = R.resampled_within(d.select("stratum", "id", "delta", "other"), "stratum", "id", B, "r9").groupBy("stratum", "b").agg(mean("delta"), mean("other"))
    long = means.selectExpr("stratum", "stack(2, 'delta', delta, 'other', other) as (method, mean)")
    return _rounded(R.interval(long, "mean", ["stratum", "method"]), ["stratum", "method"])


@query(
    f"""WITH {DELTAS}, a AS (SELECT cluster, delta, abs(delta) AS m FROM deltas WHERE delta <> 0), r AS (SELECT *, rank() OVER (PARTITION BY cluster ORDER BY m) + (count(*) OVER (PARTITION BY cluster, m) - 1) / 2.0::DOUBLE AS k FROM a)
 SELECT cluster, count(*) AS n, round(sum(CASE WHEN delta > 0 THEN k ELSE 0 END)::DOUBLE, 6) AS w_plus, round((sum(CASE WHEN delta > 0 THEN k ELSE 0 END) - count(*) * (count(*) + 1) / 4.0::DOUBLE) / sqrt(sum(k * k) / 4.0::DOUBLE), 6) AS z FROM r GROUP BY cluster"""
)
def r10_wilcoxon(spark, sf_dir):
    return _rounded(R.wilcoxon(deltas(spark, sf_dir), ["cluster"], "delta"), ["cluster"])


@query()
def r11_match_pairs(spark, sf_dir):
    """Optimal one-to-one matching of positives and negatives on distance, then the caliper, then pair accuracy."""
    near = ranked_items(spark, sf_dir).where("d <= 8")
    pairs = matching.matched_pairs(near, "g", "y", "d", "sb", 0.5)
    return pairs.groupBy("g").agg(F.count("*").alias("pairs"), F.round(F.avg(F.when(F.col("won") > 0, 1.0).when(F.col("won") == 0, 0.5).otherwise(0.0)), 6).alias("accuracy"))


@query()
def r11_radii_and_calipers(spark, sf_dir):
    """Pairs, mean gap, accuracy and score difference of matched pairs by radius, caliper and score, from one matching a radius."""
    items = ranked_items(spark, sf_dir).select("g", "y", (F.col("d") / 4 + F.col("idx") % 97 / 500).alias("d"), F.col("sa").alias("discount"), F.col("sb").alias("price"))
    pairs = matching.matched_by_radius(items, "g", "y", "d", ["discount", "price"])
    long = pairs.select("g", "radius", "caliper", "gap", F.explode(F.create_map(F.lit("discount"), F.col("discount_won"), F.lit("price"), F.col("price_won"))).alias("method", "won"))
    accuracy = F.avg(F.when(F.col("won") > 0, 1.0).when(F.col("won") == 0, 0.5).otherwise(0.0))
    return long.groupBy("radius", "caliper", "method").agg(F.countDistinct("g").alias("complexes"), F.count("*").alias("pairs"), F.round(F.avg("gap"), 6).alias("gap"), F.round(accuracy, 6).alias("accuracy"), F.round(F.avg("won"), 6).alias("won"))


@query()
def r12_matched_effects(spark, sf_dir):
    """Bootstrap of the mean accuracy of matched pairs over complexes."""
    each = r11_match_pairs(spark, sf_dir).select("g", (F.col("accuracy") - 0.5).alias("delta"))
    return _rounded(R.paired_bootstrap(each, "g", "delta", B, "r12"))


@query(f"WITH h AS (SELECT o_orderpriority AS split, o_orderkey, {draw_sql(repr('r14'), 'o_orderkey')} AS h FROM orders) SELECT split, o_orderkey FROM h QUALIFY row_number() OVER (PARTITION BY split ORDER BY h, o_orderkey) <= 100")
def r14_cap_split(spark, sf_dir):
    """A capped random sample of each split (a sampling operator)."""
    return R.capped(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split"), "o_orderkey"), ["split"], "o_orderkey", 100, "r14")


@query(
    f"""WITH t AS (SELECT s_nationkey AS target, CAST(s_acctbal > 5000 AS INT) AS label, s_suppkey AS id FROM supplier), p AS (SELECT *, row_number() OVER (PARTITION BY target, label ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY target, label) AS n FROM t),
 g AS (SELECT target, label, row_number() OVER (ORDER BY target, label) - 1 AS k FROM (SELECT DISTINCT target, label FROM t)), d AS (SELECT i, {draw_sql("'r15'", "'g'", 'i')} % (SELECT count(*) FROM g) AS k FROM range(256) r(i))
 SELECT i, target, label, id FROM d JOIN g USING (k) JOIN p USING (target, label) WHERE place = {draw_sql("'r15'", "'i'", 'i')} % n"""
)
def r15_balanced_batch(spark, sf_dir):
    """A batch drawn with replacement, balanced over (target, label)."""
    t = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("target"), (F.col("s_acctbal") > 5000).cast("int").alias("label"), F.col("s_suppkey").alias("id"))
    w = Window.partitionBy("target", "label")
    placed = t.withColumn("place", F.row_number().over(w.orderBy("id")) - 1).withColumn("n", F.count("*").over(w))
    groups = t.select("target", "label").distinct().withColumn("k", F.row_number().over(Window.partitionBy().orderBy("target", "label")) - 1)
    n = groups.count()
    draws = spark.range(256).select(F.col("id").alias("i"), (R.draw("r15", "g", F.col("id")) % n).alias("k"))
    return draws.join(groups, "k").join(placed, ["target", "label"]).where(F.col("place") == R.draw("r15", "i", F.col("i")) % F.col("n")).select("i", "target", "label", "id")


@query(
    f"""WITH {ITEMS}, m AS (SELECT mode, shift FROM (VALUES ('native', 0.0::DOUBLE), ('near', 0.5), ('far', 2.0)) v(mode, shift)),
 p AS (SELECT g, idx, y, mode, s AS seed, -(d + shift * ({draw_sql("'r16'", 'mode', 's', 'g', 'idx')} / 4294967296.0::DOUBLE)) AS score FROM items CROSS JOIN m CROSS JOIN range(3) r(s)),
 k AS (SELECT g, mode, seed, y, row_number() OVER (PARTITION BY g, mode, seed ORDER BY score DESC, idx) AS r FROM p),
 c AS (SELECT mode, seed, g, sum(CASE WHEN r <= 10 THEN y ELSE 0 END)::DOUBLE / sum(y) AS rec FROM k GROUP BY ALL HAVING sum(y) > 0), a AS (SELECT mode, seed, avg(rec) AS v FROM c GROUP BY ALL)
 SELECT mode, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*) AS seeds FROM a GROUP BY mode"""
)
def r16_pose_sweep(spark, sf_dir):
    """Recall@10 under modes of perturbation, mean and deviation over seeds."""
    modes = F.explode(F.map_from_arrays(F.array(*map(F.lit, ("native", "near", "far"))), F.array(*map(F.lit, (0.0, 0.5, 2.0))))).alias("mode", "shift")
    p = ranked_items(spark, sf_dir).select("g", "idx", "y", "d", modes).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2))))
    p = p.withColumn("score", -(F.col("d") + F.col("shift") * (R.draw("r16", F.col("mode"), F.col("seed"), F.col("g"), F.col("idx")) / 4294967296.0)))
    c = rank_metrics.top_metrics(p, ["mode", "seed", "g"], "y", "score", ["idx"], (10,)).where("positives > 0")
    a = c.groupBy("mode", "seed").agg(F.avg("recall_at_10").alias("v"))
    return a.groupBy("mode").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"), F.count("*").alias("seeds"))


@query(f"WITH {ITEMS}, h AS (SELECT g, idx, {draw_sql(repr('r18'), 'g', 'idx')} AS h FROM items WHERE y = 0) SELECT g, idx FROM h QUALIFY row_number() OVER (PARTITION BY g ORDER BY h, idx) <= 5")
def r18_random_negatives(spark, sf_dir):
    """Five random negatives of each complex, without replacement (a sampling operator)."""
    n = ranked_items(spark, sf_dir).where("y = 0")
    w = Window.partitionBy("g").orderBy(R.draw("r18", F.col("g"), F.col("idx")), "idx")
    return n.withColumn("r", F.row_number().over(w)).where("r <= 5").select("g", "idx")


@query(
    f"""WITH {ITEMS}, d AS (SELECT l_suppkey AS id, round(avg(l_discount) - avg(l_tax) - 0.01, 9) AS delta FROM lineitem GROUP BY 1 HAVING count(*) > 0), {_draws('d', 'id', 'v1', 'delta')}, m AS (SELECT b, avg(delta) AS v FROM boot GROUP BY b) SELECT (SELECT round(avg(delta), 6) FROM d) AS mean_delta, {_INTERVAL} FROM m"""
)
def v1_temporal_effect(spark, sf_dir):
    """Validated paired effect and its interval: ids must be unique, values finite and within [0, 1]."""
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    d = means.select("id", F.round(F.col("a") - F.col("b") - 0.01, 9).alias("delta"))
    R.validated_pairs(means, "id", ["a", "b"])
    return _rounded(R.paired_bootstrap(d, "id", "delta", B, "v1")).withColumn("mean_delta", F.lit(d.agg(F.round(F.avg("delta"), 6)).first()[0]))
