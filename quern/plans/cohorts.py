"""Projections, filters, joins, aggregations, selections and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts as C
from ..operators import selection as S
from .fixtures import ITEMS, ranked_items, table
from .registry import query


@query("""SELECT o_orderkey, trim(coalesce(o_orderstatus, '')) AS status, regexp_replace(trim(CAST(o_custkey AS VARCHAR) || '.0'), '\\.0$', '') AS number FROM orders""")
def p1_clean_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", C.clean_text(F.col("o_orderstatus")).alias("status"), C.clean_number(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("number"))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice IS NOT NULL")
def p2_select_manifest(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT' and o_totalprice is not null").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(f"WITH {ITEMS} SELECT r, g, count(*) AS n FROM items JOIN (VALUES (4), (6), (8), (12), (999)) v(r) ON d <= r GROUP BY r, g")
def p3_radius_filter(spark, sf_dir):
    """Rows within each radius; groups left without rows drop out.  Radii are exploded, not joined."""
    radii = F.explode(F.filter(F.array(*map(F.lit, (4, 6, 8, 12, 999))), lambda r: F.col("d") <= r)).alias("r")
    return ranked_items(spark, sf_dir).select("g", radii).groupBy("r", "g").agg(F.count("*").alias("n"))


@query(
    f"""WITH {ITEMS}, n AS (SELECT y, unnest(list_filter([CASE WHEN d <= 4 THEN 'le4' END, CASE WHEN d > 4 AND d <= 6 THEN '4to6' END, CASE WHEN d > 6 AND d <= 8 THEN '6to8' END, CASE WHEN d > 8 THEN 'gt8' END,
 CASE WHEN d <= 6 THEN 'le6' END, CASE WHEN d <= 8 THEN 'le8' END, 'all'], lambda x: x IS NOT NULL)) AS subset FROM items) SELECT subset, count(*) AS n, sum(y)::BIGINT AS positives FROM n GROUP BY subset"""
)
def p4_distance_subsets(spark, sf_dir):
    d = F.col("d")
    names = C.matching_names({"le4": d <= 4, "4to6": (d > 4) & (d <= 6), "6to8": (d > 6) & (d <= 8), "gt8": d > 8, "le6": d <= 6, "le8": d <= 8, "all": F.lit(True)})
    return ranked_items(spark, sf_dir).select("y", F.explode(names).alias("subset")).groupBy("subset").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query(
    """WITH m AS (SELECT c_custkey, c_mktsegment, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 5000 END), -1) AS identity FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
 s AS (SELECT unnest(list_filter([CASE WHEN identity < 30 THEN 'id30' END, CASE WHEN identity < 70 THEN 'id70' END, 'all'], lambda x: x IS NOT NULL)) AS subset FROM m) SELECT subset, count(*) AS n FROM s GROUP BY subset"""
)
def p5_leakage_subsets(spark, sf_dir):
    """Unknown identity counts as -1, so it is in both low-identity subsets."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_totalprice") / 5000).alias("identity"))
    m = table(spark, sf_dir, "customer").join(o, "c_custkey", "left").withColumn("identity", F.coalesce("identity", F.lit(-1.0)))
    names = C.matching_names({"id30": F.col("identity") < 30, "id70": F.col("identity") < 70, "all": F.lit(True)})
    return m.select(F.explode(names).alias("subset")).groupBy("subset").agg(F.count("*").alias("n"))


@query(
    """WITH m AS (SELECT o_custkey AS g, max(o_totalprice) / 100000 AS ddg FROM orders GROUP BY 1) SELECT t, sum(CAST(ddg >= t AS INT))::BIGINT AS positives, count(*) AS n FROM m CROSS JOIN (VALUES (0.5::DOUBLE), (1.0), (2.0)) v(t) GROUP BY t"""
)
def p6_threshold_labels(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.max("o_totalprice") / 100000).alias("ddg"))
    m = m.select("ddg", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))).alias("t"))
    return m.groupBy("t").agg(F.sum((F.col("ddg") >= F.col("t")).cast("int")).alias("positives"), F.count("*").alias("n"))


@query(
    """WITH b AS (SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size_bin, CASE WHEN p_retailprice <= 1000 THEN 'low' WHEN p_retailprice <= 1500 THEN 'mid' ELSE 'high' END AS price_bin FROM part)
 SELECT size_bin, price_bin, count(*) AS n FROM b GROUP BY ALL"""
)
def p7_bins(spark, sf_dir):
    """Left-closed and right-closed bins."""
    p = table(spark, sf_dir, "part").select(C.bin_left(F.col("p_size"), [10, 30], ["small", "middle", "large"]).alias("size_bin"), C.bin_right(F.col("p_retailprice"), [1000, 1500], ["low", "mid", "high"]).alias("price_bin"))
    return p.groupBy("size_bin", "price_bin").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE (s_acctbal + 1000) / 11000 END AS v FROM supplier)
 SELECT CASE WHEN v IS NULL THEN 'unresolved' WHEN v < 0.3 THEN '<0.3' WHEN v < 0.5 THEN '0.3-0.5' WHEN v < 0.7 THEN '0.5-0.7' ELSE '>=0.7' END AS bin, count(*) AS n FROM s GROUP BY 1"""
)
def p8_similarity_bins(spark, sf_dir):
    v = F.when(F.col("s_suppkey") % 7 == 0, None).otherwise((F.col("s_acctbal") + 1000) / 11000)
    return table(spark, sf_dir, "supplier").groupBy(C.similarity_bin(v).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) AS seen FROM customer")
def p9_seen_flag(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_seen", F.lit(True))
    return table(spark, sf_dir, "customer").join(keys, "c_custkey", "left").select("c_custkey", F.col("_seen").isNotNull().alias("seen"))


@query("SELECT p_partkey FROM part WHERE p_size < 30 AND p_retailprice < 1200 AND (p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey < 20) OR p_type LIKE '%STEEL')")
def p10_joint_ood(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    known = p.where("p_partkey < 20").select("p_brand").distinct().withColumn("_known", F.lit(True))
    new = F.col("_known").isNull()
    return p.join(C.small(known), "p_brand", "left").where((F.col("p_size") < 30) & (F.col("p_retailprice") < 1200) & (new | F.col("p_type").endswith("STEEL"))).select("p_partkey")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'AUTOMOBILE' THEN 3 ELSE 0 END AS code FROM customer")
def p11_encode(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.encode(F.col("c_mktsegment"), ["BUILDING", "MACHINERY", "AUTOMOBILE"]).alias("code"))


@query(
    """WITH n AS (SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS a FROM part)
 SELECT p_partkey, CASE WHEN substr(a, 1, 2) IN ('CL','BR','MG','MN','FE','ZN','CA','NA') THEN substr(a, 1, 2) WHEN length(a) > 0 THEN substr(a, 1, 1) ELSE 'UNK' END AS element FROM n
 WHERE CASE WHEN substr(a, 1, 2) IN ('CL','BR','MG','MN','FE','ZN','CA','NA') THEN substr(a, 1, 2) WHEN length(a) > 0 THEN substr(a, 1, 1) ELSE 'UNK' END <> 'H'"""
)
def p12_p13_heavy_elements(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.element_of(F.col("p_name")).alias("element")).where("element <> 'H'")


@query("SELECT p_partkey, p_retailprice FROM part")
def p14_prefix_projection(spark, sf_dir):
    return C.columns_with_prefix(table(spark, sf_dir, "part"), ["p_partkey"], ["p_retail"])


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END AS v FROM part WHERE p_size % 5 <> 0")
def p15_require_finite(spark, sf_dir):
    v = F.when(F.col("p_size") % 5 == 0, None).when(F.col("p_size") % 5 == 7, float("nan")).otherwise(F.col("p_retailprice"))
    return C.require(table(spark, sf_dir, "part").select("p_partkey", v.alias("v")), ["v"])


@query("SELECT s_suppkey, regexp_replace('src:h' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') || CASE WHEN s_suppkey % 2 = 0 THEN '_platinum' ELSE '' END || '__' || s_name, ':h\\d{2}(_platinum)?__', ':') AS id FROM supplier")
def p16_canonical_id(spark, sf_dir):
    raw = F.concat(F.lit("src:h"), F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0"), F.when(F.col("s_suppkey") % 2 == 0, "_platinum").otherwise(""), F.lit("__"), F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.canonical_id(raw).alias("id"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(upper(concat_ws(' ', p_name, p_type)), 'STEEL|BRASS')")
def p17_keyword_match(spark, sf_dir):
    return table(spark, sf_dir, "part").where(C.keyword_match(["p_name", "p_type"], ["STEEL", "BRASS"])).select("p_partkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey AS VARCHAR) || '.5' ELSE '12A' END AS number FROM orders")
def p18_whole_number(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.col("o_custkey").cast("string"), F.lit(".5"))).otherwise("12A")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.whole_number(raw).alias("number"))


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j1_j15_lookup_join(spark, sf_dir):
    """Key lookup; the small side is broadcast behind a check of its size."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").join(C.small(c), "o_custkey", "left").select("o_orderkey", "c_mktsegment")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def j2_many_to_one(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return C.many_to_one(o, table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"]).select("o_orderkey", "c_name")


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j3_enrichment_chain(spark, sf_dir):
    n = C.first_by_key(table(spark, sf_dir, "nation"), ["n_nationkey"], ["n_name"])
    r = C.first_by_key(table(spark, sf_dir, "region"), ["r_regionkey"], ["r_name"])
    s = table(spark, sf_dir, "supplier")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("s_suppkey", "n_name", "r_name")


@query(
    """WITH e AS (SELECT p_brand, p_size, max(p_retailprice) AS v FROM part WHERE p_size > 25 GROUP BY ALL), l AS (SELECT p_brand, max(p_retailprice) AS v FROM part GROUP BY ALL)
 SELECT p_partkey, coalesce(e.v, l.v) AS v FROM part LEFT JOIN e ON part.p_brand = e.p_brand AND part.p_size = e.p_size LEFT JOIN l ON part.p_brand = l.p_brand"""
)
def j4_fallback_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    exact = p.where("p_size > 25").groupBy("p_brand", "p_size").agg(F.max("p_retailprice").alias("v"))
    loose = p.groupBy("p_brand").agg(F.max("p_retailprice").alias("v"))
    return C.fallback_join(p.select("p_partkey", "p_brand", "p_size"), exact, loose, ["p_brand", "p_size"], ["p_brand"], "v").select("p_partkey", "v")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def j5_semi_join(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return S.covered(table(spark, sf_dir, "customer").select("c_custkey"), ids, "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j6_anti_join(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return S.covered(table(spark, sf_dir, "customer").select("c_custkey"), ids, "c_custkey", there=False)


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def j7_s3_common_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return S.common_keys(*(o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id")) for s in "FO"))


@query(
    """SELECT l_suppkey AS id, round(avg(l_discount) FILTER (l_returnflag = 'A'), 6) AS score_a, round(avg(l_discount) FILTER (l_returnflag = 'N'), 6) AS score_n, round(avg(l_discount) FILTER (l_returnflag = 'R'), 6) AS score_r FROM lineitem GROUP BY 1"""
)
def j8_wide_by_method(spark, sf_dir):
    got = S.wide(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "id"), "id", "l_returnflag", ["A", "N", "R"], "l_discount")
    return got.select("id", *(F.round(c, 6).alias(c) for c in got.columns[1:]))


_TWO = "a AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier WHERE s_suppkey % 10 <> 0), b AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE s_nationkey END AS v FROM supplier WHERE s_suppkey % 9 <> 0)"


@query(f"WITH {_TWO} SELECT count(*) FILTER (b.k IS NULL) AS left_only, count(*) FILTER (a.k IS NULL) AS right_only, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL AND a.v <> b.v) AS differing FROM a FULL JOIN b USING (k)")
def j9_j16_alignment_audit(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    return C.mismatches(s.where("k % 10 <> 0"), s.where("k % 9 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, -1).otherwise(F.col("v"))), ["k"], ["v"])


@query("SELECT o_custkey AS g, round(o_totalprice / 1000, 0)::BIGINT AS size, count(*) AS n FROM orders GROUP BY ALL")
def a11_tallies(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("g"), F.round(F.col("o_totalprice") / 1000, 0).cast("bigint").alias("size")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS g, count(o_totalprice) AS n, round(avg(o_totalprice), 7) AS mean, round(CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(o_totalprice) END, 2) AS sd, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1")
def a1_describe(spark, sf_dir):
    d = C.describe(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice")
    return d.select(F.col("o_custkey").alias("g"), "n", F.round("mean", 7).alias("mean"), F.round("sd", 2).alias("sd"), "min", "max")


@query(
    """SELECT o_custkey, o_orderpriority, count(*) AS size, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ';') AS statuses, max(o_totalprice) AS max_v, round(avg(o_totalprice), 4) AS mean_v, min(o_totalprice) AS min_v FROM orders GROUP BY 1, 2"""
)
def a2_site_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("size"), C.joined_set(F.col("o_orderstatus")).alias("statuses"), F.max("o_totalprice").alias("max_v"), F.round(F.avg("o_totalprice"), 4).alias("mean_v"), F.min("o_totalprice").alias("min_v"))


_RUNS = f"{ITEMS}, runs AS (SELECT g, idx, 1 AS run, sa AS score FROM items UNION ALL SELECT g, idx, 2, sb / 100000 FROM items UNION ALL SELECT g, idx, 3, 0.55 * sa + 0.45 * exp(-d / 12) FROM items)"


def _runs(spark, sf_dir):
    i = ranked_items(spark, sf_dir)
    return i.select("g", "idx", F.posexplode(F.array(F.col("sa"), F.col("sb") / 100000, 0.55 * F.col("sa") + 0.45 * F.exp(-F.col("d") / 12))).alias("run", "score")).withColumn("run", F.col("run") + 1)


@query(f"WITH {_RUNS} SELECT g, idx, round(avg(score), 6) AS score, count(*) AS runs FROM runs GROUP BY g, idx")
def a3_a4_average_runs(spark, sf_dir):
    """Probability ensemble: mean of the scores of an item over runs."""
    return S.ensemble_mean(_runs(spark, sf_dir), ["g", "idx"], "score").withColumn("score", F.round("score", 6))


@query(f"WITH {_RUNS}, m AS (SELECT run, g, avg(score) AS v FROM runs GROUP BY 1, 2), r AS (SELECT run, avg(v) AS v FROM m GROUP BY 1) SELECT round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*) AS runs FROM r")
def a5_r17_seed_summary(spark, sf_dir):
    """Mean of run means, which is not the mean of the ensemble."""
    return S.run_summary(_runs(spark, sf_dir), "run", "g", "score").withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


@query(
    """SELECT s_suppkey, coalesce(max(l_discount), 0) AS max_v, coalesce(min(l_discount), 0) AS min_v, round(coalesce(sum(l_discount), 0), 6) AS sum_v, round(coalesce(avg(l_discount), 0), 6) AS mean_v
 FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.07) ON s_suppkey = l_suppkey GROUP BY 1"""
)
def a7_pool_pairs(spark, sf_dir):
    """Pools of a residue's pairs; a residue without pairs gets 0."""
    pairs = table(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_tax > 0.07").select(F.col("l_suppkey").alias("s_suppkey"), "l_discount")
    return S.pooled_values(table(spark, sf_dir, "supplier"), pairs, ["s_suppkey"], "l_discount").withColumns({c: F.round(c, 6) for c in ("sum_v", "mean_v")})


@query("SELECT g, round(avg(v), 6) AS top3 FROM (SELECT o_custkey AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r <= 3 GROUP BY g")
def a8_top3_mean(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("g")).agg(F.round(C.top_mean(F.col("o_totalprice")), 6).alias("top3"))


@query(f"WITH {ITEMS} SELECT g, count(*) FILTER (d <= 4) AS le4, count(*) FILTER (d <= 8) AS le8, round(avg(CAST(sa >= 0.05 AS INT)), 6) AS frac, round(sum(sa * exp(-d / 4)) / count(*), 6) AS soft FROM items GROUP BY g")
def a9_a10_counts_and_soft_counts(spark, sf_dir):
    return S.contact_counts(ranked_items(spark, sf_dir), ["g"], "d", "sa", (4, 8), 0.05, 4).withColumns({c: F.round(c, 6) for c in ("frac", "soft")})


@query("SELECT n_name, count(DISTINCT s_suppkey) AS groups, round(sum(s_acctbal), 2) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def a11_a12_cluster_sums(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(C.small(n), s.s_nationkey == n.n_nationkey).groupBy("n_name").agg(F.countDistinct("s_suppkey").alias("groups"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query(
    """SELECT 'brand' AS dimension, p_brand AS "group", count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY p_brand UNION ALL SELECT 'type', p_type, count(*), round(avg(p_retailprice), 4) FROM part GROUP BY p_type
 UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), count(*), round(avg(p_retailprice), 4) FROM part GROUP BY p_size"""
)
def a13_stratified_means(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"), "p_retailprice")
    return C.stratified(p, ["brand", "type", "size"], [F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean")])


@query(
    """WITH t AS (SELECT l_linestatus AS split, unnest(['A', 'N', 'R']) AS kind, l_returnflag, l_quantity FROM lineitem) SELECT split, kind, count(*) AS n, sum(CAST(l_returnflag = kind AS INT))::BIGINT AS positives, sum(CAST(l_quantity < 25 AS INT))::BIGINT AS masked,
 round(least(50, sum(CAST(l_returnflag <> kind AS INT))::DOUBLE / nullif(sum(CAST(l_returnflag = kind AS INT)), 0)), 6) AS pos_weight FROM t GROUP BY split, kind"""
)
def a14_a15_tally_and_weights(spark, sf_dir):
    """Rows, positives and mask of each type, and its class weight min(50, negatives / positives); NULL without positives."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("split"), F.explode(F.array(*map(F.lit, "ANR"))).alias("kind"), (F.col("l_returnflag") == F.col("kind")).cast("int").alias("y"), (F.col("l_quantity") < 25).cast("int").alias("m"))
    return S.class_tally(t, ["split", "kind"], "y", "m").withColumn("pos_weight", F.round("pos_weight", 6))


@query("SELECT count(*) AS n, count(*) FILTER (greatest(CAST(l_returnflag = 'A' AS INT), CAST(l_returnflag = 'R' AS INT)) <> CAST(l_returnflag <> 'N' AS INT)) AS mismatches, round(max(abs(l_discount - l_tax)), 6) AS max_abs_diff, round(avg(abs(l_discount - l_tax)), 6) AS mean_abs_diff FROM lineitem")
def a16_a20_union_and_difference(spark, sf_dir):
    """Union of channel labels against the label, and differences of two score sets."""
    is_ = lambda f: (F.col("l_returnflag") == f).cast("int")
    got = S.union_and_difference(table(spark, sf_dir, "lineitem"), [is_("A"), is_("R")], (F.col("l_returnflag") != "N").cast("int"), "l_discount", "l_tax")
    return got.withColumns({c: F.round(c, 6) for c in ("max_abs_diff", "mean_abs_diff")})


@query("SELECT CAST(least(floor((d + 1) / 2 * 16), 15) AS INT) AS bin, count(*) AS n FROM (SELECT (l_discount - l_tax) * 10 AS d FROM lineitem) WHERE d BETWEEN -1 AND 1 GROUP BY 1")
def a18_histogram(spark, sf_dir):
    return C.histogram(table(spark, sf_dir, "lineitem").select(((F.col("l_discount") - F.col("l_tax")) * 10).alias("d")), "d", -1, 1, 16)


@query(
    f"""WITH {ITEMS}, t AS (SELECT g, y AS a, CAST(sa >= 0.08 AS INT) AS b FROM items) SELECT g, count(*) AS rows, sum(a)::BIGINT AS a_positives, sum(b)::BIGINT AS b_positives, round(coalesce(sum(a * b)::DOUBLE / nullif(sum(greatest(a, b)), 0), 1), 6) AS jaccard, sum(abs(a - b))::BIGINT AS disagreements FROM t GROUP BY g"""
)
def a21_label_overlap(spark, sf_dir):
    t = ranked_items(spark, sf_dir).select("g", F.col("y").alias("a"), (F.col("sa") >= 0.08).cast("int").alias("b"))
    o = C.label_overlap(t, ["g"], "a", "b")
    return o.withColumn("jaccard", F.round("jaccard", 6))


@query(
    f"""WITH {ITEMS}, r AS (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY sa DESC, idx) AS ra, row_number() OVER (PARTITION BY g ORDER BY sb DESC, idx) AS rb, sum(y) OVER (PARTITION BY g) AS p FROM items),
 s AS (SELECT g, y, CASE WHEN ra <= p AND rb <= p THEN 'both' WHEN ra <= p THEN 'removed' WHEN rb <= p THEN 'added' ELSE 'neither' END AS state FROM r) SELECT state, count(*) AS n, sum(y)::BIGINT AS positives FROM s GROUP BY state"""
)
def a22_selection_conflicts(spark, sf_dir):
    """Items that two top-P selections share, add and remove."""
    return S.selection_conflicts(ranked_items(spark, sf_dir, dealt=True), ["g"], "y", "sa", "sb", ["idx"])


@query(
    """WITH c AS (SELECT o_custkey AS g, o_orderkey AS site, CAST(o_orderstatus = 'F' AS INT) AS overlap, CAST(o_orderpriority = '1-URGENT' AS INT) AS code, CAST(floor(o_totalprice) AS BIGINT) % 5 AS n FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY overlap DESC, code DESC, n DESC, site) AS r, max(overlap) OVER (PARTITION BY g) AS any_ FROM c)
 SELECT g, CASE WHEN overlap = 0 AND code = 0 THEN NULL ELSE site END AS site FROM r WHERE r = 1"""
)
def k2_choose_site(spark, sf_dir):
    """Best candidate by several keys; NULL where the best neither overlaps nor has the code."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("site"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    keys = {"overlap": (F.col("o_orderstatus") == "F").cast("int"), "code": (F.col("o_orderpriority") == "1-URGENT").cast("int"), "n": F.col("o_totalprice").cast("bigint") % 5}
    return S.best_candidate(o, ["g"], keys, "site", (F.col("overlap") > 0) | (F.col("code") > 0))


_HASH = "md5('{salt}|' || CAST({c} AS VARCHAR))"


@query(
    f"""WITH {ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d, md5('k3|' || CAST(idx AS VARCHAR)), idx) AS r FROM items WHERE y = 0), p AS (SELECT g, sum(y) AS p, sum(1 - y) AS m FROM items GROUP BY g)
 SELECT g, idx, d FROM n JOIN p USING (g) WHERE r <= least(m, greatest(p // 40, 1), 8)"""
)
def k3_hard_negatives(spark, sf_dir):
    """The nearest negatives of each complex, as many as its positives call for, ties by hash."""
    tie = [F.md5(F.concat(F.lit("k3|"), F.col("idx").cast("string")).cast("binary")), "idx"]
    return S.nearest_negatives(ranked_items(spark, sf_dir).select("g", "idx", "d", "y"), "g", "y", "d", tie, 40, 8).select("g", "idx", "d")


@query(
    """WITH h AS (SELECT o_orderkey, o_orderpriority AS split, sha256('s1|' || CAST(o_orderkey AS VARCHAR)) AS h FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY h) AS r FROM h)
, k AS (SELECT *, row_number() OVER (ORDER BY CAST(r > 20 AS INT), h) AS k FROM r) SELECT split, o_orderkey FROM k WHERE r <= 20 OR k <= 120"""
)
def k4_stable_subset(spark, sf_dir):
    """A deterministic subset of each split, by hash, filled up to 120 rows from what is left."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split"), "o_orderkey")
    return S.stable_subset(o, "split", "o_orderkey", "s1|", 20, 120)


@query(
    """WITH s AS (SELECT o_custkey AS g, count(*) AS size, sha256('k5' || CAST(o_custkey AS VARCHAR)) AS h FROM orders GROUP BY 1), r AS (SELECT *, sum(size) OVER (ORDER BY h) - size AS before FROM s) SELECT g, size, before::BIGINT AS before FROM r WHERE before < 5000"""
)
def k5_ml11_take_groups_until(spark, sf_dir):
    """Whole groups in hash order until 5000 rows: a group-disjoint stage split."""
    return C.take_until(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g")), "g", "k5", 5000)


@query(
    """(SELECT 'best' AS which, s_suppkey AS id FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) UNION ALL (SELECT 'worst', s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 1) UNION ALL (SELECT 'middle', s_suppkey FROM supplier ORDER BY abs(s_acctbal - 4500), s_suppkey LIMIT 1)"""
)
def k6_select_cases(spark, sf_dir):
    return S.extremes(table(spark, sf_dir, "supplier"), "s_suppkey", {"best": F.desc("s_acctbal"), "worst": F.asc("s_acctbal"), "middle": F.abs(F.col("s_acctbal") - 4500).asc()})


@query("SELECT o_orderkey AS id, 'order' AS kind, o_totalprice AS v, NULL::VARCHAR AS segment FROM orders UNION ALL SELECT c_custkey, 'customer', c_acctbal, c_mktsegment FROM customer")
def s1_union_by_name(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_totalprice").alias("v"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("segment"))
    return S.concatenated([o, c])


@query("SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS first_order FROM orders GROUP BY 1")
def s2_first_by_key(spark, sf_dir):
    return C.first_by_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)) AS shared, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS missing, (SELECT count(*) FROM (SELECT n_nationkey FROM nation UNION SELECT s_nationkey FROM supplier)) AS codes")
def s3_s4_set_audit(spark, sf_dir):
    """Sizes of an intersection, a difference and a union."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return S.set_sizes(
        shared=S.common_keys(*(o.where(F.col("o_orderkey") % 2 == k).select("o_custkey") for k in (0, 1))),
        missing=c.select("c_custkey").subtract(o.select("o_custkey")),
        codes=table(spark, sf_dir, "nation").select("n_nationkey").union(table(spark, sf_dir, "supplier").select("s_nationkey")),
    )


@query(
    """WITH p AS (SELECT l_suppkey AS g, l_quantity AS x, l_discount AS y, l_orderkey, l_linenumber, l_partkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY g, x, y ORDER BY l_orderkey, l_linenumber, l_partkey) AS r, count(*) OVER (PARTITION BY g, x, y) AS c FROM p)
 SELECT g, count(*) FILTER (r = 1) AS kept, max(c) > 1 AS rejected FROM r GROUP BY g"""
)
def s5_distinct_positions(spark, sf_dir):
    """Distinct positions of a complex, and whether the strict builder rejects it."""
    return S.distinct_places(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "g"), ["g"], ["l_quantity", "l_discount"])
