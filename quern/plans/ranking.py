"""Ranking metrics, windows and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rank_metrics as M
from ..operators import selection as S
from .fixtures import ITEMS, PROBABILITIES, SCORED, probabilities, ranked_items, scored_items, table
from .registry import query


def _rounded(df: DataFrame, keep: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *(F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes if c not in keep))


def _ap_sql(rel: str, group: str, score: str, w: str = "1") -> str:
    return f"""SELECT {group}, sum(CASE WHEN p > 0 THEN tp::DOUBLE / p * (ctp::DOUBLE / cn) END) AS ap FROM (
      SELECT {group}, tp, sum(tp) OVER (PARTITION BY {group} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS ctp,
        sum(n) OVER (PARTITION BY {group} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn, sum(tp) OVER (PARTITION BY {group}) AS p
      FROM (SELECT {group}, {score} AS s, sum(y * {w}) AS tp, sum({w}) AS n FROM {rel} GROUP BY {group}, {score})) GROUP BY {group}"""


def _auroc_sql(rel: str, group: str, score: str) -> str:
    return f"""SELECT {group}, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN
      (sum(CASE WHEN y = 1 THEN mid END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * sum(1 - y)) END AS auroc FROM (
      SELECT *, rank() OVER (PARTITION BY {group} ORDER BY {score}) + (count(*) OVER (PARTITION BY {group}, {score}) - 1) / 2.0::DOUBLE AS mid FROM {rel}) GROUP BY {group}"""


_TOP = """ranked AS (SELECT *, row_number() OVER (PARTITION BY g, method ORDER BY score DESC, idx) AS r, sum(y) OVER (PARTITION BY g, method) AS p FROM scored)"""


@query(
    f"""WITH {SCORED}, {_TOP}, ap AS ({_ap_sql('scored', 'g, method', 'score')}),
 top AS (SELECT g, method, sum(CASE WHEN r <= p THEN y ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN r <= 10 THEN y ELSE 0 END)::DOUBLE AS t10, sum(y)::DOUBLE AS p FROM ranked GROUP BY g, method),
 per AS (SELECT method, ap, tp / (2 * p - tp) AS iou, t10 / p AS rec FROM top JOIN ap USING (g, method))
 SELECT method, count(*) AS complexes, count(ap) AS evaluated, round(avg(ap), 6) AS mean_ap, round(stddev_samp(ap), 6) AS sd_ap, round(avg(iou), 6) AS mean_iou, round(avg(rec), 6) AS mean_recall_10 FROM per GROUP BY method"""
)
def headline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 M3 M4 A6: AP, IoU@P and recall@10 of each complex and method, and their means."""
    items = scored_items(spark, sf_dir)
    per = M.average_precision(items, ["g", "method"], "y", "score").join(M.top_metrics(items, ["g", "method"], "y", "score", ["idx"]), ["g", "method"])
    out = M.mean_summary(per, ["method"], ["ap", "iou_at_p", "recall_at_10"])
    return out.select(
        "method",
        F.col("groups").alias("complexes"),
        F.col("ap_n").alias("evaluated"),
        F.round("ap_mean", 6).alias("mean_ap"),
        F.round("ap_sd", 6).alias("sd_ap"),
        F.round("iou_at_p_mean", 6).alias("mean_iou"),
        F.round("recall_at_10_mean", 6).alias("mean_recall_10"),
    )


@query(f"WITH {ITEMS} SELECT g, round(ap, 6) AS ap FROM ({_ap_sql('items', 'g', 'sa')})")
def m1_average_precision(spark, sf_dir):
    return _rounded(M.average_precision(ranked_items(spark, sf_dir), ["g"], "y", "sa"), ["g"])


@query(f"WITH {ITEMS} SELECT g, round(auroc, 6) AS auroc FROM ({_auroc_sql('items', 'g', 'sa')})")
def m2_auroc(spark, sf_dir):
    return _rounded(M.auroc(ranked_items(spark, sf_dir), ["g"], "y", "sa"), ["g"])


@query(
    f"""WITH {SCORED}, {_TOP}, t AS (SELECT g, method, count(*) AS n, sum(y) AS positives, max(CASE WHEN r = 1 THEN y END)::DOUBLE AS h1,
 sum(CASE WHEN r <= p THEN y ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN r <= 5 THEN y ELSE 0 END)::DOUBLE AS t5, sum(CASE WHEN r <= 10 THEN y ELSE 0 END)::DOUBLE AS t10 FROM ranked GROUP BY g, method)
 SELECT g, method, n, positives::BIGINT AS positives, round(h1, 6) AS hit_at_1, round(t5 / least(5, n), 6) AS precision_at_5, round(t5 / positives, 6) AS recall_at_5, CAST(t5 > 0 AS INT) AS hit_at_5,
 round(t10 / least(10, n), 6) AS precision_at_10, round(t10 / positives, 6) AS recall_at_10, CAST(t10 > 0 AS INT) AS hit_at_10, round(tp / positives, 6) AS precision_at_p,
 round(tp / (2.0::DOUBLE * positives - tp), 6) AS iou_at_p, round((tp / positives) / (positives::DOUBLE / n), 6) AS enrichment_at_p FROM t WHERE positives > 0"""
)
def m3_m4_m5_top_metrics(spark, sf_dir):
    """IoU@P, recall, precision and hit at k, enrichment@P of each complex and method."""
    return _rounded(M.top_metrics(scored_items(spark, sf_dir), ["g", "method"], "y", "score", ["idx"]).where("positives > 0"), ["g", "method"])


@query(
    f"""WITH {SCORED}, one AS (SELECT method AS m, y, score FROM scored), ap AS ({_ap_sql('one', 'm', 'score')}), au AS ({_auroc_sql('one', 'm', 'score')}),
 gap AS ({_ap_sql('scored', 'g, method', 'score')}), gau AS ({_auroc_sql('scored', 'g, method', 'score')})
 SELECT m AS method, round(ap.ap, 6) AS pooled_ap, round(au.auroc, 6) AS pooled_auroc,
 (SELECT round(avg(gap.ap), 6) FROM gap WHERE gap.method = m) AS macro_ap, (SELECT round(avg(gau.auroc), 6) FROM gau WHERE gau.method = m) AS macro_auroc,
 (SELECT round(avg(y), 6) FROM items) AS prevalence FROM ap JOIN au USING (m)"""
)
def m6_pooled_and_macro(spark, sf_dir):
    """Pooled and macro AP and AUROC of each method, and prevalence."""
    items = scored_items(spark, sf_dir)
    macro = M.average_precision(items, ["g", "method"], "y", "score").join(M.auroc(items, ["g", "method"], "y", "score"), ["g", "method"])
    macro = macro.groupBy("method").agg(F.avg("ap").alias("macro_ap"), F.avg("auroc").alias("macro_auroc"))
    one = M.ap_and_auroc(items, ["method"], "y", "score").select("method", F.col("ap").alias("pooled_ap"), F.col("auroc").alias("pooled_auroc"), "prevalence")
    return _rounded(one.join(macro, "method"), ["method"])


@query(
    f"""WITH {PROBABILITIES}, s AS (SELECT 'quality' AS kind, y, p FROM probs UNION ALL SELECT 'toxic', toxic, p FROM probs), ap AS ({_ap_sql('s', 'kind', 'p')}), au AS ({_auroc_sql('s', 'kind', 'p')}),
 f AS (SELECT kind, sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.5 AND y = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN p < 0.5 AND y = 1 THEN 1 ELSE 0 END) AS fn FROM s GROUP BY kind)
 SELECT kind, round(ap, 6) AS ap, round(auroc, 6) AS auroc, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM ap JOIN au USING (kind) JOIN f USING (kind)"""
)
def m7_multilabel(spark, sf_dir):
    """AP, AUROC and F1 at 0.5 of each label kind."""
    long = probabilities(spark, sf_dir).selectExpr("stack(2, 'quality', y, 'toxic', toxic) as (kind, y)", "p")
    called = F.col("p") >= 0.5
    count = lambda c: F.count_if(c)
    tp, fp, fn = count(called & (F.col("y") == 1)), count(called & (F.col("y") == 0)), count(~called & (F.col("y") == 1))
    f1 = long.groupBy("kind").agg((2.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1"))
    return _rounded(M.average_precision(long, ["kind"], "y", "p").join(M.auroc(long, ["kind"], "y", "p"), "kind").join(f1, "kind"), ["kind"])


@query(
    """WITH r AS (SELECT l_suppkey AS g, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)
 SELECT g, round(corr(a, b), 6) AS rho FROM r GROUP BY g HAVING count(*) >= 3"""
)
def m8_spearman(spark, sf_dir):
    return _rounded(M.spearman(ranked_items(spark, sf_dir, dealt=True), ["g"], "d", "sb"), ["g"])


@query(f"WITH {ITEMS}, w AS (SELECT *, CAST(d AS BIGINT) % 4 AS m FROM items) SELECT g, round(ap, 6) AS ap FROM ({_ap_sql('w', 'g', 'sa', 'm')})")
def m9_weighted_ap(spark, sf_dir):
    """AP with multiplicities as weights."""
    items = ranked_items(spark, sf_dir).withColumn("m", F.col("d").cast("bigint") % 4)
    return _rounded(M.average_precision(items, ["g"], "y", "sa", "m"), ["g"])


@query(
    f"""WITH {ITEMS}, w AS (SELECT g, sa, sum(y * (d::BIGINT % 4))::DOUBLE AS tp, sum((1 - y) * (d::BIGINT % 4))::DOUBLE AS fp FROM items GROUP BY g, sa),
 c AS (SELECT *, sum(fp) OVER (PARTITION BY g ORDER BY sa ROWS UNBOUNDED PRECEDING) - fp AS below FROM w)
 SELECT g, round(sum(tp * (below + fp / 2)) / nullif(sum(tp) * sum(fp), 0), 6) AS auroc FROM c GROUP BY g"""
)
def m9_weighted_auroc(spark, sf_dir):
    items = ranked_items(spark, sf_dir).withColumn("m", F.col("d").cast("bigint") % 4)
    return _rounded(M.auroc(items, ["g"], "y", "sa", "m"), ["g"])


@query(f"WITH {PROBABILITIES}, au AS ({_auroc_sql('probs', 'lang', 'p')}) SELECT count(auroc) AS targets, round(avg(auroc), 6) AS mean_auroc FROM au")
def m13_target_auroc(spark, sf_dir):
    """Mean AUROC over targets with both classes."""
    return M.auroc(probabilities(spark, sf_dir), ["lang"], "y", "p").agg(F.count("auroc").alias("targets"), F.round(F.avg("auroc"), 6).alias("mean_auroc"))


@query(
    f"""WITH {ITEMS}, t AS (SELECT g, l.kind, CASE WHEN l.kind = 'R' THEN y ELSE CAST(d > 45 AS INT) END AS y, sb AS score, idx FROM items CROSS JOIN (VALUES ('R'), ('far')) l(kind)),
 r AS (SELECT *, row_number() OVER (PARTITION BY g, kind ORDER BY score DESC, idx) AS r, sum(y) OVER (PARTITION BY g, kind) AS p FROM t), ap AS ({_ap_sql('t', 'g, kind', 'score')}),
 m AS (SELECT g, kind, sum(CASE WHEN r <= p THEN y ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN r <= 10 THEN y ELSE 0 END)::DOUBLE AS t10, sum(y) AS p FROM r GROUP BY g, kind HAVING sum(y) > 0)
 SELECT kind, count(*) AS complexes, round(avg(ap), 6) AS mean_ap, round(avg(tp / (2 * p - tp)), 6) AS mean_iou, round(avg(t10 / p), 6) AS mean_recall_10 FROM m JOIN ap USING (g, kind) GROUP BY kind"""
)
def m16_per_type_metrics(spark, sf_dir):
    """Metrics of each type, over the complexes that have it."""
    items = ranked_items(spark, sf_dir).selectExpr("g", "idx", "sb as score", "stack(2, 'R', y, 'far', cast(d > 45 as int)) as (kind, y)")
    per = M.average_precision(items, ["g", "kind"], "y", "score").join(M.top_metrics(items, ["g", "kind"], "y", "score", ["idx"]).where("positives > 0"), ["g", "kind"])
    return per.groupBy("kind").agg(F.count("*").alias("complexes"), *(F.round(F.avg(c), 6).alias(n) for c, n in (("ap", "mean_ap"), ("iou_at_p", "mean_iou"), ("recall_at_10", "mean_recall_10"))))


@query(
    f"""WITH {ITEMS}, near AS (SELECT g, y, sb AS score, -d AS nd FROM items WHERE d <= 12), a AS ({_ap_sql('near', 'g', 'score')}), b AS ({_ap_sql('near', 'g', 'nd')})
 SELECT g, round(a.ap, 6) AS typed_ap, round(b.ap, 6) AS distance_ap, round(a.ap - b.ap, 6) AS delta FROM a JOIN b USING (g)"""
)
def m17_channel_diagnostics(spark, sf_dir):
    """AP of a score and of distance over the near pairs of each complex."""
    near = ranked_items(spark, sf_dir).where("d <= 12").withColumn("nd", -F.col("d"))
    both = M.average_precision(near, ["g"], "y", "sb", name="typed_ap").join(M.average_precision(near, ["g"], "y", "nd", name="distance_ap"), "g")
    return _rounded(both.withColumn("delta", F.col("typed_ap") - F.col("distance_ap")), ["g"])


@query(
    f"""WITH {ITEMS}, a AS ({_ap_sql('items', 'g', 'sb')}), b AS ({_ap_sql('items', 'g', 'sa')}), d AS (SELECT round(a.ap - b.ap, 9) AS delta FROM a JOIN b USING (g))
 SELECT count(*) AS pairs, round(avg(delta), 6) AS mean_delta, round(avg(CAST(delta > 1e-12 AS INT)), 6) AS win_rate, round(avg(CAST(abs(delta) <= 1e-12 AS INT)), 6) AS tie_rate FROM d"""
)
def m18_paired_delta(spark, sf_dir):
    items = ranked_items(spark, sf_dir)
    both = M.average_precision(items, ["g"], "y", "sb", name="a").join(M.average_precision(items, ["g"], "y", "sa", name="b"), "g").select(F.round(F.col("a") - F.col("b"), 9).alias("delta"))
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return both.agg(F.count("*").alias("pairs"), F.round(F.avg("delta"), 6).alias("mean_delta"), rate(F.col("delta") > 1e-12).alias("win_rate"), rate(F.abs("delta") <= 1e-12).alias("tie_rate"))


@query(
    f"""WITH {ITEMS}, p AS (SELECT a.g, a.sa - b.sa AS gap FROM items a JOIN items b ON a.g = b.g AND a.y = 1 AND b.y = 0 AND a.d = b.d)
 SELECT g, count(*) AS pairs, round(avg(CASE WHEN gap > 0 THEN 1.0 WHEN gap = 0 THEN 0.5 ELSE 0.0 END::DOUBLE), 6) AS accuracy FROM p GROUP BY g"""
)
def m19_pair_accuracy(spark, sf_dir):
    """Part of (positive, negative) pairs at the same distance that the score orders right, ties half."""
    return S.pair_accuracy(ranked_items(spark, sf_dir), "g", "y", "d", "sa").withColumn("accuracy", F.round("accuracy", 6))


@query(
    f"""WITH {ITEMS}, a AS ({_ap_sql('items', 'g', 'sb')}), b AS ({_ap_sql('items', 'g', 'sa')})
 SELECT g, round(a.ap - b.ap, 6) AS delta FROM a JOIN b USING (g) ORDER BY round(a.ap - b.ap, 9), g LIMIT 10"""
)
def m20_largest_losses(spark, sf_dir):
    items = ranked_items(spark, sf_dir)
    both = M.average_precision(items, ["g"], "y", "sb", name="a").join(M.average_precision(items, ["g"], "y", "sa", name="b"), "g")
    return both.select("g", (F.col("a") - F.col("b")).alias("x")).orderBy(F.round("x", 9), "g").limit(10).select("g", F.round("x", 6).alias("delta"))


@query(
    f"""WITH {ITEMS} SELECT g, idx, round(CASE WHEN count(*) OVER (PARTITION BY g) = 1 THEN 0.5 ELSE (row_number() OVER (PARTITION BY g ORDER BY sb, idx) - 1)::DOUBLE / nullif(count(*) OVER (PARTITION BY g) - 1, 0) END, 6) AS graph_rank,
 round((sb - avg(sb) OVER (PARTITION BY g)) / stddev_pop(sb) OVER (PARTITION BY g), 5) AS zscore FROM items"""
)
def w1_w2_group_rank_zscore(spark, sf_dir):
    return ranked_items(spark, sf_dir, dealt=True).select("g", "idx", F.round(M.group_rank(["g"], ["sb", "idx"]), 6).alias("graph_rank"), F.round(M.group_zscore(["g"], "sb"), 5).alias("zscore"))


@query(
    f"""WITH {ITEMS} SELECT g, idx, rank() OVER (PARTITION BY g ORDER BY sa DESC) AS rank_min,
 round((rank() OVER (PARTITION BY g ORDER BY sa) + (count(*) OVER (PARTITION BY g, sa) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY g), 6) AS rank_pct,
 row_number() OVER (PARTITION BY g ORDER BY sa DESC, idx) AS stable FROM items"""
)
def w3_w4_assayed_ranks(spark, sf_dir):
    """Minimum rank descending, average rank as a part, and the stable order."""
    w = Window.partitionBy("g")
    return ranked_items(spark, sf_dir, dealt=True).select(
        "g",
        "idx",
        F.rank().over(w.orderBy(F.desc("sa"))).cast("bigint").alias("rank_min"),
        F.round(M.mid_rank(["g"], "sa") / F.count("*").over(w), 6).alias("rank_pct"),
        F.row_number().over(w.orderBy(F.desc("sa"), "idx")).cast("bigint").alias("stable"),
    )


@query(
    """WITH c AS (SELECT l_suppkey AS g, count(*) AS n FROM lineitem GROUP BY l_suppkey)
 SELECT g, (sum(n) OVER (ORDER BY g) - n)::BIGINT AS begin, sum(n) OVER (ORDER BY g)::BIGINT AS "end", row_number() OVER (ORDER BY g) - 1 AS code FROM c"""
)
def w6_w9_offsets(spark, sf_dir):
    """First and last row of each group in sorted order, and the group's code, summed over ranges of groups."""
    return S.offsets(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g")), "g")


@query(
    """WITH p AS (SELECT s_nationkey AS cohort, s_suppkey AS id, round((s_acctbal + 1000) / 200000, 6) AS p FROM supplier),
 r AS (SELECT *, p * (count(*) OVER (PARTITION BY cohort) - row_number() OVER (PARTITION BY cohort ORDER BY p, id) + 1) AS raw FROM p)
 SELECT cohort, id, p, round(least(1.0::DOUBLE, max(raw) OVER (PARTITION BY cohort ORDER BY p, id ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM r"""
)
def w7_holm(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cohort"), F.col("s_suppkey").alias("id"), F.round((F.col("s_acctbal") + 1000) / 200000, 6).alias("p"))
    return M.holm(p, ["cohort"], "p", "id").select("cohort", "id", "p", F.round("p_holm", 6).alias("p_holm"))


@query(
    """SELECT p_brand AS dataset, p_partkey AS id, round(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)::DOUBLE / count(*) OVER (PARTITION BY p_brand), 6) AS ecdf FROM part"""
)
def w8_ecdf(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("id"), "p_retailprice")
    return p.select("dataset", "id", F.round(S.ecdf(["dataset"], ["p_retailprice", "id"]), 6).alias("ecdf"))


@query(f"WITH {ITEMS} SELECT g, idx, sb FROM items QUALIFY row_number() OVER (PARTITION BY g ORDER BY sb DESC, idx) <= 3")
def w10_head_per_group(spark, sf_dir):
    return M.top_order(ranked_items(spark, sf_dir), ["g"], "sb", ["idx"]).where("rank <= 3").select("g", "idx", "sb")


@query(
    """SELECT o_orderpriority AS run, max(o_orderkey) FILTER (r = 1) AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) GROUP BY 1"""
)
def w11_a17_best_per_group(spark, sf_dir):
    """The row of the best value of each run, ties by the lower key, as one aggregate."""
    return S.best_row(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "run"), ["run"], "o_totalprice", "o_orderkey")


@query(
    """WITH t AS (SELECT o_custkey AS g, o_totalprice AS score, CAST(o_orderstatus = 'F' AS INT) AS y, o_orderpriority AS chain, CAST(o_orderkey AS VARCHAR) AS number FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, chain, number) AS r FROM t)
 SELECT g, sum(y)::BIGINT AS positives, sum(CASE WHEN r <= 5 THEN y ELSE 0 END)::BIGINT AS top5, sum(CASE WHEN r <= 10 THEN y ELSE 0 END)::BIGINT AS top10 FROM r GROUP BY g HAVING sum(y) > 0"""
)
def k1_topk_recovery(spark, sf_dir):
    """Top 5 and 10 by score, then chain, then number as text, that are in the truth."""
    t = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("g"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_orderpriority").alias("chain"), F.col("o_orderkey").cast("string").alias("number")
    )
    t = M.top_order(t, ["g"], "score", ["chain", "number"])
    top = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("y")).otherwise(0))
    return t.groupBy("g").agg(F.sum("y").alias("positives"), top(5).alias("top5"), top(10).alias("top10")).where("positives > 0")


_SITES = "sites AS (SELECT o_custkey AS g, CAST(o_orderstatus <> 'F' AS INT) AS y, o_totalprice AS s FROM orders)"


@query(
    f"""WITH {_SITES}, k AS (SELECT g FROM sites GROUP BY g HAVING min(y) = 0 AND max(y) = 1), kept AS (SELECT sites.* FROM sites JOIN k USING (g)), a AS ({_ap_sql('kept', 'g', 's')}), u AS ({_ap_sql('sites', 'g', 's')})
 SELECT (SELECT count(ap) FROM a) AS strict_groups, (SELECT round(avg(ap), 6) FROM a) AS strict_ap, count(ap) AS groups, count(*) AS ids, round(avg(ap), 6) AS mean_ap FROM u"""
)
def m6_both_class_groups(spark, sf_dir):
    """Mean AP over groups with both classes, and over all groups with positives; ids counts the undefined ones too."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), (F.col("o_orderstatus") != "F").cast("int").alias("y"), F.col("o_totalprice").alias("s"))
    one = lambda df: df.withColumn("_", F.lit(1))
    strict = M.average_precision(M.with_both_classes(o, ["g"], "y"), ["g"], "y", "s").agg(F.count("ap").alias("strict_groups"), F.round(F.avg("ap"), 6).alias("strict_ap"))
    every = M.average_precision(o, ["g"], "y", "s").agg(F.count("ap").alias("groups"), F.count("*").alias("ids"), F.round(F.avg("ap"), 6).alias("mean_ap"))
    return one(strict).join(one(every), "_").drop("_")
