"""Calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as C
from .fixtures import PROBABILITIES, probabilities, table
from .registry import query

_CLIP = "greatest(least(p, 1 - 1e-6), 1e-6)"


@query(
    f"""WITH {PROBABILITIES} SELECT lang, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier,
 round(avg(CASE WHEN y = 1 THEN -ln({_CLIP}) ELSE -ln(1 - {_CLIP}) END), 6) AS nll FROM probs GROUP BY lang"""
)
def m10_brier_nll(spark, sf_dir):
    return C.scores(probabilities(spark, sf_dir), ["lang"], "y", "p").select("lang", "n", F.round("brier", 6).alias("brier"), F.round("nll", 6).alias("nll"))


_BINS = "b AS (SELECT lang, CAST(least(floor(p * 15), 14) AS INT) AS bin, count(*) AS n, avg(y::DOUBLE) AS observed, avg(p) AS predicted FROM probs GROUP BY 1, 2)"


@query(f"WITH {PROBABILITIES}, {_BINS} SELECT lang, round(sum(n * abs(observed - predicted)) / sum(n)::DOUBLE, 6) AS ece FROM b GROUP BY lang")
def m11_ece(spark, sf_dir):
    return C.ece(probabilities(spark, sf_dir), ["lang"], "y", "p").select("lang", F.round("ece", 6).alias("ece"))


@query(f"WITH {PROBABILITIES}, {_BINS} SELECT lang, bin, n, round(observed, 6) AS observed, round(predicted, 6) AS predicted FROM b")
def m11_reliability(spark, sf_dir):
    return C.reliability(probabilities(spark, sf_dir), ["lang"], "y", "p").select("lang", "bin", "n", F.round("observed", 6).alias("observed"), F.round("predicted", 6).alias("predicted"))


@query(
    f"""WITH {PROBABILITIES}, t AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY lang) AS n,
 sum(CAST(CAST(p >= 0.5 AS INT) <> y AS INT)) OVER (PARTITION BY lang ORDER BY abs(p - 0.5) DESC, doc_id ROWS UNBOUNDED PRECEDING) AS wrong FROM probs WINDOW w AS (PARTITION BY lang ORDER BY abs(p - 0.5) DESC, doc_id)),
 r AS (SELECT *, wrong::DOUBLE / k AS risk FROM t), a AS (SELECT lang, (risk + lag(risk) OVER (PARTITION BY lang ORDER BY k)) / 2 / n AS area FROM r)
 SELECT lang, round(sum(area), 6) AS risk_auc FROM a GROUP BY lang"""
)
def m12_risk_coverage(spark, sf_dir):
    return C.risk_coverage_auc(probabilities(spark, sf_dir), ["lang"], "y", "p", ["doc_id"]).select("lang", F.round("risk_auc", 6).alias("risk_auc"))


@query(
    f"""WITH {PROBABILITIES}, z AS (SELECT y, ln(greatest(least(p, 1 - 1e-5), 1e-5) / (1 - greatest(least(p, 1 - 1e-5), 1e-5))) AS z FROM probs),
 g AS (SELECT y, t, 1 / (1 + exp(-greatest(least(z / t, 60), -60))) AS p FROM z CROSS JOIN (VALUES (0.5::DOUBLE), (1.0), (2.0), (4.0), (8.0)) v(t))
 SELECT t, round(avg(CASE WHEN y = 1 THEN -ln({_CLIP}) ELSE -ln(1 - {_CLIP}) END), 5) AS nll FROM g GROUP BY t"""
)
def m14_temperature_grid(spark, sf_dir):
    """Likelihood of each temperature; the fitted one is the least."""
    z = probabilities(spark, sf_dir).select("y", C.logit(F.col("p")).alias("z"))
    return C.temperature(z, "y", "z", [0.5, 1.0, 2.0, 4.0, 8.0]).select("t", F.round("nll", 5).alias("nll"))


@query()
def m14_platt(spark, sf_dir):
    """Platt scaling fitted on even documents, its ECE before and after on odd ones."""
    z = probabilities(spark, sf_dir).withColumn("z", C.logit(F.col("p")))
    slope, intercept = C.platt(z.where("doc_id % 2 = 0"), "y", "z")
    held = z.where("doc_id % 2 = 1").withColumn("q", C.sigmoid(F.col("z") * slope + intercept)).withColumn("all", F.lit(1))
    return C.ece(held, ["all"], "y", "p").withColumnRenamed("ece", "before").join(C.ece(held, ["all"], "y", "q").withColumnRenamed("ece", "after"), "all").select("before", "after", F.lit(slope).alias("slope"), F.lit(intercept).alias("intercept"))


@query(
    """WITH z AS (SELECT s_nationkey AS g, CAST(s_suppkey % 3 = 0 AS INT) AS y, s_acctbal / 100 AS z FROM supplier), q AS (SELECT g, y, 1 / (1 + exp(-greatest(least(z, 60), -60))) AS p FROM z)
 SELECT g, round(avg(pow(p - y, 2)), 6) AS brier FROM q GROUP BY g"""
)
def m15_metrics_from_logits(spark, sf_dir):
    z = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), (F.col("s_suppkey") % 3 == 0).cast("int").alias("y"), C.sigmoid(F.col("s_acctbal") / 100).alias("p"))
    return C.scores(z, ["g"], "y", "p").select("g", F.round("brier", 6).alias("brier"))
