"""Calibration of probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank_metrics import running_sums


def clipped(p: Column, eps: float = 1e-6) -> Column:
    return F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))


def sigmoid(z: Column, limit: float = 60.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(limit)), F.lit(-limit))))


def logit(p: Column, eps: float = 1e-5) -> Column:
    q = clipped(p, eps)
    return F.log(q / (1 - q))


def nll(label: Column, p: Column) -> Column:
    q = clipped(p)
    return -F.when(label == 1, F.log(q)).otherwise(F.log(1 - q))


def scores(df: DataFrame, group: list[str], label: str, p: str) -> DataFrame:
    """n, Brier score and negative log-likelihood of each group."""
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier"), F.avg(nll(F.col(label), F.col(p))).alias("nll"))


def reliability(df: DataFrame, group: list[str], label: str, p: str, bins: int = 15) -> DataFrame:
    """n, mean label and mean probability of each equal-width bin, the last one closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(*group, b).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("observed"), F.avg(p).alias("predicted"))


def ece(df: DataFrame, group: list[str], label: str, p: str, bins: int = 15) -> DataFrame:
    """Expected calibration error: bins weighted by their rows."""
    b = reliability(df, group, label, p, bins)
    gap = F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted")))
    return b.groupBy(*group).agg((gap / F.sum("n").cast("double")).alias("ece"))


def risk_coverage_auc(df: DataFrame, group: list[str], label: str, p: str, tie: list[str]) -> DataFrame:
    """Area under error rate against coverage, rows by confidence |p - 1/2| descending (then tie), trapezoids.

    Each row's place and errors up to it give its risk and that of the row before, so confidences are ranked in pieces.
    """
    wrong = ((F.col(p) >= 0.5).cast("int") != F.col(label)).cast("int")
    t = df.select(*group, *tie, F.abs(F.col(p) - 0.5).alias("_sure"), wrong.alias("_wrong"), F.lit(1).alias("_one"))
    t = running_sums(t, group, "_sure", {"_k": "_one", "_errors": "_wrong"}, tuple(tie))
    both = F.col("_errors") / F.col("_k") + (F.col("_errors") - F.col("_wrong")) / F.nullif(F.col("_k") - 1, F.lit(0))
    return t.groupBy(*group).agg((F.sum(both / 2) / F.count("*")).alias("risk_auc"))


def temperature(df: DataFrame, label: str, z: str, grid: list[float]) -> DataFrame:
    """Negative log-likelihood of logits divided by each temperature of a grid."""
    each = df.select(label, z, F.explode(F.array(*map(F.lit, grid))).alias("t"))
    return each.groupBy("t").agg(F.avg(nll(F.col(label), sigmoid(F.col(z) / F.col("t")))).alias("nll"))


def platt(df: DataFrame, label: str, z: str) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of the label on one logit."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[z], outputCol="features").transform(df.select(label, z))
    fit = LogisticRegression(labelCol=label, regParam=1e-8, maxIter=200, tol=1e-10).fit(rows)
    return float(fit.coefficients[0]), float(fit.intercept)
