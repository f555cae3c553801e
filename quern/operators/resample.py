"""Resampling statistics on a counter-based generator.

A draw is a hash of (seed, replicate, place), so any task can make any draw, reruns agree
and methods that share a seed share their draws.  Replicates are rows: nothing loops on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import kept_table
from . import rank_metrics


def draw(*parts: Column | str | int) -> Column:
    """A number from 0 to 2^32 - 1 from the md5 of its parts."""
    parts = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    key = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")


def numbered(df: DataFrame, key: str, name: str = "place") -> DataFrame:
    """df with each row's place by key, from 0; a large table is numbered in pieces (rank_metrics.in_pieces)."""
    got = rank_metrics.running_sums(df.withColumn("_one", F.lit(1)), [], key, {name: "_one"}, descending=False)
    return got.withColumn(name, (F.col(name) - 1).cast("bigint")).drop("_one")


def resampled(df: DataFrame, key: str, replicates: int, seed: str, n: int | None = None) -> DataFrame:
    """Rows of df drawn with replacement, as many as it has, for each replicate: its columns and b."""
    n = df.count() if n is None else n
    spark = df.sparkSession
    if not n:
        return df.withColumn("b", F.lit(0).cast("bigint"))
    draws = spark.range(replicates * n).select(F.floor(F.col("id") / n).cast("bigint").alias("b"), (F.col("id") % n).alias("i"))
    draws = draws.select("b", (draw(seed, F.col("b"), F.col("i")) % n).alias("place"))
    counts = draws.groupBy("b", "place").agg(F.count("*").alias("times"))
    return numbered(df, key).join(counts, "place").drop("place")


#: Draws that one task makes or counts.
DRAWS_BLOCK = 1 << 20


def resampled_within(df: DataFrame, group: str, key: str, replicates: int, seed: str) -> DataFrame:
    """Rows of each group drawn with replacement from the group, as many as it has, for each replicate: df's columns, b and times.

    Methods that stand side by side in df share their draws; groups have draws of their own.  Large groups are numbered in pieces, and
    draws are made in blocks of DRAWS_BLOCK and counted in tasks of about as many, so no task holds a group.
    """
    placed = rank_metrics.running_sums(df.withColumn("_one", F.lit(1)), [group], key, {"place": "_one"}, descending=False)
    placed = kept_table(placed.withColumn("place", (F.col("place") - 1).cast("bigint")).drop("_one"))
    tasks = max(1, -(-placed.count() * replicates // DRAWS_BLOCK))
    sizes = placed.groupBy(group).agg(F.count("*").alias("_n"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint")))
    blocks = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_at", upto(F.ceil(F.col("_n") / DRAWS_BLOCK))).repartition(min(tasks, 2000), group, "b", "_at")
    draws = blocks.withColumn("i", F.explode(F.sequence(F.col("_at") * DRAWS_BLOCK, F.least((F.col("_at") + 1) * DRAWS_BLOCK, F.col("_n")) - 1)))
    draws = draws.select(group, "b", (draw(seed, F.col(group), F.col("b"), F.col("i")) % F.col("_n")).alias("place")).repartition(min(tasks, 2000), group, "place")
    return placed.join(draws.groupBy(group, "b", "place").agg(F.count("*").alias("times")), [group, "place"]).drop("place")


def interval(df: DataFrame, value: str, group: list[str] = []) -> DataFrame:  # noqa: B006
    """Percentile interval (linear interpolation), part above 0, one-sided p and deviation of replicate values."""
    v = F.col(value)
    return df.groupBy(*group).agg(
        F.count(v).alias("replicates"),
        F.percentile(v, 0.025).alias("low"),
        F.percentile(v, 0.975).alias("high"),
        F.avg((v > 0).cast("int")).alias("part_above"),
        ((F.count_if(v <= 0) + 1) / (F.count(v) + 1)).alias("p_one_sided"),
        F.stddev_samp(v).alias("sd"),
    )


def validated_pairs(df: DataFrame, key: str, values: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """df; a ValueError where it has no rows, a null or repeated key, or a value that is null, not finite or outside [low, high]."""
    outside = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) < low) | (F.col(c) > high)
    n, keys, *bad = df.agg(F.count("*"), F.count(key), *(F.count_if(outside(c)) for c in values)).first()
    if not n:
        raise ValueError("no pairs")
    if keys < n or df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} must be there and unique")
    for c, k in zip(values, bad):
        if k:
            raise ValueError(f"{k} values of {c} are missing, not finite or outside [{low}, {high}]")
    return df


def paired_bootstrap(df: DataFrame, key: str, delta: str, replicates: int, seed: str) -> DataFrame:
    """Interval of the mean of paired differences, resampling pairs whole."""
    means = resampled(df.select(key, delta), key, replicates, seed).groupBy("b").agg((F.sum(F.col(delta) * F.col("times")) / F.sum("times")).alias("mean"))
    return interval(means, "mean")


def cluster_bootstrap(df: DataFrame, cluster: str, delta: str, replicates: int, seed: str) -> DataFrame:
    """Interval of the mean, resampling clusters whole: sums over sizes of the clusters drawn."""
    sums = df.groupBy(cluster).agg(F.sum(delta).alias("_sum"), F.count("*").alias("_size"))
    means = resampled(sums, cluster, replicates, seed).groupBy("b").agg((F.sum(F.col("_sum") * F.col("times")) / F.sum(F.col("_size") * F.col("times"))).alias("mean"))
    return interval(means, "mean")


def sign_flip(df: DataFrame, key: str, delta: str, replicates: int, seed: str, slack: float = 1e-15) -> DataFrame:
    """Observed mean and two-sided p of random sign flips, (1 + hits) / (replicates + 1)."""
    observed, n = df.agg(F.avg(delta), F.count("*")).first()
    sign = F.when(draw(seed, F.col("b"), F.col(key)) % 2 == 0, 1).otherwise(-1)
    flips = df.select(key, delta, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b")).groupBy("b").agg((F.sum(F.col(delta) * sign) / F.count("*")).alias("null"))
    hits = F.count_if(F.abs("null") >= abs(observed or 0.0) - slack)
    return flips.agg(F.lit(observed).cast("double").alias("observed"), F.lit(n).cast("bigint").alias("n"), ((1 + hits) / (F.count("*") + 1)).alias("p"))


def cluster_sign_flip(df: DataFrame, cluster: str, delta: str, replicates: int, seed: str, slack: float = 1e-15) -> DataFrame:
    """Observed mean of differences and two-sided p, (1 + hits) / (replicates + 1), of flips of whole clusters: one sign for the sum of each, over all
    rows.  Rows without a difference are left out; those without a cluster are one."""
    sums = df.where(F.col(delta).isNotNull()).groupBy(cluster).agg(F.sum(delta).alias("_sum"), F.count("*").alias("_size"))
    total, n, clusters = sums.agg(F.sum("_sum"), F.sum("_size"), F.count("*")).first()
    observed = total / n if n else None
    sign = F.when(draw(seed, F.col("b"), F.coalesce(F.col(cluster).cast("string"), F.lit(""))) % 2 == 0, 1).otherwise(-1)
    flips = sums.select(cluster, "_sum", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b")).groupBy("b").agg((F.sum(F.col("_sum") * sign) / F.lit(n or 1)).alias("null"))
    hits = F.count_if(F.abs("null") >= abs(observed or 0.0) - slack)
    shown = [F.lit(observed).cast("double").alias("observed"), F.lit(n or 0).cast("bigint").alias("n"), F.lit(clusters).cast("bigint").alias("clusters")]
    return flips.agg(*shown, F.when(F.lit(bool(n)), (1 + hits) / F.lit(replicates + 1)).alias("p"))


def exact_sign_flip(df: DataFrame, key: str, delta: str) -> DataFrame:
    """Two-sided p over all 2^k sign patterns of k rows (k at most 20)."""
    k = df.count()
    if k > 20:
        raise ValueError("exact sign flips are for at most 20 rows")
    placed = numbered(df, key)
    observed = df.agg(F.avg(delta)).first()[0]
    bit = F.expr("shiftright(pattern, cast(place as int)) & 1")
    patterns = placed.select(delta, "place", F.explode(F.sequence(F.lit(0), F.lit(2**k - 1))).alias("pattern"))
    null = patterns.groupBy("pattern").agg((F.sum(F.col(delta) * (1 - 2 * bit)) / F.lit(k)).alias("null"))
    hits = F.count_if(F.abs("null") >= abs(observed or 0.0) - 1e-15)
    return null.agg(F.lit(observed).cast("double").alias("observed"), (hits / F.count("*")).alias("p"))


def blocked_bootstrap_ap(df: DataFrame, block: str, label: str, score: str, replicates: int, seed: str) -> DataFrame:
    """b and pooled average precision, resampling blocks whole.  Rows are first summed by (block, score), so replicates
    multiply those sums and not the rows; replicates without positives have NULL."""
    t = df.groupBy(block, score).agg(F.sum(label).alias("tp"), F.count("*").alias("n"))
    blocks = resampled(df.select(block).distinct(), block, replicates, seed)
    t = blocks.join(t, block).groupBy("b", score).agg(F.sum(F.col("tp") * F.col("times")).alias("tp"), F.sum(F.col("n") * F.col("times")).alias("n"))
    t = rank_metrics.running_sums(t, ["b"], score, {"ctp": "tp", "cn": "n"})
    return t.groupBy("b").agg((F.sum(F.col("tp") * (F.col("ctp") / F.col("cn"))) / F.nullif(F.sum("tp"), F.lit(0))).alias("ap"))


def capped(df: DataFrame, group: list[str], key: str, limit: int, seed: str) -> DataFrame:
    """At most `limit` rows of each group by hash (0: all); the sampling operator of its callers."""
    if not limit:
        return df
    order = Window.partitionBy(*group).orderBy(draw(seed, F.col(key)), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def wilcoxon(df: DataFrame, group: list[str], delta: str) -> DataFrame:
    """Signed-rank sum of positive differences and its one-sided normal z; zeros are left out, ties take mid-ranks."""
    rows = df.where(F.col(delta) != 0).withColumn("_abs", F.abs(delta))
    w = Window.partitionBy(*group)
    rank = F.rank().over(w.orderBy("_abs")) + (F.count("*").over(Window.partitionBy(*group, "_abs")) - 1) / F.lit(2.0)
    got = rows.withColumn("_rank", rank).groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.when(F.col(delta) > 0, F.col("_rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.pow("_rank", F.lit(2.0))).alias("_sq"))
    return got.select(*group, "n", "w_plus", ((F.col("w_plus") - F.col("n") * (F.col("n") + 1) / 4.0) / F.nullif(F.sqrt(F.col("_sq") / 4.0), F.lit(0.0))).alias("z"))
