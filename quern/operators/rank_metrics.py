"""Grouped and pooled ranking metrics.

Average precision and AUROC merge equal scores; top-k metrics take equal scores in the order
of a tie column.  A metric that a group does not define is NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _above(group: list[str], order: list) -> Window:
    return Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


#: Rows of a group that one task takes in order; a larger group is cut into pieces of about as many.
PIECE_ROWS = 1 << 19


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)), F.lit(True))


def in_pieces(df: DataFrame, group: list[str], value: str, tie: tuple[str, ...] = (), rows: int | None = None, pieces: int | None = None) -> tuple[DataFrame, bool]:
    """df, written, with _piece and _sub, and whether any group was cut.

    A group of more than `rows` rows (without it PIECE_ROWS, or what makes `pieces` pieces of the largest group) is cut at quantiles of its own values into
    as many pieces as it needs; _piece ascends with value.  A value that
    fills a piece has one to itself, cut again by _sub, ascending with the first tie column (a number, date or text).
    """
    from ..sources.sinks import kept_table

    kept = kept_table(df)
    most = kept.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    rows = rows or (PIECE_ROWS if pieces is None else max(1, -(-most // pieces)))
    if most <= rows:
        return kept.withColumn("_piece", F.lit(0)).withColumn("_sub", F.lit(0)), False
    n = -(-most // rows)
    own = [f"_g{i}" for i in range(len(group))]
    # a row for each group of more than `rows` rows
    cuts = kept.groupBy(*(F.col(g).alias(o) for g, o in zip(group, own))).agg(F.count("*").alias("_size"), F.percentile_approx(value, [i / n for i in range(1, n)], max(1000, 20 * n)).alias("_cuts")).where(F.col("_size") > rows)
    cuts = kept_table(cuts)
    few = cuts.count() * n <= 1_000_000
    full = F.filter("_cuts", lambda c, i: (i > 0) & (c == F.get("_cuts", i - 1)))
    heavy = F.coalesce(F.array_contains(full, F.col(value)), F.lit(False))
    below = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col(value)))).otherwise(0)
    placed = kept.join(F.broadcast(cuts) if few else cuts, _same(group, own), "left").withColumn("_full", heavy)
    placed = placed.withColumn("_piece", 2 * below + F.col("_full").cast("int")).drop(*own, "_size", "_cuts")
    if not tie or not cuts.where(F.size(full) > 0).limit(1).count():
        return placed.drop("_full").withColumn("_sub", F.lit(0)), True
    light, dense = (placed.where(c).drop("_full") for c in (~F.col("_full"), F.col("_full")))
    inner, _ = in_pieces(dense.withColumnRenamed("_piece", "_outer"), [*group, value], tie[0], (), rows)
    inner = inner.drop("_sub").withColumnRenamed("_piece", "_sub").withColumnRenamed("_outer", "_piece")
    return light.withColumn("_sub", F.lit(0)).unionByName(inner), True


def running_sums(df: DataFrame, group: list[str], value: str, sums: dict[str, str], tie: tuple[str, ...] = (), descending: bool = True, rows: int | None = None, pieces: int | None = None) -> DataFrame:
    """df with the total of columns (name: column) over the rows of its group up to each row, in order of value, then tie.

    Each piece of a group (see in_pieces) is summed by itself and starts from the totals of the pieces before it, so no task orders
    more than about `rows` rows, however large a group is or however often a value repeats (if tie columns tell its rows apart).
    """
    columns = df.columns
    df, cut = in_pieces(df, group, value, tie, rows, pieces)
    way = F.desc if descending else F.asc
    if not cut:
        w = _above(group, [way(value), *tie])
        return df.select(*columns, *(F.sum(c).over(w).alias(n) for n, c in sums.items()))
    before = Window.partitionBy(*group).orderBy(way("_piece"), "_sub").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, "_piece", "_sub").agg(*(F.sum(c).alias(f"_t{n}") for n, c in sums.items()))  # a row a piece
    own = [f"_g{i}" for i in range(len(group))]
    starts = totals.select(*(F.col(g).alias(o) for g, o in zip(group, own)), F.col("_piece").alias("_p"), F.col("_sub").alias("_q"), *(F.coalesce(F.sum(f"_t{n}").over(before), F.lit(0)).alias(f"_s{n}") for n in sums))
    within = Window.partitionBy(*group, "_piece", "_sub").orderBy(way(value), *tie).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.select("*", *(F.sum(c).over(within).alias(f"_w{n}") for n, c in sums.items()))
    both = summed.join(starts, _same([*group, "_piece", "_sub"], [*own, "_p", "_q"]))
    return both.select(*columns, *((F.col(f"_s{n}") + F.col(f"_w{n}")).alias(n) for n in sums))


def ap_and_auroc(df: DataFrame, group: list[str], label: str, score: str, pieces: int | None = None, weight: str | None = None) -> DataFrame:
    """ap, auroc, prevalence and n of each group from the same partial sums, in one pass over the scores, large groups in pieces; weights are multiplicities."""
    positives, number = (F.sum(F.col(label) * F.col(weight)), F.sum(weight)) if weight else (F.sum(label), F.count("*"))
    t = df.groupBy(*group, score).agg(positives.cast("double").alias("_tp"), number.cast("double").alias("_n"))
    t = running_sums(t, group, score, {"_ctp": "_tp", "_cn": "_n"}, pieces=pieces)
    tp, fp = F.col("_tp"), F.col("_n") - F.col("_tp")
    p, n = F.sum("_tp"), F.sum(fp)
    # positives win against all negatives but those at their score, half, and above
    lost = F.sum(tp * (F.col("_cn") - F.col("_ctp") - fp / 2))
    return t.groupBy(*group).agg(
        (F.sum(tp * F.col("_ctp") / F.col("_cn")) / F.nullif(p, F.lit(0.0))).alias("ap"),
        (1 - lost / F.nullif(p * n, F.lit(0.0))).alias("auroc"),
        (p / F.sum("_n")).alias("prevalence"),
        F.sum("_n").cast("bigint").alias("n"),
    )


def average_precision(df: DataFrame, group: list[str], label: str, score: str, weight: str | None = None, name: str = "ap", pieces: int | None = 1) -> DataFrame:
    """Tie-aware average precision of each group; weights are multiplicities.  Partial sums by
    (group, score) are formed before the shuffle; pieces: None where groups may hold very many scores, which
    are then ranked in as many pieces as they need; 1 ranks each group in one."""
    w = F.col(weight) if weight else F.lit(1)
    t = df.groupBy(*group, score).agg(F.sum(F.col(label) * w).alias("_tp"), F.sum(w).alias("_n"))
    if pieces != 1:
        t = running_sums(t, group, score, {"_ctp": "_tp", "_cn": "_n"}, pieces=pieces)
        part = F.col("_ctp").cast("double") / F.nullif(F.col("_cn"), F.lit(0))
        return t.groupBy(*group).agg((F.sum(F.col("_tp") * part) / F.nullif(F.sum("_tp"), F.lit(0))).alias(name))
    down = _above(group, [F.desc(score)])
    t = t.select(*group, "_tp", F.sum("_tp").over(down).alias("_ctp"), F.sum("_n").over(down).alias("_cn"), F.sum("_tp").over(Window.partitionBy(*group)).alias("_p"))
    term = F.col("_tp").cast("double") / F.nullif(F.col("_p"), F.lit(0)) * (F.col("_ctp").cast("double") / F.nullif(F.col("_cn"), F.lit(0)))
    return t.groupBy(*group).agg(F.sum(term).alias(name))


def auroc(df: DataFrame, group: list[str], label: str, score: str, weight: str | None = None, name: str = "auroc") -> DataFrame:
    """Area under the ROC curve: positives above negatives, ties half; NULL for one class."""
    w = F.col(weight) if weight else F.lit(1)
    t = df.groupBy(*group, score).agg(F.sum(F.col(label) * w).alias("_tp"), F.sum(w).alias("_n"))
    up = _above(group, [F.asc(score)])
    t = t.withColumn("_fp", F.col("_n") - F.col("_tp"))
    t = t.select(*group, "_tp", "_fp", (F.sum("_fp").over(up) - F.col("_fp")).alias("_below"))
    wins = F.sum(F.col("_tp").cast("double") * (F.col("_below") + F.col("_fp") / 2))
    return t.groupBy(*group).agg((wins / F.nullif(F.sum("_tp").cast("double") * F.sum("_fp"), F.lit(0.0))).alias(name))


def pooled(df: DataFrame, label: str, score: str, pieces: int | None = None, weight: str | None = None) -> DataFrame:
    """Average precision, AUROC, prevalence and count over all rows, as one row; no task ranks all of them."""
    return ap_and_auroc(df, [], label, score, pieces, weight)


def with_both_classes(df: DataFrame, group: list[str], label: str) -> DataFrame:
    """Rows of groups that have positives and negatives; other evaluations keep groups of positives alone (their AP is 1)."""
    w = Window.partitionBy(*group)
    return df.withColumn("_lo", F.min(label).over(w)).withColumn("_hi", F.max(label).over(w)).where("_lo = 0 and _hi = 1").drop("_lo", "_hi")


def top_order(df: DataFrame, group: list[str], score: str, tie: list[str], name: str = "rank") -> DataFrame:
    """Place of each row in its group: score descending, then the tie columns; NULL scores last."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(F.desc_nulls_last(score), *tie)))


def top_metrics(df: DataFrame, group: list[str], label: str, score: str, tie: list[str], ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """n, positives, hit@1, and precision, recall and hit at each k and at P (the number of positives), IoU@P
    and enrichment@P.  Recall divides by all positives, precision by min(k, n)."""
    ranked = top_order(df, group, score, tie).withColumn("_p", F.sum(label).over(Window.partitionBy(*group)))
    at = lambda k: F.sum(F.when(F.col("rank") <= k, F.col(label)).otherwise(0)).cast("double")
    out = [F.count("*").alias("n"), F.sum(label).cast("bigint").alias("positives"), at(1).alias("_1"), at(F.col("_p")).alias("_tp"), *(at(k).alias(f"_{k}_") for k in ks)]
    got = ranked.groupBy(*group).agg(*out)
    p = F.nullif(F.col("positives"), F.lit(0)).cast("double")
    made = [F.col("n"), F.col("positives"), F.when(p.isNotNull(), F.col("_1")).alias("hit_at_1")]
    for k in ks:
        hits = F.col(f"_{k}_")
        made += [
            F.when(p.isNotNull(), hits / F.least(F.lit(k), F.col("n"))).alias(f"precision_at_{k}"),
            (hits / p).alias(f"recall_at_{k}"),
            F.when(p.isNotNull(), (hits > 0).cast("int")).alias(f"hit_at_{k}"),
        ]
    tp = F.col("_tp")
    made += [(tp / p).alias("precision_at_p"), (tp / (2 * p - tp)).alias("iou_at_p"), ((tp / p) / (p / F.col("n"))).alias("enrichment_at_p")]
    return got.select(*group, *made)


def mid_rank(group: list[str], value: str, ascending: bool = True) -> Column:
    """Average rank of ties."""
    order = F.asc(value) if ascending else F.desc(value)
    return F.rank().over(Window.partitionBy(*group).orderBy(order)) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / F.lit(2.0)


def spearman(df: DataFrame, group: list[str], a: str, b: str, name: str = "rho") -> DataFrame:
    """Rank correlation with mid-ranks; NULL below 3 rows or without variance."""
    r = df.withColumn("_a", mid_rank(group, a)).withColumn("_b", mid_rank(group, b))
    spread = (F.var_pop("_a") > 0) & (F.var_pop("_b") > 0) & (F.count("*") >= 3)
    return r.groupBy(*group).agg(F.when(spread, F.corr("_a", "_b")).alias(name))


def group_rank(group: list[str], order: list) -> Column:
    """Place in the group as a part of 1, ascending; 0.5 for a row by itself."""
    n = F.count("*").over(Window.partitionBy(*group))
    return F.when(n == 1, 0.5).otherwise((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / F.nullif(n - 1, F.lit(0)))


def group_zscore(group: list[str], value: str) -> Column:
    """Standard score in the group by the population deviation; 0 where that is at most 1e-12."""
    w = Window.partitionBy(*group)
    spread = F.stddev_pop(value).over(w)
    return F.when(spread <= 1e-12, 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / F.nullif(spread, F.lit(0.0)))


def holm(df: DataFrame, group: list[str], p: str, tie: str, name: str = "p_holm") -> DataFrame:
    """Holm's step-down adjustment of p values within each group."""
    w = Window.partitionBy(*group).orderBy(p, tie)
    raw = F.col(p) * (F.count("*").over(Window.partitionBy(*group)) - F.row_number().over(w) + 1)
    stepped = df.withColumn("_raw", raw)
    return stepped.withColumn(name, F.least(F.lit(1.0), F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")


def mean_summary(df: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """Rows, defined values, mean and sample deviation (NULL for one row) of each value by group."""
    out = [F.count("*").alias("groups")]
    for v in values:
        out += [F.count(v).alias(f"{v}_n"), F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd")]
    return df.groupBy(*group).agg(*out)
