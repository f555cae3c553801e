"""One-to-one matching inside groups."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import kept_table
from .rank_metrics import running_sums

#: Rows of a group that are matched in one task at least; larger groups are cut where no optimal pair crosses.
SECTION_ROWS = 1 << 16


def match_on_line(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j) that match all of the shorter side at the least total |a[i] - b[j]|.

    A sweep from left to right keeps two heaps: places of the longer side that a later point can take, and points that a later place
    can take over, each with what the change costs on top of the best matching so far (the regret).  Each step uses one place more, or one instead of
    another; on a line an optimal matching keeps order, so the used places, in order, are the partners.  Time is n log n.
    """
    if len(a) > len(b):
        return [(i, j) for j, i in match_on_line(b, a)]
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    x, y = a[oa].tolist(), b[ob].tolist()
    used = [False] * len(y)
    # costs are (points that have no place yet, distance), so that having a place comes before distance
    free: list[tuple[tuple[int, float], int]] = []  # (cost to take the place, less its coordinate), the place that is then used
    taken: list[tuple[tuple[int, float], int]] = []  # (gain of moving a point, less coordinates), the place that is then free
    i = j = 0
    while i < len(x) or j < len(y):
        if j == len(y) or (i < len(x) and x[i] <= y[j]):
            at, i = x[i], i + 1
            if free:
                (lacks, cost), place = heapq.heappop(free)
            else:
                (lacks, cost), place = (1, -at), -1
            if place >= 0:
                used[place] = True
            heapq.heappush(taken, ((-lacks, -(cost + at) - at), place))
        else:
            at, place = y[j], j
            j += 1
            if taken and (taken[0][0][0], taken[0][0][1] + at) < (0, 0.0):
                (lacks, cost), other = heapq.heappop(taken)
                if other >= 0:
                    used[other] = False
                used[place] = True
                heapq.heappush(free, ((-lacks, -(cost + at) - at), other))
            else:
                heapq.heappush(free, ((0, -at), place))
    return sorted((int(oa[k]), int(ob[place])) for k, place in enumerate(p for p in range(len(y)) if used[p]))


def sections(df: DataFrame, group: str, label: str, value: str, order: list[str], rows: int | None = None) -> DataFrame:
    """df (written) with _section: parts of a group, of about `rows` rows where that can be, that an optimal matching does not leave.

    With the smaller side as points and the other as places, in order of value: let every point go right to the first place that is not
    taken.  Where no point is on its way, none needs to cross to the right, as an optimal pair passes no unused place; likewise to the left.  Where
    both hold, the group is cut.  Groups of no more than `rows` rows stay whole, without further passes.
    """
    rows = rows or SECTION_ROWS
    kept = kept_table(df)
    sizes = kept.groupBy(group).agg(F.count("*").alias("_n"), F.count_if(F.col(label) == 1).alias("_p")).where(F.col("_n") > rows)
    sizes = kept_table(sizes.select(F.col(group).alias("_g"), (2 * F.col("_p") <= F.col("_n")).alias("_few")))
    if not sizes.limit(1).count():
        return kept.withColumn("_section", F.lit(0).cast("bigint"))
    same = F.col(group).eqNullSafe(F.col("_g"))
    small = kept.join(sizes, same, "left_anti").withColumn("_section", F.lit(0).cast("bigint"))
    large = kept.join(sizes, same).drop("_g")
    large = large.withColumn("_step", F.when((F.col(label) == 1) == F.col("_few"), 1).otherwise(-1)).withColumn("_one", F.lit(1))
    # places of the rows first; then all is by blocks of places, so that no task orders a large group
    placed = running_sums(large, [group], value, {"_place": "_one"}, tuple(order), descending=False)
    block = F.floor((F.col("_place") - 1) / rows)
    placed = kept_table(placed.withColumn("_block", block))
    own = Window.partitionBy(group, "_block").orderBy("_place")
    placed = placed.withColumn("_balance", F.sum("_step").over(own))
    # of each block: its sum, and the least and greatest balance within it
    blocks = placed.groupBy(group, "_block").agg(F.sum("_step").alias("_sum"), F.min("_balance").alias("_low"), F.max("_balance").alias("_high"))
    each = Window.partitionBy(group).orderBy("_block")
    earlier, later = each.rowsBetween(Window.unboundedPreceding, -1), each.rowsBetween(1, Window.unboundedFollowing)
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    blocks = blocks.withColumn("_low", F.col("_start") + F.col("_low")).withColumn("_high", F.col("_start") + F.col("_high"))
    blocks = blocks.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), "_start", F.least(F.lit(0), F.min("_low").over(earlier)).alias("_below"), F.max("_high").over(later).alias("_above"))
    here = placed.join(blocks, same & (F.col("_block") == F.col("_b"))).withColumn("_balance", F.col("_start") + F.col("_balance"))
    low = F.least(F.col("_below"), F.min("_balance").over(own))
    ahead = F.greatest(F.max("_balance").over(own.rowsBetween(1, Window.unboundedFollowing)), F.col("_above"))  # of those that there are
    # none on its way right: the balance is at its least so far; none on its way left: it does not rise above this again
    cut = (F.col("_balance") <= low) & (F.coalesce(ahead, F.col("_balance")) <= F.col("_balance"))
    here = here.withColumn("_cut", F.when(cut, F.col("_place")))
    # a section starts behind the first cut of each block: there is a cut in a block or there is none
    first = here.groupBy(group, "_block").agg(F.min("_cut").alias("_first"))
    first = first.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), F.col("_first"), F.coalesce(F.max("_first").over(earlier), F.lit(0)).alias("_before"))
    out = here.drop("_g", "_b").join(first, same & (F.col("_block") == F.col("_b")))
    section = F.when(F.col("_place") > F.col("_first"), F.col("_first")).otherwise(F.col("_before")).cast("bigint")
    columns = kept.columns
    return small.unionByName(out.withColumn("_section", section).select(*columns, "_section"))


def matched_pairs(df: DataFrame, group: str, label: str, value: str, score: str | list[str], caliper: float | None, rows: int | None = None) -> DataFrame:
    """group, value gap and score gap of each matched (positive, negative) pair within the caliper (None: all pairs).

    Several scores give a gap each, named after them.  Matching comes first and the caliper after it: a pair outside of it is lost, not
    matched again.  Large groups are matched in sections (see above).  Rows of other labels, or without a finite value, are left out.
    """
    scores = [score] if isinstance(score, str) else list(score)
    won = ["won"] if isinstance(score, str) else [f"{s}_won" for s in scores]
    kind = df.schema[group].dataType.simpleString()
    finite = F.col(value).isNotNull() & (F.abs(F.col(value).cast("double")) < float("inf"))
    asked = df.where(finite & F.col(label).isin(0, 1)).select(group, label, value, *(s for s in scores if s not in (group, label, value)))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([value, *scores])
        pos, neg = part[part[label] == 1], part[part[label] == 0]
        pairs = match_on_line(pos[value].to_numpy(float), neg[value].to_numpy(float))
        i, j = (np.array(x, int) for x in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
        gaps = {w: pos[s].to_numpy(float)[i] - neg[s].to_numpy(float)[j] for w, s in zip(won, scores)}
        out = pd.DataFrame({group: part[group].iloc[0], "gap": np.abs(pos[value].to_numpy(float)[i] - neg[value].to_numpy(float)[j]), **gaps})
        return out if caliper is None else out[out.gap <= caliper]

    order = [s for s in scores if s != value]
    schema = f"{group} {kind}, gap double, " + ", ".join(f"{w} double" for w in won)
    return sections(asked, group, label, value, order, rows).groupBy(group, "_section").applyInPandas(solve, schema)


def matched_by_radius(df: DataFrame, group: str, label: str, value: str, scores: list[str], radii: tuple[float, ...] = (6.0, 8.0), calipers: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5)) -> DataFrame:
    """group, radius, caliper, gap and the gaps of all scores of each matched pair: rows within each radius are matched once, and
    every caliper keeps the pairs that it holds."""
    each = df.withColumn("_radius", F.explode(F.array(*map(F.lit, radii)))).where(F.col(value) <= F.col("_radius"))
    pairs = matched_pairs(each.withColumn("_id", F.to_json(F.struct(F.col(group).alias("g"), "_radius"))), "_id", label, value, scores, None)
    read = F.from_json("_id", f"g {df.schema[group].dataType.simpleString()}, _radius double")
    gaps = [f"{s}_won" for s in scores]
    found = pairs.select(read.alias("_k"), "gap", *gaps).select(F.col("_k.g").alias(group), F.col("_k._radius").alias("radius"), "gap", *gaps)
    return found.withColumn("caliper", F.explode(F.filter(F.array(*map(F.lit, calipers)), lambda c: c >= F.col("gap")))).select(group, "radius", "caliper", "gap", *gaps)
