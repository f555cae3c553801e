"""Choosing, pooling and comparing rows within groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import kept_table
from .rank_metrics import running_sums


def ensemble_mean(runs: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean score of each item over its runs, and how many these are."""
    return runs.groupBy(*keys).agg(F.avg(score).alias(score), F.count("*").alias("runs"))


def run_summary(runs: DataFrame, run: str, group: str, value: str) -> DataFrame:
    """Mean and deviation over runs of each run's mean over group means; not the mean of the ensemble."""
    per = runs.groupBy(run, group).agg(F.avg(value).alias("_v")).groupBy(run).agg(F.avg("_v").alias("_v"))
    return per.agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"), F.count("*").alias("runs"))


def pooled_values(owners: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """max, min, sum and mean of the rows of each owner; 0 for an owner without rows."""
    pools = rows.groupBy(*keys).agg(F.max(value).alias("max_v"), F.min(value).alias("min_v"), F.sum(value).alias("sum_v"), F.avg(value).alias("mean_v"))
    return owners.select(*keys).join(pools, keys, "left").fillna(0.0, ["max_v", "min_v", "sum_v", "mean_v"])


def contact_counts(df: DataFrame, group: list[str], d: str, score: str, cutoffs: tuple[float, ...], threshold: float, tau: float) -> DataFrame:
    """Rows within each cut-off, the part of scores at or above a threshold, and the mean of score * exp(-d / tau)."""
    counts = [F.count_if(F.col(d) <= c).alias(f"le{c:g}") for c in cutoffs]
    return df.groupBy(*group).agg(*counts, F.avg((F.col(score) >= threshold).cast("int")).alias("frac"), (F.sum(F.col(score) * F.exp(-F.col(d) / tau)) / F.count("*")).alias("soft"))


def class_tally(df: DataFrame, group: list[str], label: str, mask: str, most: float = 50.0) -> DataFrame:
    """Rows, positives, unmasked rows and class weight min(most, negatives / positives) of each group; NULL without positives."""
    pos = F.sum(label)
    weight = F.least(F.lit(most), F.try_divide((F.count("*") - pos).cast("double"), pos.cast("double")))
    return df.groupBy(*group).agg(F.count("*").alias("n"), pos.alias("positives"), F.sum(mask).alias("masked"), weight.alias("pos_weight"))


def union_and_difference(df: DataFrame, channels: list[Column], label: Column, a: str, b: str) -> DataFrame:
    """Rows whose label is not the greatest of its channels, and the greatest and mean difference of two score sets."""
    gap = F.abs(F.col(a) - F.col(b))
    return df.agg(F.count("*").alias("n"), F.count_if(F.greatest(*channels) != label).alias("mismatches"), F.max(gap).alias("max_abs_diff"), F.avg(gap).alias("mean_abs_diff"))


def selection_conflicts(df: DataFrame, group: list[str], label: str, first: str, second: str, tie: list[str]) -> DataFrame:
    """Rows and positives that two top-P selections share, that the second removes and adds, and that neither takes."""
    w = Window.partitionBy(*group)
    r = df.select(F.col(label).alias("_y"), *(F.row_number().over(w.orderBy(F.desc(s), *tie)).alias(n) for s, n in ((first, "_a"), (second, "_b"))), F.sum(label).over(w).alias("_p"))
    a, b = F.col("_a") <= F.col("_p"), F.col("_b") <= F.col("_p")
    state = F.when(a & b, "both").when(a, "removed").when(b, "added").otherwise("neither")
    return r.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.sum("_y").alias("positives"))


def best_candidate(df: DataFrame, group: list[str], keys: dict[str, Column], chosen: str, sound: Column) -> DataFrame:
    """The row of each group that is greatest by keys, then least by chosen, as one aggregate; chosen is NULL where that row is not sound.
    sound may name the keys."""
    best = df.select(*group, F.struct(*(c.alias(n) for n, c in keys.items()), (-F.col(chosen)).alias("_chosen")).alias("_s")).groupBy(*group).agg(F.max("_s").alias("_s"))
    return best.select(*group, "_s.*").select(*group, F.when(sound, -F.col("_chosen")).alias(chosen))


def best_row(df: DataFrame, group: list[str], value: str, key: str) -> DataFrame:
    """The key of the greatest value of each group, ties by the lower key, as one aggregate."""
    best = F.max(F.struct(F.col(value), (-F.col(key)).alias("k")))
    return df.groupBy(*group).agg((-best["k"]).alias("chosen"))


def nearest_negatives(df: DataFrame, group: str, label: str, d: str, tie: list[Column | str], per: int, most: int) -> DataFrame:
    """Negatives of each group in order of distance: one for each `per` positives, at least one, at most `most`."""
    w = Window.partitionBy(group)
    t = df.withColumn("_p", F.sum(label).over(w)).where(F.col(label) == 0).withColumn("_m", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(d, *tie)))
    return t.where(F.col("_r") <= F.least("_m", F.greatest(F.floor(F.col("_p") / per), F.lit(1)), F.lit(most))).drop("_p", "_m", "_r")


def stable_subset(df: DataFrame, split: str, key: str, salt: str, quota: int, total: int | None = None) -> DataFrame:
    """The `quota` rows of least hash of each split, and, where these are fewer than `total`, the rows of least hash of what is left."""
    h = df.withColumn("_h", F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")).cast("binary"), 256))
    h = h.withColumn("_r", F.row_number().over(Window.partitionBy(split).orderBy("_h")))
    first = h.where(F.col("_r") <= quota)
    if total is None:
        return first.drop("_h", "_r")
    left = max(0, total - first.count())
    return first.unionByName(h.where(F.col("_r") > quota).orderBy("_h").limit(left)).drop("_h", "_r")


def extremes(df: DataFrame, key: str, picks: dict[str, Column]) -> DataFrame:
    """The key that comes first by each named order, ties by key."""
    return reduce(DataFrame.union, (df.orderBy(order, key).limit(1).select(F.lit(n).alias("which"), F.col(key).alias("id")) for n, order in picks.items()))


def concatenated(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; columns that a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def set_sizes(**sets: DataFrame) -> DataFrame:
    """One row with the number of distinct rows of each set."""
    counts = [df.distinct().agg(F.count("*").alias(n)).withColumn("_", F.lit(1)) for n, df in sets.items()]
    return reduce(lambda a, b: a.join(b, "_"), counts).drop("_")


def covered(df: DataFrame, ids: DataFrame, key: str, there: bool = True) -> DataFrame:
    """Rows of df whose key is among ids, or is not."""
    return df.join(ids.select(key), key, "left_semi" if there else "left_anti")


def common_keys(*frames: DataFrame) -> DataFrame:
    """Distinct rows that all frames have."""
    return reduce(DataFrame.intersect, frames)


def wide(df: DataFrame, key: str, method: str, names: list[str], value: str, prefix: str = "score_") -> DataFrame:
    """One row a key with the mean value of each method."""
    got = df.groupBy(key).pivot(method, names).agg(F.avg(value))
    return got.select(key, *(F.col(n).alias(f"{prefix}{n.lower()}") for n in names))


def distinct_places(df: DataFrame, group: list[str], place: list[str]) -> DataFrame:
    """Distinct positions of each group, and whether a builder that wants each once rejects it."""
    places = df.groupBy(*group, *place).agg(F.count("*").alias("_c"))
    return places.groupBy(*group).agg(F.count("*").alias("kept"), (F.max("_c") > 1).alias("rejected"))


def matched_contrast(df: DataFrame, group: str, label: str, d: str, score: str, width: float, cost: float) -> DataFrame:
    """Of each group's (positive, negative) pairs not further than width apart in d whose positive scores higher: how many, and the best of
    score difference less cost * difference in d.  Bands of d meet in an equi join; equal rows are one with their number."""
    i = df.groupBy(group, label, d, score).agg(F.count("*").alias("_n"))
    band = lambda s=0: F.floor(F.col(d) / width) + s
    pos = i.where(F.col(label) == 1).select(group, F.col(d).alias("_pd"), F.col(score).alias("_ps"), F.col("_n").alias("_pn"), band().alias("_band"))
    neg = i.where(F.col(label) == 0).select(group, F.col(d).alias("_nd"), F.col(score).alias("_ns"), F.col("_n").alias("_nn"), F.explode(F.array(*map(band, (-1, 0, 1)))).alias("_band"))
    gap = F.abs(F.col("_pd") - F.col("_nd"))
    p = pos.join(neg, [group, "_band"]).where((gap <= width) & (F.col("_ps") > F.col("_ns")))
    return p.groupBy(group).agg(F.sum(F.col("_pn") * F.col("_nn")).alias("pairs"), F.max(F.col("_ps") - F.col("_ns") - cost * gap).alias("best"))


def pair_accuracy(df: DataFrame, group: str, label: str, d: str, score: str) -> DataFrame:
    """Part of the (positive, negative) pairs at the same d that the score orders right, ties half; counted from distinct scores."""
    pos, neg = (df.where(F.col(label) == v).groupBy(group, d, score).agg(F.count("*").alias(n)) for v, n in ((1, "_n"), (0, "_m")))
    pairs = pos.withColumnRenamed(score, "_p").join(neg.withColumnRenamed(score, "_q"), [group, d])
    won = F.when(F.col("_p") > F.col("_q"), 1.0).when(F.col("_p") == F.col("_q"), 0.5).otherwise(0.0)
    n = F.col("_n") * F.col("_m")
    return pairs.groupBy(group).agg(F.sum(n).alias("pairs"), (F.sum(won * n) / F.sum(n)).alias("accuracy"))


def offsets(df: DataFrame, group: str) -> DataFrame:
    """First and last row of each group in sorted order, and the group's code, summed over ranges of groups."""
    c = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1))
    c = running_sums(c, [], group, {"end": "_n", "_place": "_one"}, descending=False)
    return c.select(group, (F.col("end") - F.col("_n")).alias("begin"), "end", (F.col("_place") - 1).cast("bigint").alias("code"))


def ecdf(group: list[str], order: list[str]) -> Column:
    """Place of a row in its group over the group's rows."""
    w = Window.partitionBy(*group)
    return F.row_number().over(w.orderBy(*order)) / F.count("*").over(w)


def exploded_scores(owners: DataFrame, rows: DataFrame, group: str, text: str, score: str, by: str = "+") -> DataFrame:
    """Greatest score of each owner (group, number), from rows that list numbers in one text; 0 without one."""
    p = rows.select(group, F.explode(F.split(text, rf"\Q{by}\E")).alias("number"), score)
    return owners.join(p.groupBy(group, "number").agg(F.max(score).alias(score)), [group, "number"], "left").fillna(0.0, [score])


def common_subset(df: DataFrame, key: str, method: str, value: str, methods: int) -> DataFrame:
    """Methods compared over the keys that all of them cover."""
    both = df.withColumn("_k", F.count("*").over(Window.partitionBy(key))).where(F.col("_k") == methods)
    return both.groupBy(method).agg(F.count("*").alias("common"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def coverage(requested: DataFrame, found: DataFrame, key: str, reasons: Column) -> DataFrame:
    """Requested keys by reason; reasons may name k, the number of rows found."""
    n = requested.select(key).join(found.groupBy(key).agg(F.count("*").alias("k")), key, "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return n.groupBy(reasons.alias("reason")).agg(F.count("*").alias("n"))


def numbered_nodes(points: DataFrame, group: str, key: str, kind: Column, centred: Column) -> DataFrame:
    """Nodes of each group: the centre (key -1, kind 0) of its centred points, if it has any, then all points by kind and key,
    numbered from 0."""
    centre = points.where(centred).select(group).distinct().select(group, F.lit(-1).cast("bigint").alias(key), F.lit(0).alias("kind"))
    nodes = centre.union(points.select(group, key, kind.alias("kind")))
    return nodes.withColumn("node", (F.row_number().over(Window.partitionBy(group).orderBy("kind", key)) - 1).cast("bigint"))


def shares(df: DataFrame, category: str) -> DataFrame:
    """Rows of each category, and their part of all in percent; the window runs over one row a category."""
    n = df.groupBy(category).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def pattern_lines(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Matches of a pattern in texts, each with the line of its first place."""
    m = df.select(key, text, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("hit"))
    before = F.substring(F.col(text), F.lit(1), F.instr(F.col(text), F.col("hit")) - 1)
    return m.select(key, "hit", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("line"))


#: Queries of a block of a search.
BLOCK_QUERIES = 1000


def _searched(queries: DataFrame, train: DataFrame, rows: int, best) -> DataFrame:
    """id, t and train of each query's best row in each block: every block of queries (id, w) meets every block of about `rows` rows (train, tw)
    in a task's function best(queries, rows), matrices of a fingerprint a row, which gives greatest similarities and their first places.

    All pairs are looked at, so time grows with queries times rows; a task holds one block of either.
    """
    import numpy as np
    import pyarrow as pa

    queries, train = kept_table(queries.select("id", "w")), kept_table(train.select("train", "tw"))
    asked, there = queries.count(), train.count()
    parts, blocks = max(1, -(-asked // BLOCK_QUERIES)), max(1, -(-there // rows))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_p", dealt("id", parts)).withColumn("_b", each(blocks))
    t = train.withColumn("_b", dealt("train", blocks)).withColumn("_p", each(parts))

    def words(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        values = column.flatten() if pa.types.is_list(column.type) else column
        return values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(len(column), -1)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table({"id": pa.array([], pa.int64()), "t": pa.array([], pa.float64()), "train": pa.array([], pa.int64())})
        b = b.sort_by("train")  # of equal ones the first is the least
        score, at = best(words(a["w"]), words(b["tw"]))
        return pa.table({"id": a["id"].cast(pa.int64()), "t": pa.array(score), "train": b["train"].cast(pa.int64()).take(pa.array(at))})

    tasks = min(parts * blocks, 2000)
    both = q.repartition(tasks, "_p", "_b").groupBy("_p", "_b").cogroup(t.repartition(tasks, "_p", "_b").groupBy("_p", "_b"))
    return both.applyInArrow(run, "id bigint, t double, train bigint")


def _best_of(found: DataFrame) -> DataFrame:
    best = found.groupBy("id").agg(F.max(F.struct("t", (-F.col("train")).alias("n"))).alias("m"))
    return best.select("id", F.col("m.t").alias("t"), (-F.col("m.n")).alias("nearest"))


def _best_longs(asked, there):
    """Greatest Tanimoto similarity of each 64-bit fingerprint to others, and the first place of it.  Those of as many bits share the most where they are
    most similar, so a similarity is made for each number of bits only."""
    import numpy as np

    asked, there = asked[:, 0], there[:, 0]
    bits = np.bitwise_count(there).astype(np.int64)
    order = np.argsort(bits, kind="stable")
    kinds, first = np.unique(bits[order], return_index=True)
    ends = np.append(first[1:], len(order))
    there = there[order]
    score, at = np.empty(len(asked)), np.empty(len(asked), np.int64)
    for k, w in enumerate(asked):
        shared = np.bitwise_count(there & w)
        most = np.maximum.reduceat(shared, first).astype(np.int64)
        either = int(w).bit_count() + kinds - most
        t = np.where(either > 0, most / np.maximum(either, 1), 1.0)
        score[k] = t.max()
        at[k] = min(order[first[i] + np.argmax(shared[first[i] : ends[i]] == most[i])] for i in np.flatnonzero(t == score[k]))
    return score, at


def _best_sets(asked, there):
    """The same for longer fingerprints: their bits are inverted into lists of places, and a query counts the lists of its bits."""
    import numpy as np

    def positions(words):
        return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")

    bit, place = np.nonzero(np.ascontiguousarray(positions(there).T))
    width, n = there.shape[1] * 64, len(there)
    ends = np.searchsorted(bit, np.arange(width + 1))
    size = np.bincount(place, minlength=n)
    score, at = np.empty(len(asked)), np.empty(len(asked), np.int64)
    for k, own in enumerate(positions(asked)):
        own = np.flatnonzero(own)
        lists = [place[ends[b] : ends[b + 1]] for b in own]
        shared = np.bincount(np.concatenate(lists), minlength=n) if lists else np.zeros(n, np.int64)
        either = size + len(own) - shared
        t = np.where(either > 0, shared / np.maximum(either, 1), 1.0)
        at[k] = np.argmax(t)
        score[k] = t[at[k]]
    return score, at


def nearest_tanimoto(queries: DataFrame, train: DataFrame, rows: int = 100_000) -> DataFrame:
    """Of each query (id, w) its greatest Tanimoto similarity t to training fingerprints (train, tw), and the least id of those that have it.

    Equal fingerprints are one row; blocks of queries meet blocks of about `rows` rows (see _searched).  Null fingerprints are left out.
    """
    t = train.where("tw is not null").groupBy("tw").agg(F.min("train").alias("train"))
    return _best_of(_searched(queries.where("w is not null"), t, rows, _best_longs))


def nearest_fingerprint(queries: DataFrame, train: DataFrame, size: int = 2048, rows: int = 20_000) -> DataFrame:
    """Of each query (id, w) the greatest Tanimoto similarity t to training fingerprints (train, tw), and the least id of those that
    have it.  Fingerprints are arrays of size / 64 longs.

    Equal fingerprints are one row; blocks of queries meet inverted indexes of blocks of about `rows` rows (see _searched, _best_sets).  A
    query that shares no bit with any has t 0 and the least id of all (t 1 and the least id of the empty ones, if it has no bits and there are such).
    Null fingerprints are left out.
    """
    t = train.where("tw is not null").groupBy("tw").agg(F.min("train").alias("train"))
    sized = F.when(F.size("w") == size // 64, F.col("w")).otherwise(F.raise_error(F.lit("a fingerprint has another size")))
    return _best_of(_searched(queries.where("w is not null").select("id", sized.alias("w")), t, rows, _best_sets))
