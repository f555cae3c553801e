"""Filters, joins, aggregations and audits over cohorts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a lookup side is broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most `rows` rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def clean_text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def clean_number(c: Column) -> Column:
    """A residue number as text, without a trailing .0."""
    return F.regexp_replace(clean_text(c), r"\.0$", "")


def whole_number(c: Column) -> Column:
    """Text of a whole number for texts like 12.0, others trimmed as they are."""
    x = clean_text(c).try_cast("double")
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(clean_text(c))


def matching_names(rules: dict[str, Column]) -> Column:
    """Names of all rules that hold: bands may overlap, so rows are exploded over them."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda n: n.isNotNull())


def bin_left(c: Column, edges: list[float], names: list[str]) -> Column:
    """Bins closed on the left: names[i] for edges[i-1] <= c < edges[i]."""
    out = None
    for e, n in zip(edges, names):
        out = F.when(c < e, n) if out is None else out.when(c < e, n)
    return out.when(c.isNotNull(), names[-1])


def bin_right(c: Column, edges: list[float], names: list[str]) -> Column:
    out = None
    for e, n in zip(edges, names):
        out = F.when(c <= e, n) if out is None else out.when(c <= e, n)
    return out.when(c.isNotNull(), names[-1])


def similarity_bin(c: Column) -> Column:
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, "unresolved").when(c < 0.3, "<0.3").when(c < 0.5, "0.3-0.5").when(c < 0.7, "0.5-0.7").otherwise(">=0.7")


def encode(c: Column, names: list[str], unknown: int = 0, first: int = 1) -> Column:
    """Code of a name by its place in a list."""
    at = F.array_position(F.array(*map(F.lit, names)), c)
    return F.when(F.coalesce(at, F.lit(0)) == 0, unknown).otherwise(at - 1 + first).cast("int")


# Elements of two letters that atom names begin with.
TWO_LETTERS = ("CL", "BR", "MG", "MN", "FE", "ZN", "CA", "NA")


def element_of(name: Column, pairs: tuple[str, ...] = TWO_LETTERS) -> Column:
    """Element of an atom name: a known two-letter one, else the first letter, else UNK."""
    letters = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z]", "")
    return F.when(F.substring(letters, 1, 2).isin(*pairs), F.substring(letters, 1, 2)).when(F.length(letters) > 0, F.substring(letters, 1, 1)).otherwise("UNK")


def columns_with_prefix(df: DataFrame, keys: list[str], prefixes: Iterable[str]) -> DataFrame:
    return df.select(*keys, *(c for c in df.columns if c not in keys and c.startswith(tuple(prefixes))))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with finite values in all of these columns; a missing column is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for c, t in df.select(*columns).dtypes:
        df = df.where(F.col(c).isNotNull())
        if t in ("double", "float"):
            df = df.where(~F.isnan(c) & (F.abs(c) < float("inf")))
    return df


def canonical_id(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=:)h\d{2}(?:_platinum)?__", "")


def keyword_match(columns: list[str], words: list[str]) -> Column:
    return F.rlike(F.upper(F.concat_ws(" ", *columns)), F.lit("|".join(words)))


def first_by_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row of each key, the first in an order: dropDuplicates with a defined choice."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def many_to_one(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Join whose right key must be unique."""
    if right.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError(f"right side repeats a key of {key}")
    return left.join(right, key, how)


def fallback_join(left: DataFrame, exact: DataFrame, loose: DataFrame, key: list[str], loose_key: list[str], value: str) -> DataFrame:
    """Value by the whole key, else by the shorter one: two equi joins, never a disjunction."""
    got = left.join(exact.withColumnRenamed(value, "_exact"), key, "left").join(loose.withColumnRenamed(value, "_loose"), loose_key, "left")
    return got.withColumn(value, F.coalesce("_exact", "_loose")).drop("_exact", "_loose")


def mismatches(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One row: keys on one side only, and keys whose values differ."""
    joined = a.select(*key, F.struct(*values).alias("_a")).join(b.select(*key, F.struct(*values).alias("_b")), key, "full")
    return joined.agg(
        F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b"))).alias("differing")
    )


def describe(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation (0 for one row), least and greatest of finite values."""
    v = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    n = F.count(v)
    return df.groupBy(*group).agg(n.alias("n"), F.avg(v).alias("mean"), F.when(n == 1, 0.0).otherwise(F.stddev_samp(v)).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))


def joined_set(c: Column, separator: str = ";") -> Column:
    return F.array_join(F.array_sort(F.collect_set(c.cast("string"))), separator)


def top_mean(c: Column, k: int = 3) -> Column:
    """Mean of the k greatest values, of all if there are fewer.  The values of a group are gathered: for bounded groups."""
    top = F.slice(F.sort_array(F.collect_list(c), False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(top), F.lit(0))


def stratified(df: DataFrame, dimensions: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates of each group of each dimension, one dimension at a time, in one pass."""
    sets = df.groupingSets([[d] for d in dimensions], *dimensions).agg(F.grouping_id().alias("_id"), *aggregates)
    full = (1 << len(dimensions)) - 1
    name = group = None
    for i, d in enumerate(dimensions):
        hit = F.col("_id") == full - (1 << (len(dimensions) - 1 - i))
        name = F.when(hit, d) if name is None else name.when(hit, d)
        group = F.when(hit, F.col(d).cast("string")) if group is None else group.when(hit, F.col(d).cast("string"))
    return sets.withColumn("dimension", name).withColumn("group", group).drop("_id", *dimensions)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows of each of equal bins on [low, high], the last one closed."""
    b = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.where(F.col(value).between(low, high)).groupBy(b).agg(F.count("*").alias("n"))


def label_overlap(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Jaccard index of two label sets (1 for none), and rows where they disagree."""
    both, either = F.sum(F.col(a) * F.col(b)), F.sum(F.greatest(a, b))
    return df.groupBy(*group).agg(F.count("*").alias("rows"), F.sum(a).alias("a_positives"), F.sum(b).alias("b_positives"), F.coalesce(F.try_divide(both.cast("double"), either.cast("double")), F.lit(1.0)).alias("jaccard"), F.sum(F.abs(F.col(a) - F.col(b))).alias("disagreements"))


def take_until(df: DataFrame, group: str, salt: str, limit: int, pieces: int = 256) -> DataFrame:
    """Whole groups in order of a salted hash until their rows come to `limit`.

    Hash ranges are summed first, so that running totals need only the ranges' totals in one place.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("size")).withColumn("hash", F.sha2(F.concat(F.lit(salt), F.col(group).cast("string")), 256))
    sizes = sizes.withColumn("_piece", F.conv(F.substring("hash", 1, 4), 16, 10).cast("int") % 65536 * pieces / 65536).withColumn("_piece", F.floor("_piece"))
    totals = sizes.groupBy("_piece").agg(F.sum("size").alias("_sum"))
    totals = totals.select("_piece", (F.sum("_sum").over(Window.partitionBy().orderBy("_piece")) - F.col("_sum")).alias("_before"))
    w = Window.partitionBy("_piece").orderBy("hash")
    run = sizes.join(F.broadcast(totals), "_piece").withColumn("before", F.col("_before") + F.sum("size").over(w) - F.col("size"))
    return run.where(F.col("before") < limit).select(group, "size", "before")
