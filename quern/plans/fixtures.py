"""The tables that stand in for residues, complexes, scores and records, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ITEM = ("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Items that a task orders, unless a complex has more.
TASK_ITEMS = 1 << 18


def ranked_items(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """g (complex), idx (item in stable order), y (label), sa (score with ties), sb (score), d (distance).

    dealt: complexes are dealt to as many tasks as the items need, so that those which order them several times hold TASK_ITEMS or so, whatever the input.
    """
    order = Window.partitionBy("l_suppkey").orderBy(*_ITEM)
    items = table(spark, sf_dir, "lineitem")
    if dealt:
        items = items.select(*_ITEM, "l_suppkey", "l_returnflag", "l_discount", "l_quantity").repartition(max(1, -(-items.count() // TASK_ITEMS)), "l_suppkey")
    return items.select(
        F.col("l_suppkey").alias("g"),
        F.row_number().over(order).cast("bigint").alias("idx"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_discount").alias("sa"),
        F.col("l_extendedprice").alias("sb"),
        F.col("l_quantity").alias("d"),
    )


ITEMS = """items AS (SELECT l_suppkey AS g,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber, l_extendedprice, l_shipdate) AS idx,
  CAST(l_returnflag = 'R' AS INT) AS y, l_discount AS sa, l_extendedprice AS sb, l_quantity AS d FROM lineitem)"""


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ranked_items in long form: one row an item and method (price, discount)."""
    items = ranked_items(spark, sf_dir)
    return items.select("g", "idx", "y", "d", F.explode(F.map_from_arrays(F.array(F.lit("discount"), F.lit("price")), F.array("sa", "sb"))).alias("method", "score"))


SCORED = (
    ITEMS
    + """, scored AS (SELECT g, idx, y, d, 'discount' AS method, sa AS score FROM items
  UNION ALL SELECT g, idx, y, d, 'price', sb FROM items)"""
)


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, doc_id, y (quality), toxic and p of labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels")
    p = F.least(F.col("n_chars") / F.lit(6000.0), F.lit(1.0))
    return docs.join(labels, "doc_id").select("lang", "doc_id", F.col("quality").alias("y"), "toxic", p.alias("p"))


PROBABILITIES = "probs AS (SELECT lang, doc_id, quality AS y, toxic, least(n_chars / 6000.0::DOUBLE, 1.0::DOUBLE) AS p FROM documents JOIN labels USING (doc_id))"


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A difference of two methods for each complex, with its cluster: id, cluster, delta."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("cluster"), F.round(F.col("s_acctbal") / 10000 - 0.4, 6).alias("delta"))


DELTAS = "deltas AS (SELECT s_suppkey AS id, s_nationkey AS cluster, round(s_acctbal / 10000 - 0.4, 6) AS delta FROM supplier)"


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of complexes: g, id, ligand (0/1), x, y, z."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("g"), F.col("vec_id").alias("id"), (F.col("vec_id") % 5 == 0).cast("int").alias("ligand"), *(F.round(e[i].cast("double") * 100, 3).alias(c) for i, c in enumerate("xyz"))
    )


ATOMS = """atoms AS (SELECT label AS g, vec_id AS id, CAST(vec_id % 5 = 0 AS INT) AS ligand,
  round(embedding[1]::DOUBLE * 100, 3) AS x, round(embedding[2]::DOUBLE * 100, 3) AS y, round(embedding[3]::DOUBLE * 100, 3) AS z FROM embeddings)"""
