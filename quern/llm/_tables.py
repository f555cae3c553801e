"""Tables that outlive a job: written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, computed once, its lineage cut by a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of written(df), once nothing reads them any more."""
    path = getattr(df, "_written_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bitmap(df: DataFrame, key: str, bits: int):
    """A bit for each key modulo bits, as bytes: bits / 8 of them whatever df holds (bits: a power of 2 from 64)."""
    import numpy as np

    slot = F.col(key).bitwiseAND(F.lit(bits - 1))
    rows = (
        df.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .collect()
    )
    out = np.zeros(bits // 64, np.int64)
    for word, bit in rows:
        out[word] = bit
    return out.view(np.uint64)


def in_bitmap(words, keys):
    """Of uint64 keys, whether their bit is set."""
    import numpy as np

    slot = keys & np.uint64(len(words) * 64 - 1)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b): component is the smallest node within reach.

    Each round hangs every node's smaller neighbours, then its larger ones, on its least
    neighbour, until nothing moves and every component is a star.  Edges shrink on the way and rounds grow with the
    logarithm of the longest path.  Least neighbours are aggregated before they are joined, so a
    node with very many neighbours gathers in no task.  Each round is written to the shared folder; only a
    count and a checksum come back to the driver.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        least = now.groupBy("a").agg(F.min("b").alias("least"))
        small = now.join(least, "a").select("a", "b", "least")
        small = small.select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        small = written(small)
        both = small.union(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct())
        drop(now)
        drop(small)
        now, before = large, state
        state = large.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
