"""Writers."""

from __future__ import annotations

import io
import json
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir; a local one only where that is unset)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame) -> DataFrame:
    """df, computed once, its lineage cut by a Parquet table in the shared folder."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed_archives(df: DataFrame, by: list[str], order: list[str], arrays: dict[str, tuple[str, str]]) -> DataFrame:
    """content: an NPZ archive, as bytes, of the rows of each value of `by`, whose rows must fit a task; arrays: name, column and
    NumPy type of each array."""
    import pandas as pd

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows, raw = rows.sort_values(order, kind="stable"), io.BytesIO()
        np.savez(raw, **{name: rows[column].to_numpy(kind) for name, (column, kind) in arrays.items()})
        return pd.DataFrame({"content": [raw.getvalue()]})

    return df.groupBy(*by).applyInPandas(pack, "content binary")


def write_csv(df: DataFrame, path: str, one_file: bool = False, compression: str = "gzip") -> None:
    """CSV with a header; one file only for results that are small."""
    (df.coalesce(1) if one_file else df).write.csv(path, header=True, compression=compression)


def write_archive(df: DataFrame, path: str, by: list[str]) -> None:
    """Columnar archive with a folder for each value of `by`; rows of a folder may come from many tasks."""
    df.write.partitionBy(*by).parquet(path)


def write_shards(df: DataFrame, path: str, split: str, shard_size: int = 256) -> None:
    """Shards of at most shard_size rows for each split; a path that is there already is refused."""
    df.write.mode("errorifexists").partitionBy(split).option("maxRecordsPerFile", shard_size).parquet(path)


def to_json(rows: DataFrame, limit: int = 10_000) -> str:
    """A document of a small result, keys sorted; a larger one is an error."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"over {limit} rows: write them with Spark")
    return json.dumps([r.asDict(recursive=True) for r in got], sort_keys=True, default=str)


def to_markdown(rows: DataFrame, digits: int = 4, limit: int = 1000) -> str:
    """A Markdown table of a small result: numbers to `digits` places, NA for NULL."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"over {limit} rows: too many for a table in text")
    cell = lambda v: "NA" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join(map(cell, r)) + " |" for r in got)])


def markdown_lines(rows: DataFrame, digits: int = 4) -> DataFrame:
    """A line of a Markdown table for each row, whatever their number: floating-point numbers to `digits` places, NA for NULL."""
    cell = lambda c, kind: F.format_string(f"%.{digits}f", c) if kind in ("double", "float") else F.col(c).cast("string")
    cells = [F.coalesce(F.when(F.col(c).isNotNull(), cell(c, kind)), F.lit("NA")) for c, kind in rows.dtypes]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Resumable table: append the rows whose key it lacks; returns how many."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
        df = df.join(done, key, "left_anti")
    except Exception as e:  # noqa: BLE001  the table is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    return n


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows of a table, whatever their order: their number and two sums of hashes of all columns."""
    columns = [F.to_json(c) if isinstance(df.schema[c].dataType, MapType) else F.col(c) for c in df.columns]
    n, *sums = df.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)")) for salt in ("a", "b"))).first()
    return f"{n}:{sums[0] or 0}:{sums[1] or 0}:{','.join(f'{c}={t}' for c, t in df.dtypes)}"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), spark._jvm.org.apache.hadoop.fs.Path


def _manifest(spark: SparkSession, path: str) -> dict | None:
    """The completion marker of a cache; None where there is none."""
    fs, at = _files(spark, path)
    if not fs.exists(at(f"{path}/_manifest")):
        return None
    return json.loads(spark.read.text(f"{path}/_manifest", wholetext=True).first()[0])


def write_cache(source: DataFrame, path: str, key: str, make) -> int:
    """A cache of make(source), complete or not there: returns the rows written, 0 where a complete one of the same source stands.

    Rows go to a staged folder beside path, which gets a manifest (fingerprint of the source, rows, least and greatest key) when all are written, and
    then path's name in one rename.  What a broken run leaves behind has another name and is never read; a cache of another source is
    set aside first and deleted after the rename.
    """
    spark = source.sparkSession
    of = fingerprint(source)
    old = _manifest(spark, path)
    if old is not None and old["source"] == of:
        return 0
    fs, at = _files(spark, path)
    mark = uuid.uuid4().hex
    staged, aside = f"{path.rstrip('/')}.staged-{mark}", f"{path.rstrip('/')}.aside-{mark}"
    make(source).write.parquet(staged)
    rows, low, high = spark.read.parquet(staged).agg(F.count("*"), F.min(key).cast("string"), F.max(key).cast("string")).first()
    told = json.dumps({"source": of, "rows": rows, "low": low, "high": high}, sort_keys=True)
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{staged}/_manifest")
    moved = fs.exists(at(path)) and fs.rename(at(path), at(aside))
    if not fs.rename(at(staged), at(path)):
        raise OSError(f"{staged} cannot be renamed to {path}")
    if moved:
        fs.delete(at(aside), True)
    return rows


def read_cache(source: DataFrame, path: str) -> DataFrame:
    """The rows of a complete cache of source; a ValueError where it is unfinished, of another source, or has lost rows."""
    spark = source.sparkSession
    manifest = _manifest(spark, path)
    if manifest is None:
        raise ValueError(f"{path} is not a finished cache")
    if manifest["source"] != fingerprint(source):
        raise ValueError(f"{path} was made from another input")
    rows = spark.read.parquet(path)
    if rows.count() != manifest["rows"]:
        raise ValueError(f"{path} does not hold the rows that its manifest names")
    return rows


def write_text(df: DataFrame, path: str, line: str) -> None:
    """One text column as lines (FASTA, SMILES and the like, built with concat_ws)."""
    df.select(line).write.text(path)
