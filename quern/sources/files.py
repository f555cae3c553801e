"""Readers of the file formats that ranking evaluations come in."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Standard residues and their letters (fixed values).
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """CSV or CSV.gz with a header and a stated schema; only the wanted columns are parsed."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.select(*columns) if columns else df


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_shards(spark: SparkSession, paths: list[str], schema: str, key: str) -> DataFrame:
    """Shards of an index as one table, one row a key: the least by all columns."""
    df = spark.read.schema(schema).csv(paths, header=True)
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def read_archive(spark: SparkSession, path: str, required: tuple[str, ...] = ("labels", "sample_index")) -> DataFrame:
    """parse_archives() of the NPZ files of a path."""
    return parse_archives(spark.read.format("binaryFile").load(path), required)


def parse_archives(archives: DataFrame, required: tuple[str, ...] = ("labels", "sample_index")) -> DataFrame:
    """NPZ archives of predictions, as bytes in content, with arrays named <split>__<field>: split, item, field, value.

    An archive is one task's work; one without a required field of a split is an error.
    """

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    fields = sorted(z.files)
                    splits = {f.split("__", 1)[0] for f in fields}
                    for s in splits:
                        missing = [r for r in required if f"{s}__{r}" not in fields]
                        if missing:
                            raise ValueError(f"archive lacks {missing} of {s}")
                    for f in fields:
                        values = z[f]
                        if values.dtype.kind in "iufb":
                            split, field = f.split("__", 1)
                            yield pd.DataFrame({"split": split, "item": np.arange(len(values)), "field": field, "value": values.astype(float)})

    return archives.select("content").mapInPandas(run, "split string, item bigint, field string, value double")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no and line of text files; each file is read whole, so lines keep their order."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


#: Five digits of base 36 from A0000 on, in capitals and then in small letters, go on where 99999 ends (hybrid-36, of the PDB format).
_FIRST, _SPAN = 10 * 36**4, 26 * 36**4


def pdb_serial(number: Column) -> Column:
    """The five columns of an atom's number, right-justified; in hybrid-36 from 100,000 on.  A number that these cannot hold stops the job."""
    over = number - 100_000
    digits = F.lpad(F.conv((over % _SPAN + _FIRST).cast("string"), 10, 36), 5, "0")
    wide = F.when(over < _SPAN, digits).when(over < 2 * _SPAN, F.lower(digits)).otherwise(F.raise_error(F.lit("an atom's number does not fit its five columns")))
    return F.when(number.between(-9999, 99_999), F.lpad(number.cast("string"), 5, " ")).when(over >= 0, wide).otherwise(F.raise_error(F.lit("an atom's number does not fit its five columns")))


def parsed_serial(text: Column) -> Column:
    """The number that pdb_serial wrote; null where it is none."""
    value = F.conv(text, 36, 10).cast("bigint") - _FIRST + 100_000
    return F.when(text.rlike("^[A-Z][0-9A-Z]{4}$"), value).when(text.rlike("^[a-z][0-9a-z]{4}$"), value + _SPAN).otherwise(text.try_cast("int")).cast("int")


def parse_pdb(lines: DataFrame) -> DataFrame:
    """Atoms of fixed-width lines: record, serial, name, resname, chain, resnr (text: it keeps the insertion code), x, y, z, element.

    Serials beyond 99,999 are read as hybrid-36.  Lines that are no atoms or whose numbers do not parse are skipped.
    """
    cut = lambda a, b: F.trim(F.substring("line", a, b - a + 1))
    atoms = lines.where(F.substring("line", 1, 6).isin("ATOM  ", "HETATM")).select(
        *(c for c in lines.columns if c != "line"),
        cut(1, 6).alias("record"),
        parsed_serial(cut(7, 11)).alias("serial"),
        cut(13, 16).alias("name"),
        cut(18, 20).alias("resname"),
        cut(22, 22).alias("chain"),
        cut(23, 27).alias("resnr"),
        *(cut(31 + 8 * i, 38 + 8 * i).try_cast("double").alias(c) for i, c in enumerate("xyz")),
        cut(77, 78).alias("element"),
    )
    return atoms.dropna(subset=["serial", "x", "y", "z"])


def ordered_residues(atoms: DataFrame, group: list[str], order: str) -> DataFrame:
    """Distinct standard residues in order of first occurrence, with their place and letter."""
    letters = F.create_map(*(F.lit(v) for kv in RESIDUES.items() for v in kv))
    first = atoms.where(F.col("resname").isin(*RESIDUES)).groupBy(*group, "chain", "resnr", "resname").agg(F.min(order).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_first")) - 1
    return first.withColumn("place", place.cast("bigint")).withColumn("letter", F.element_at(letters, F.col("resname"))).drop("_first")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def mol2_atoms(texts: DataFrame, text: str = "value") -> DataFrame:
    """Atoms of the @<TRIPOS>ATOM section of whole MOL2 texts: id, name, x, y, z, kind."""
    body = F.regexp_extract(text, r"(?s)@<TRIPOS>ATOM\s*\n(.*?)(?=@<TRIPOS>|\z)", 1)
    rows = texts.select(*(c for c in texts.columns if c != text), F.explode(F.split(body, "\n")).alias("line")).withColumn("f", F.split(F.trim("line"), r"\s+")).where(F.size("f") >= 6)
    f = lambda i: F.col("f")[i]
    return rows.select(*(c for c in texts.columns if c != text), f(0).try_cast("int").alias("id"), f(1).alias("name"), *(f(2 + i).try_cast("double").alias(c) for i, c in enumerate("xyz")), f(5).alias("kind"))


def sdf_records(texts: DataFrame, text: str = "value") -> DataFrame:
    """Records of whole SDF texts between $$$$ lines: place and code (first line); the first record of a code is kept."""
    r = texts.select(*(c for c in texts.columns if c != text), F.posexplode(F.split(text, r"\$\$\$\$\r?\n?")).alias("place", "record")).where(F.length(F.trim("record")) > 0)
    r = r.withColumn("code", F.trim(F.split("record", "\n")[0]))
    return r.groupBy("code").agg(F.min_by("record", "place").alias("record"), F.min("place").alias("place"))


def max_identity(df: DataFrame, header: str, identity: str) -> DataFrame:
    """Greatest identity of each query, whose id is the second |-field of the header; headers with fewer than three fields are dropped."""
    return df.where(F.size(F.split(header, r"\|")) >= 3).groupBy(F.split_part(header, F.lit("|"), F.lit(2)).alias("id")).agg(F.max(identity).alias("identity"))


def key_values(lines: DataFrame, line: str = "value", order: str | None = None) -> DataFrame:
    """Key and value of whitespace-separated lines; the last line of a key wins, lines without a value are dropped."""
    f = F.split(F.trim(line), r"\s+")
    rows = lines.where(F.size(f) >= 2).select(F.get(f, 0).alias("key"), F.get(f, 1).alias("value"), *([F.col(order).alias("_o")] if order else []))
    return rows.groupBy("key").agg(F.max_by("value", "_o").alias("value") if order else F.max("value").alias("value"))


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON run documents by a stated nested schema; what a document lacks is NULL."""
    return spark.read.schema(schema).json(path)


def parse_list(c: Column) -> Column:
    """A list of numbers written as text."""
    return F.from_json(c, "array<double>")


def score_from_name(path: Column, pattern: str = r"score_([0-9.]+?)\.[a-z]") -> Column:
    return F.coalesce(F.regexp_extract(path, pattern, 1).try_cast("double"), F.lit(0.0))


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
