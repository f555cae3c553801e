"""Sources, sinks and adapters of external scorers.  Files are written to the shared folder first and then read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as S
from ..operators.features import nearest_within
from ..sources import files, sinks
from .fixtures import ATOMS, ITEMS, atoms, ranked_items, table
from .registry import query


@query("SELECT n_nationkey, n_name FROM nation")
def src1_csv(spark, sf_dir):
    path = sinks.scratch(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "nation"), path)
    return files.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int", ["n_nationkey", "n_name"])


@query(
    f"""WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY g // 50, (idx - 1) // 10000 ORDER BY g, idx) - 1 AS item FROM items)
 SELECT 'test' AS split, item, 'labels' AS field, y::DOUBLE AS value FROM r UNION ALL SELECT 'test', item, 'sample_index', g::DOUBLE FROM r UNION ALL SELECT 'test', item, 'score__raw', sa FROM r"""
)
def src2_archive(spark, sf_dir):
    """NPZ archives of labels and scores, each of up to 10,000 items of up to 50 complexes, read into long form."""
    i = ranked_items(spark, sf_dir).select("g", "idx", "y", "sa", F.floor(F.col("g") / 50).alias("shelf"), F.floor((F.col("idx") - 1) / 10_000).alias("part"))
    arrays = {"test__labels": ("y", "int8"), "test__sample_index": ("g", "int32"), "test__score__raw": ("sa", "float64")}
    return files.parse_archives(sinks.kept_table(sinks.packed_archives(i, ["shelf", "part"], ["g", "idx"], arrays)))


_PDB = "printf('%-6s%5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f%22s%2s', CASE WHEN ligand = 1 THEN 'HETATM' ELSE 'ATOM' END, id, 'CA', 'GLY', 'A', id % 50, x, y, z, '', 'C')"


def _pdb_lines(spark, sf_dir):
    p = atoms(spark, sf_dir)
    line = F.format_string("%-6s%5s %-4s %3s %1s%4d    %8.3f%8.3f%8.3f%22s%2s", F.when(F.col("ligand") == 1, "HETATM").otherwise("ATOM"), files.pdb_serial(F.col("id")), F.lit("CA"), F.when(F.col("id") % 3 == 0, "ALA").otherwise("GLY"), F.lit("A"), F.col("id") % 50, "x", "y", "z", F.lit(""), F.lit("C"))
    bad = p.where("id % 40 = 0").select("g", F.lit("ATOM  12x45 broken").alias("line"), F.lit(-1).cast("bigint").alias("line_no"))
    return p.select("g", line.alias("line"), F.col("id").alias("line_no")).union(bad)


@query(f"WITH {ATOMS} SELECT g, CASE WHEN ligand = 1 THEN 'HETATM' ELSE 'ATOM' END AS record, CAST(id AS INT) AS serial, 'CA' AS name, CASE WHEN id % 3 = 0 THEN 'ALA' ELSE 'GLY' END AS resname, CAST(id % 50 AS VARCHAR) AS resnr, x, y, z, 'C' AS element FROM atoms")
def src3_pdb(spark, sf_dir):
    return files.parse_pdb(_pdb_lines(spark, sf_dir)).select("g", "record", "serial", "name", "resname", "resnr", "x", "y", "z", "element")


@query(
    f"""WITH {ATOMS}, r AS (SELECT g, CAST(id % 50 AS VARCHAR) AS resnr, CASE WHEN id % 3 = 0 THEN 'ALA' ELSE 'GLY' END AS resname, min(id) AS f FROM atoms GROUP BY ALL) SELECT g, resnr, resname, CASE resname WHEN 'ALA' THEN 'A' ELSE 'G' END AS letter, row_number() OVER (PARTITION BY g ORDER BY f) - 1 AS place FROM r"""
)
def src4_ordered_residues(spark, sf_dir):
    a = files.parse_pdb(_pdb_lines(spark, sf_dir))
    return files.ordered_residues(a, ["g"], "line_no").select("g", "resnr", "resname", "letter", "place")


@query("SELECT s_suppkey::INT AS id, s_name AS hetid, round(s_acctbal, 2) AS v FROM supplier")
def src5_xml(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    path = sinks.scratch(spark, "xml")
    site = F.concat(F.lit("<bindingsite id='"), F.col("s_suppkey").cast("string"), F.lit("'><identifiers><hetid>"), F.col("s_name"), F.lit("</hetid></identifiers><v>"), F.format_string("%.2f", "s_acctbal"), F.lit("</v></bindingsite>"))
    reports = s.groupBy(F.col("s_suppkey") % 4).agg(F.concat(F.lit("<report>"), F.array_join(F.collect_list(site), ""), F.lit("</report>")).alias("line"))
    reports.select("line").write.option("maxRecordsPerFile", 1).text(path)  # a file is one document
    x = files.read_xml(spark, path, "bindingsite", "_id int, identifiers struct<hetid:string>, v double")
    return x.select(F.col("_id").alias("id"), "identifiers.hetid", "v")


@query(f"WITH {ATOMS} SELECT g, id::INT AS id, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM atoms WHERE ligand = 1")
def src6_mol2(spark, sf_dir):
    p = atoms(spark, sf_dir).where("ligand = 1")
    line = F.format_string("%7d C1 %9.3f %9.3f %9.3f C.3 1 LIG 0.0", "id", "x", "y", "z")
    texts = p.groupBy("g").agg(F.concat(F.lit("@<TRIPOS>MOLECULE\nlig\n@<TRIPOS>ATOM\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n@<TRIPOS>BOND\n1 1 2 1 a b c\n")).alias("value"))
    return files.mol2_atoms(texts).select("g", "id", "x", "y", "z")


@query("SELECT s_name AS code, 0 AS place FROM supplier WHERE s_suppkey % 2 = 0")
def src7_sdf(spark, sf_dir):
    """The first record of each wanted code of an SDF stream."""
    s = table(spark, sf_dir, "supplier")
    texts = s.select(F.concat("s_name", F.lit("\n  x\nM  END\n$$$$\n"), "s_name", F.lit("\n  second\nM  END\n$$$$\n")).alias("value"))
    wanted = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("code"))
    return files.sdf_records(texts).join(wanted, "code", "left_semi").select("code", "place")


@query("SELECT CAST(l_suppkey AS VARCHAR) AS id, max(l_discount) AS identity FROM lineitem GROUP BY 1")
def src8_max_identity(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("q|"), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") > 100, "").otherwise("|x")).alias("header"), "l_discount")
    return files.max_identity(h, "header", "l_discount").select("id", "identity")


@query("SELECT s_name AS key, CAST(s_suppkey AS VARCHAR) AS value FROM supplier")
def src9_key_values(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    lines = s.select(F.concat(F.regexp_replace("s_name", " ", "_"), F.lit(" \t "), F.col("s_suppkey").cast("string")).alias("value"), F.col("s_suppkey").alias("o")).union(s.select(F.lit("lonely").alias("value"), F.lit(0).cast("bigint")))
    return files.key_values(lines, "value", "o")


@query("SELECT s_suppkey AS seed, round(s_acctbal, 2) AS ece, CAST(NULL AS DOUBLE) AS missing FROM supplier")
def src10_json_runs(spark, sf_dir):
    path = sinks.scratch(spark, "json")
    doc = F.to_json(F.struct(F.col("s_suppkey").alias("seed"), F.struct(F.round("s_acctbal", 2).alias("ece")).alias("calibration")))
    sinks.write_text(table(spark, sf_dir, "supplier").select(doc.alias("line")), path, "line")
    m = files.read_metrics(spark, path, "seed bigint, calibration struct<ece:double,missing:double>")
    return m.select("seed", "calibration.ece", "calibration.missing")


@query("SELECT s_suppkey AS id, 3 AS n, round(s_acctbal, 2) AS first FROM supplier")
def src11_text_list(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.format_string("[%.2f, 1.5, 2]", "s_acctbal").alias("t"))
    v = t.withColumn("v", files.parse_list(F.col("t")))
    return v.select("id", F.size("v").alias("n"), F.col("v")[0].alias("first"))


@query("SELECT c_custkey, c_name FROM customer")
def src12_shards(spark, sf_dir):
    """Overlapping shards of an index as one table."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    paths = [sinks.scratch(spark, "shard") for _ in range(2)]
    sinks.write_csv(c.where("c_custkey % 3 <> 0"), paths[0])
    sinks.write_csv(c.where("c_custkey % 3 <> 1"), paths[1])
    return files.read_shards(spark, paths, "c_custkey bigint, c_name string", "c_custkey")


@query("SELECT o_custkey AS target, o_orderkey AS ligand, CAST(o_orderstatus = 'F' AS INT) AS label FROM orders")
def src13_pair_store(spark, sf_dir):
    path = sinks.scratch(spark, "pairs")
    table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("ligand"), (F.col("o_orderstatus") == "F").cast("int").alias("label")).write.parquet(path)
    return files.read_pairs(spark, path)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE (s_suppkey % 100) / 100.0::DOUBLE END AS score FROM supplier")
def src14_score_from_name(spark, sf_dir):
    name = F.when(F.col("s_suppkey") % 4 == 0, "pocket.mol2").otherwise(F.format_string("pocket_score_%.2f.mol2", (F.col("s_suppkey") % 100) / 100))
    return table(spark, sf_dir, "supplier").select("s_suppkey", files.score_from_name(name).alias("score"))


@query("SELECT o_orderpriority AS split, count(*) AS n FROM orders GROUP BY 1")
def snk1_snk2_snk3_archives(spark, sf_dir):
    """CSV, partitioned archive and sharded writers: rows written by split."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split"), "o_orderkey")
    path = sinks.scratch(spark, "shards")
    sinks.write_shards(o, path, "split", 256)
    return spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (c_custkey % 5 < 3) AS first, count(*) FILTER (c_custkey % 5 >= 3) AS second FROM customer")
def snk6_resumable(spark, sf_dir):
    """A resumable table takes each key once: some keys first, then the whole table."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    path = sinks.scratch(spark, "cache")
    first = sinks.append_missing(c.where("c_custkey % 5 < 3"), path, "c_custkey")
    second = sinks.append_missing(c, path, "c_custkey")
    return spark.createDataFrame([(first, second)], "first bigint, second bigint")


@query("SELECT c_nationkey AS nation, count(*) AS n, 0::BIGINT AS again, true AS refused FROM customer GROUP BY 1")
def snk6_complete_cache(spark, sf_dir):
    """A cache with a completion marker: written once for a source, refused for another one."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    path = sinks.scratch(spark, "complete")
    count = lambda rows: rows.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    sinks.write_cache(c, path, "nation", count)
    again = sinks.write_cache(c, path, "nation", count)
    try:
        sinks.read_cache(c.withColumn("c_nationkey", F.col("c_nationkey") + 1), path)
        refused = False
    except ValueError:
        refused = True
    return sinks.read_cache(c, path).select("nation", "n", F.lit(again).cast("bigint").alias("again"), F.lit(refused).alias("refused"))


@query("SELECT '>' || s_name || chr(10) || repeat('A', (s_suppkey % 5 + 1)::INT) AS record FROM supplier")
def snk7_fasta(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat_ws("\n", F.concat(F.lit(">"), "s_name"), F.repeat(F.lit("A"), (F.col("s_suppkey") % 5 + 1).cast("int"))).alias("record"))


@query(
    """SELECT vec_id AS g, k AS place, round(embedding[k + 1]::DOUBLE, 3) AS score FROM (SELECT vec_id, embedding, unnest(range(least(64, vec_id % 7 + 1))) AS k FROM embeddings)"""
)
def b1_list_scores(spark, sf_dir):
    """A list column of scores laid along residues, cut to the shorter."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("g"), F.to_json("embedding").alias("t"), (F.col("vec_id") % 7 + 1).cast("int").alias("n"))
    v = e.select("g", F.posexplode(F.slice(files.parse_list(F.col("t")), F.lit(1), F.least(F.col("n"), F.lit(64)))).alias("place", "v"))
    return v.select("g", F.col("place").cast("bigint").alias("place"), F.round("v", 3).alias("score"))


@query(
    """WITH p AS (SELECT o_custkey AS g, unnest(string_split((o_orderkey % 30) || '+' || (o_orderkey % 17), '+')) AS number, o_totalprice AS score FROM orders), m AS (SELECT g, number, max(score) AS score FROM p GROUP BY ALL),
 r AS (SELECT c_custkey AS g, CAST(n AS VARCHAR) AS number FROM customer CROSS JOIN range(10) t(n)) SELECT g, number, coalesce(score, 0) AS score FROM r LEFT JOIN m USING (g, number)"""
)
def b2_pocket_residues(spark, sf_dir):
    """Pocket rows exploded on +, greatest score a residue number, 0 without one."""
    o = table(spark, sf_dir, "orders")
    p = o.select(F.col("o_custkey").alias("g"), F.concat_ws("+", (F.col("o_orderkey") % 30).cast("string"), (F.col("o_orderkey") % 17).cast("string")).alias("numbers"), F.col("o_totalprice").alias("score"))
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("g"), F.explode(F.array(*(F.lit(str(i)) for i in range(10)))).alias("number"))
    return S.exploded_scores(r, p, "g", "numbers", "score")


_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(
    f"""WITH {ATOMS}, d AS (SELECT a.g, a.id, b.id AS target, {_D} AS d, row_number() OVER (PARTITION BY a.g, a.id ORDER BY {_D}, b.id) AS r FROM atoms a JOIN atoms b ON a.g = b.g AND a.ligand = 1 AND b.ligand = 0 AND {_D} <= 10)
 SELECT g, target % 50 AS residue, max(id)::DOUBLE AS score FROM d WHERE r = 1 GROUP BY 1, 2"""
)
def b3_nearest_atom_scores(spark, sf_dir):
    """Pocket atoms to their nearest protein atom, then the greatest score of each residue."""
    p = atoms(spark, sf_dir)
    near = nearest_within(p.where("ligand = 1"), p.where("ligand = 0"), "g", 10.0)
    return near.groupBy("g", (F.col("target") % 50).alias("residue")).agg(F.max(F.col("id")).cast("double").alias("score"))


@query("SELECT conv_id AS id, count(*) AS residues, CASE WHEN count(*) > 8 THEN 'too long' WHEN count(*) % 2 = 1 THEN 'odd' ELSE 'ok' END AS reason FROM conversations GROUP BY 1")
def b4_sequence_audit(spark, sf_dir):
    """Sequences by length, with why one is skipped."""
    n = F.count("*")
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(n.alias("residues"), F.when(n > 8, "too long").when(n % 2 == 1, "odd").otherwise("ok").alias("reason"))


@query("SELECT o_custkey AS g, o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY 1, 2")
def b5_interaction_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("g"), F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT o_custkey AS g, 'F' AS method, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS g, 'O' AS method, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
 u AS (SELECT * FROM a WHERE g IN (SELECT g FROM b) UNION ALL SELECT * FROM b WHERE g IN (SELECT g FROM a)) SELECT method, count(*) AS common, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS sd FROM u GROUP BY method"""
)
def b6_common_subset(spark, sf_dir):
    """Methods compared over what both of them cover."""
    v = table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')").groupBy(F.col("o_custkey").alias("g"), F.col("o_orderstatus").alias("method")).agg(F.avg("o_totalprice").alias("v"))
    return S.common_subset(v, "g", "method", "v", 2).withColumns({c: F.round(c, 2) for c in ("mean", "sd")})


@query(
    """WITH n AS (SELECT c_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT CASE WHEN k = 0 THEN 'missing' WHEN k > 25 THEN 'too large' ELSE 'supported' END AS reason, count(*) AS n FROM n GROUP BY 1"""
)
def b7_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return S.coverage(table(spark, sf_dir, "customer"), o, "c_custkey", F.when(F.col("k") == 0, "missing").when(F.col("k") > 25, "too large").otherwise("supported"))




@query("SELECT n_regionkey AS split, count(*) AS n, min(n_name) AS first FROM nation GROUP BY 1")
def snk2_partitioned_archive(spark, sf_dir):
    """A columnar archive with a folder a split, read back by split."""
    path = sinks.scratch(spark, "archive")
    sinks.write_archive(table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "split"), path, ["split"])
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.min("n_name").alias("first"))


@query("SELECT '[{\"r_name\": \"' || r_name || '\", \"r_regionkey\": ' || r_regionkey || '}]' AS document FROM region WHERE r_regionkey = 1")
def snk4_json_document(spark, sf_dir):
    """A small result as one document, keys sorted."""
    return spark.createDataFrame([(sinks.to_json(table(spark, sf_dir, "region").where("r_regionkey = 1")),)], "document string")


@query("SELECT s_suppkey, round(s_acctbal * 2, 2) AS v FROM supplier")
def src15_saved_model(spark, sf_dir):
    """A pipeline saved and loaded again."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer

    path = sinks.scratch(spark, "model")
    s = table(spark, sf_dir, "supplier")
    Pipeline(stages=[SQLTransformer(statement="SELECT s_suppkey, round(s_acctbal * 2, 2) AS v FROM __THIS__")]).fit(s).write().save(path)
    return files.load_model(path).transform(s)


@query("SELECT o_orderpriority AS split, o_orderkey FROM orders WHERE o_totalprice > 300000 ORDER BY 1, 2")
def k7_sorted_sink(spark, sf_dir):
    """Rows in global order by (split, id), as a sink wants them: one range exchange, no single task."""
    return table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderpriority").alias("split"), "o_orderkey").orderBy("split", "o_orderkey")
