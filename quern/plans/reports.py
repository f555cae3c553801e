"""Report tables, data behind figures, audits and the streaming extension."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts
from ..operators import selection as S
from ..sources import sinks
from ..streaming import windows
from .fixtures import table
from .registry import query


@query("SELECT '| ' || s_name || ' | ' || printf('%.4f', s_acctbal) || ' | ' || CASE WHEN s_suppkey % 5 = 0 THEN 'NA' ELSE printf('%.4f ± %.4f', s_acctbal / 10, s_acctbal / 100) END || ' |' AS line FROM supplier")
def snk5_markdown_rows(spark, sf_dir):
    v = F.col("s_acctbal")
    interval = F.when(F.col("s_suppkey") % 5 != 0, F.format_string("%.4f ± %.4f", v / 10, v / 100))
    return sinks.markdown_lines(table(spark, sf_dir, "supplier").select("s_name", "s_acctbal", interval.alias("interval")))


@query("SELECT o_orderpriority AS seed, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS f, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS o, round(avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS delta FROM orders GROUP BY 1")
def v2_v3_pivot(spark, sf_dir):
    """Seeds by component, and the difference of two components."""
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("seed")).pivot("o_orderstatus", ["F", "O"]).agg(F.avg("o_totalprice"))
    return p.select("seed", F.round("F", 2).alias("f"), F.round("O", 2).alias("o"), F.round(F.col("F") - F.col("O"), 2).alias("delta"))


@query("SELECT p_brand AS dataset, CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 30 THEN 'b' ELSE 'c' END AS bin, count(*) AS n, round(avg(p_retailprice), 4) AS mean, round(stddev_samp(p_retailprice), 4) AS sd FROM part GROUP BY 1, 2")
def v4_bin_summary(spark, sf_dir):
    b = cohorts.bin_left(F.col("p_size"), [10, 30], ["a", "b", "c"]).alias("bin")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("dataset"), b).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"), F.round(F.stddev_samp("p_retailprice"), 4).alias("sd"))


@query("SELECT c_mktsegment AS category, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percent FROM customer GROUP BY 1")
def v5_shares(spark, sf_dir):
    return S.shares(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "category"), "category").withColumn("percent", F.round("percent", 4))


@query("SELECT p_type AS condition, min_by(p_name, p_partkey) AS label FROM part GROUP BY 1")
def v6_first_lookup(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("condition")).agg(F.min_by("p_name", "p_partkey").alias("label"))


@query(
    """WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^ \\n]+|token = "[0-9a-f]{8}')) AS hit, text FROM documents) SELECT doc_id, hit, length(substr(text, 1, instr(text, hit)::BIGINT - 1)) - length(replace(substr(text, 1, instr(text, hit)::BIGINT - 1), chr(10), '')) + 1 AS line FROM m"""
)
def u1_forbidden_patterns(spark, sf_dir):
    """Forbidden patterns in texts, each with the line of its first place."""
    return S.pattern_lines(table(spark, sf_dir, "documents"), "doc_id", "text", r'https?://[^ \n]+|token = "[0-9a-f]{8}')


@query("SELECT event_type AS run, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS sd FROM events GROUP BY 1")
def u4_calibration_audit(spark, sf_dir):
    """Values out of JSON documents, summarised by run."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("n"), F.round(F.avg(k), 6).alias("mean"), F.round(F.stddev_samp(k), 6).alias("sd"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON lower(trim(d.text)) = lower(trim(b.text))")
def leakage_exact(spark, sf_dir):
    """Documents that are, normalised, a benchmark item: an equi join on a hash of the text."""
    key = lambda c: F.sha2(F.lower(F.trim(c)).cast("binary"), 256)
    d = table(spark, sf_dir, "documents").select("doc_id", key("text").alias("k"))
    return d.join(table(spark, sf_dir, "benchmark").select("item_id", key("text").alias("k")), "k").select("doc_id", "item_id")


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 hour, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streaming_windows(spark, sf_dir):
    """Hourly counts by a stream over the events file; equal to the batch result."""
    got = windows.run_available(spark, sf_dir, "events.parquet", sinks.scratch(spark, "stream"))
    return got.select(F.unix_timestamp(F.col("w.start")).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 hour, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def batch_windows(spark, sf_dir):
    got = windows.windowed(table(spark, sf_dir, "events"))
    return got.select(F.unix_timestamp(F.col("w.start")).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT method, 3::BIGINT AS repeats, n, true AS timed, true AS ran_tasks, method = 'grouped' AS shuffled FROM (SELECT unnest(['counted', 'grouped']) AS method), (SELECT count(*) AS n FROM lineitem)")
def u3_efficiency(spark, sf_dir):
    """Two ways to look at a table, each measured three times after a warm-up: that times, tasks and shuffled bytes are recorded."""
    from ..measure import measured

    items = table(spark, sf_dir, "lineitem")
    n = items.count()
    works = {"counted": lambda: items.select("l_quantity").write.format("noop").mode("overwrite").save(), "grouped": lambda: items.repartition("l_partkey").write.format("noop").mode("overwrite").save()}
    got = {name: measured(spark, work, repeats=3) for name, work in works.items()}
    rows = [(name, int(m["repeats"]), n, m["median"] > 0 and m["sd"] is not None, m["tasks"] > 0, m["shuffle_mb"] > 0) for name, m in got.items()]
    return spark.createDataFrame(rows, "method string, repeats bigint, n bigint, timed boolean, ran_tasks boolean, shuffled boolean")
