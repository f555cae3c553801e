"""Benchmark decontamination by winnowing.

Of every run of WINDOW consecutive K-word grams, both sides keep the gram of the least
hash, so any shared span of K + WINDOW - 1 = SPAN words shares a kept gram.  Kept grams
are joined on their hash, and each hit is extended word by word on both sides; it stands
if the shared span comes to SPAN words.  Items of fewer words than SPAN are one window
each and are looked up by the hash of all their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tables as tables
from . import _words as W

SPAN = 10
K = 5
WINDOW = SPAN - K + 1
REACH = SPAN - K
#: Bits of the filter of benchmark fingerprints: 1 MB for any benchmark.
FILTER_BITS = 1 << 23
#: Benchmark fingerprints up to which their side of the join is broadcast (some 30 MB).
BROADCAST_ROWS = 100_000

_HIT = "array<struct<fp:bigint,at:int,size:int,before:array<bigint>,after:array<bigint>>>"


def _kept(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """First words of the grams that winnowing keeps (all that tie for least)."""
    gram = W.grams(hashes, K)
    n = len(gram) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least = gram[:n].copy()
    for i in range(1, WINDOW):
        np.minimum(least, gram[i : n + i], out=least)
    whole = W.inside_text(text, SPAN)
    kept = np.zeros(len(gram), bool)
    for i in range(WINDOW):
        kept[i : n + i] |= whole & (gram[i : n + i] == least)
    return np.flatnonzero(kept)


def _context(hashes: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Words before (nearest first) and after each kept gram, 0 beyond the text."""
    sides = []
    for moves in (range(-1, -REACH - 1, -1), range(K, K + REACH)):
        side = np.zeros((len(at), REACH), np.uint64)
        for i, move in enumerate(moves):
            to = at + move
            there = (to >= 0) & (to < len(hashes))
            to = np.where(there, to, 0)
            there &= text[to] == text[at]
            side[there, i] = hashes[to[there]]
        sides.append(W.lists(W.longs(side.reshape(-1)), np.arange(len(at) + 1) * REACH))
    return sides[0], sides[1]


def _fingerprints(batch: pa.RecordBatch, known, short: tuple[int, ...], items: bool) -> tuple[np.ndarray, pa.Array]:
    """n_words and fingerprints of each text.  known: bitmap that a fingerprint must be in."""
    got = W.words(batch.column("text"), W.ALNUM)
    text = got.text_of_word()
    counts = np.diff(got.first)
    found = []  # (word, fp, size)
    at = _kept(got.hash, text)
    gram = W.grams(got.hash, K)
    found.append((at, gram[at], np.full(len(at), K)))
    for n in range(1, SPAN) if items else short:
        whole = W.inside_text(text, n)
        at = np.flatnonzero(whole)
        if items:
            at = at[(counts[text[at]] == n)]
        found.append((at, W.mix(W.grams(got.hash, n)[at] ^ W.U64(n)), np.full(len(at), -n)))
    at, fp, size = (np.concatenate(x) for x in zip(*found))
    if known is not None:
        hit = tables.in_bitmap(known, fp)
        at, fp, size = at[hit], fp[hit], size[hit]
    order = np.argsort(at, kind="stable")
    at, fp, size = at[order], fp[order], size[order]
    before, after = _context(got.hash, text, at)
    values = pa.StructArray.from_arrays(
        [W.longs(fp), pa.array(at - got.first[text[at]] if len(at) else at, pa.int32()), pa.array(size, pa.int32()), before, after],
        ["fp", "at", "size", "before", "after"],
    )
    return counts, W.lists(values, np.searchsorted(at, got.first))


def _mapper(known, short: tuple[int, ...], items: bool):
    def run(batches):
        for batch in W.steps(batches):
            counts, hits = _fingerprints(batch, None if known is None else known.value, short, items)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), hits], ["id", "n_words", "hits"])

    return run


def contaminated_words(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, hits: array<struct<start, end>> of word spans
    that lie in the benchmark, and items: array of the item ids, sorted as strings.

    A null or empty text has no words; a null item text, or one without words, matches
    nothing; an item without an id does hit words but is not listed.  Rows that share an id are judged each for itself.
    Other columns of either table are not read.

    Of docs, only rows with hits are shuffled: a row's word count and those of its fingerprints that pass a fixed-size bit
    filter of the benchmark are written to a table, and what has none of these is done.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    kind = items.schema["id"].dataType.simpleString()
    items = items.mapInArrow(_mapper(None, (), True), f"id {kind}, n_words bigint, hits {_HIT}")
    items = tables.written(items.select("id", F.explode("hits").alias("h")).select(F.col("id").alias("item"), "h.fp", "h.size", F.col("h.before").alias("item_before"), F.col("h.after").alias("item_after")))
    known = spark.sparkContext.broadcast(tables.bitmap(items, "fp", FILTER_BITS))
    short = tuple(sorted(-n for (n,) in items.where("size < 0").select("size").distinct().collect()))
    if items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        items = F.broadcast(items)

    kind = docs.schema[id_col].dataType.simpleString()
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_mapper(known, short, False), f"id {kind}, n_words bigint, hits {_HIT}")
    marked = tables.written(marked.withColumn("row", F.monotonically_increasing_id()))
    hits = marked.where("size(hits) > 0").select("id", "n_words", "row", F.explode("hits").alias("h")).select("id", "n_words", "row", "h.*")

    def reach(a: str, b: str):
        miss = F.array_position(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), False)
        return F.when(miss == 0, F.lit(REACH)).otherwise(miss - 1).cast("int")

    joined = hits.join(items, ["fp", "size"], "left")
    left, right = reach("before", "item_before"), reach("after", "item_after")
    span = F.when(F.col("size") < 0, F.struct(F.col("at").alias("start"), (F.col("at") - F.col("size")).alias("end"))).when(
        left + right + K >= SPAN, F.struct((F.col("at") - left).alias("start"), (F.col("at") + K + right).alias("end"))
    )
    spans = joined.withColumn("span", F.when(F.col("item_before").isNotNull(), span))
    found = spans.groupBy("row", "id", "n_words").agg(
        F.array_sort(F.collect_set("span")).alias("hits"),
        F.array_sort(F.collect_set(F.when(F.col("span").isNotNull(), F.col("item").cast("string")))).alias("items"),
    )
    none = [F.array().cast(found.schema[c].dataType).alias(c) for c in ("hits", "items")]
    rest = marked.where("size(hits) = 0").select("id", "n_words", *none)
    return found.select("id", "n_words", "hits", "items").union(rest).withColumnRenamed("id", id_col)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of contaminated_words(): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contaminated_words(docs, benchmark)
    places = F.array_distinct(F.flatten(F.transform("hits", lambda s: F.sequence(s["start"], s["end"] - 1))))
    return found.select(
        "doc_id",
        "n_words",
        F.size(places).cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs without a benchmark passage.  doc_id identifies a row here: if one of several
    rows of an id is contaminated, all of them go.  Rows without an id are kept."""
    bad = contaminated_words(docs, benchmark).where("size(hits) > 0").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
#: Every window of every text, joined on its words.
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents), b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw))),
h AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
