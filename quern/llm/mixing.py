"""Mixing sources to target weights.

The words of each source, its documents end to end, are packed into blocks of BLOCK words.
Output slots are dealt in shards of SHARD slots: a shard's count of a source is the whole
part of its expected share, and one multinomial draw, seeded by the shard, deals the slots
that remain (over DRAWN sources or fewer; more are drawn as groups first, then within each group).  A source's j-th slot takes block permutation(j mod blocks) of that
source, in its (j div blocks)-th pass; blocks are then joined by index.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _tables as tables
from . import _words as W

BLOCK = 64
SHARD = 8192
SEED = 11
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Pieces that a source's documents are dealt into for running totals at least, and rows of a piece beyond that; no task holds all of a source.
PIECES = 512
PIECE_ROWS = 500_000
#: Sources up to which their table is broadcast, and sources that one draw is over; many sources are drawn in two steps.
BROADCAST_SOURCES = 50_000
DRAWN = 4096
#: Slots that a task lays out.
TASK_SLOTS = 1 << 18
_ROUND = W.mix(np.arange(1, 5, dtype=np.uint64))


def sizes(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, source, size: words [^ \\t-\\r]+ of each text (null: 0), and the text if it is kept."""
    more = ["text"] if keep_text else []

    def run(batches):
        for batch in W.steps(batches):
            raw, offsets = W.buffers(batch.column("text"))
            inside = W.SPACED[raw]
            heads = inside.copy()
            heads[1:] &= ~inside[:-1] if len(raw) else heads[1:]
            if len(raw):
                borders = offsets[:-1][np.diff(offsets) > 0]
                heads[borders] = inside[borders]
            count = np.concatenate([[0], np.cumsum(heads)])
            own = [batch.column("doc_id"), batch.column("source"), pa.array(np.diff(count[offsets]), pa.int64()), *map(batch.column, more)]
            yield pa.RecordBatch.from_arrays(own, ["doc_id", "source", "size", *more])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, source string, size bigint" + ", text string" * keep_text)


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, rank, source_size, target of each source (null: one source, the last).

    Weights repeat over the sources in order of code points.  A source stops at `most` times
    its size; what it leaves goes to the others by weight.  That is a water level: with
    sources in order of limit / weight, those before some point stop at their limits and the
    rest get their weight's part of what is left.  Windows here run over one row a source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = by.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("limit", most * F.col("source_size"))
    order = everything.orderBy(F.col("limit") / F.col("weight"), "rank")
    level = (
        ranked.withColumn("wanted", share * F.sum("source_size").over(everything))
        .withColumn("used", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("used")) / F.col("left"))
        # the first source whose limit is above its part sets the level for all after it
        .withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(everything))
    )
    return level.select("source", "rank", "source_size", F.coalesce(F.least(F.col("final.level") * F.col("weight"), F.col("limit")), F.col("limit")).alias("target"))


def running_total(df: DataFrame, group: str, order: list, value: str, name: str, pieces: int, ties: tuple = ()) -> DataFrame:
    """df with the total of value over the rows of its group that come before each row.

    Rows come in order of a hash piece of their order columns, then of those, then of ties.  Each piece is summed by itself and starts at the
    total of the pieces before it, so a group's rows may lie in `pieces` tasks.
    """
    df = df.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(pieces)))
    within = Window.partitionBy(group, "_piece").orderBy(*order, *ties)
    starts = df.groupBy(group, "_piece").agg(F.sum(value).alias("_sum"))
    starts = starts.withColumn("_before", F.sum("_sum").over(Window.partitionBy(group).orderBy("_piece")) - F.col("_sum")).drop("_sum")
    summed = df.withColumn("_own", F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    return summed.join(starts, [group, "_piece"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_before", "_own", "_piece")


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index below n (of its own) in a pseudorandom permutation of range(n): a
    Feistel network on the next even number of bits, walked until it falls below n."""
    half = (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2
    mask = (np.uint64(1) << half.astype(np.uint64)) - np.uint64(1)
    half = half.astype(np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x, m, h, k = out[todo], mask[todo], half[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (W.mix(right + k + _ROUND[r]) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _dealt(n: int, part: np.ndarray, seed: list[int]) -> np.ndarray:
    """n slots dealt by shares: the whole part of each, and one multinomial draw of what remains."""
    part = part / part.sum()
    out = np.floor(n * part).astype(np.int64)
    rest, over = n * part - out, int(n - out.sum())
    if over:
        out += np.random.default_rng(seed).multinomial(over, rest / rest.sum())
    return out


def _draw_groups(groups: list, slots: int, seed: int):
    """Rows shard, group, count for each shard: slots that fall to each group of DRAWN sources."""
    number = np.array([r["group"] for r in groups])
    part = np.array([r["slots"] for r in groups])

    def run(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                count = _dealt(min(SHARD, slots - shard * SHARD), part, [seed, shard])
                kept = count > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(kept.sum(), shard)), pa.array(number[kept], pa.int64()), pa.array(count[kept])], ["shard", "group", "count"])

    return run


def _draw_sources(seed: int):
    """Rows shard, rank, count from rows shard, group, count and the sources of the group."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard, group, n = (batch.column(c)[i].as_py() for c in ("shard", "group", "count"))
                rank, part = (batch.column("sources")[i].values.field(c).to_numpy() for c in ("rank", "slots"))
                count = _dealt(n, part, [seed, shard, group])
                kept = count > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(kept.sum(), shard)), pa.array(rank[kept], pa.int32()), pa.array(count[kept])], ["shard", "rank", "count"])

    return run


def _slots(seed: int):
    """A row for each slot of a shard's count: its source and the block that it takes."""

    def run(batches):
        for batch in batches:
            get = {c: batch.column(c).to_numpy() for c in ("shard", "rank", "count", "begin", "blocks", "passes")}
            for at in range(0, batch.num_rows):
                count = int(get["count"][at])
                j = get["begin"][at] + np.arange(count)
                blocks = int(get["blocks"][at])
                j = j[j < blocks * get["passes"][at]]
                rank = int(get["rank"][at])
                key = W.mix(np.full(len(j), seed * 1_000_003 + rank, np.uint64))
                block = permute(j % blocks, np.full(len(j), blocks), key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(j), get["shard"][at])), pa.array(np.full(len(j), rank), pa.int32()), pa.array(j), pa.array(block)], ["shard", "rank", "slot", "block"]
                )

    return run


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = SEED, keep_text: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, fragments, slots) of the mix.

    documents: doc_id, size, rank, source_size, target and begin, the place of the document's
    first word among its source's.  fragments: rank, block, doc_id and words, the part
    of the document in that block of its source.  slots: shard, rank, slot, block: the blocks that each
    output shard takes.  Joining slots and fragments on (rank, block) is the mix; see mixed_corpus().  With keep_text, documents
    have their source and text.

    Rows that share a doc_id are documents of their own.  Empty and null texts have no fragments.
    Everything follows from the table's content and the seed, so that reruns agree; equal rows are alike.
    """
    spark = docs.sparkSession
    sized = tables.written(sizes(docs, keep_text))
    more = ("text",) if keep_text else ()
    sources = tables.written(targets(sized, weights, share, most))
    plan = (
        sources.where("source_size > 0")
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumn("slots", F.col("blocks") * F.col("target") / F.col("source_size"))
    )
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    small = F.broadcast if few else lambda df: df
    groups = plan.groupBy(F.floor(F.col("rank") / DRAWN).alias("group")).agg(
        F.sum("slots").alias("slots"), F.array_sort(F.collect_list(F.struct(F.col("rank").cast("bigint").alias("rank"), F.col("slots").cast("double").alias("slots")))).alias("sources")
    )
    groups = tables.written(groups)
    totals = sorted(groups.select("group", "slots").collect(), key=lambda r: r["group"])  # one row for each DRAWN sources
    slots = round(sum(r["slots"] for r in totals))
    pieces_of = lambda rows: max(PIECES, -(-rows // PIECE_ROWS))
    placed = sized.join(small(sources), sized.source.eqNullSafe(sources.source)).select("doc_id", "size", *more, *([sized.source] if keep_text else []), "rank", "source_size", "target")
    placed = running_total(placed, "rank", ["doc_id", "size"], "size", "begin", pieces_of(sized.count()), more)
    pieces = placed.where("size > 0").select(
        "rank", "doc_id", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))).alias("block")
    )
    fragments = pieces.withColumn("words", F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("begin", F.col("block") * block)).select("rank", "block", "doc_id", "begin", "words")
    if not slots:
        return placed, fragments, spark.createDataFrame([], "shard bigint, rank int, slot bigint, block bigint")
    shards = spark.range(-(-slots // SHARD)).mapInArrow(_draw_groups(totals, slots, seed), "shard bigint, group bigint, count bigint")
    shards = shards.join(small(groups.select("group", "sources")), "group").select("shard", "group", "count", "sources").mapInArrow(_draw_sources(seed), "shard bigint, rank int, count bigint")
    shards = running_total(shards, "rank", ["shard"], "count", "begin", pieces_of(-(-slots // SHARD)))
    shards = shards.join(small(plan.select("rank", "blocks", F.lit(int(most)).alias("passes"))), "rank")
    # a shard and source makes up to SHARD rows: as many tasks as the slots need, whatever their few rows here suggest
    shards = shards.repartition(max(1, -(-slots // TASK_SLOTS)), "shard", "rank")
    dealt = shards.select("shard", "rank", "count", "begin", "blocks", "passes").mapInArrow(_slots(seed), "shard bigint, rank int, slot bigint, block bigint")
    return placed, fragments, dealt


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """The digest of mix_sources(): doc_id, size, source_size, target, taken."""
    placed, fragments, dealt = mix_sources(docs, **options)
    uses = dealt.groupBy("rank", "block").agg(F.count("*").alias("uses"))
    taken = fragments.join(uses, ["rank", "block"]).groupBy("rank", "doc_id", "begin").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    nonempty = placed.where("size > 0")
    whole = nonempty.join(taken, (nonempty.rank == taken.rank) & (nonempty.begin == taken.begin), "left").select(nonempty.doc_id, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    empty = placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"))
    return whole.unionByName(empty)


def _cut(block: int, names: list[str]):
    """Rows rank, block, begin, doc_id, text: the words of each document that lie in each block of its source, by single spaces."""
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def run(batches):
        for batch in W.steps(batches):
            columns: list[list] = [[], [], [], [], []]
            for rank, begin, doc_id, text in zip(*(batch.column(c).to_pylist() for c in names)):
                words, at = word.findall(text), 0
                while at < len(words):
                    k = (begin + at) // block
                    to = (k + 1) * block - begin
                    for column, value in zip(columns, (rank, k, begin, doc_id, " ".join(words[at:to]))):
                        column.append(value)
                    at = to
            kinds = [batch.schema.field("rank").type, pa.int64(), pa.int64(), batch.schema.field("doc_id").type, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["rank", "block", "begin", "doc_id", "text"])

    return run


def mixed_corpus(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: doc_id, source, size, source_size, target, shard, slot, words and text of each part of a document that a slot
    takes, and one row without shard, slot and text, of 0 words, for each document that no slot takes a word of.

    A shard's parts in order of (source, slot, place in the source) are its text.
    """
    block = options.get("block", BLOCK)
    placed, _, dealt = mix_sources(docs, keep_text=True, **options)
    placed = tables.written(placed)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["rank", "begin", "doc_id", "text"]
    parts = placed.where("size > 0").select(*names).mapInArrow(_cut(block, names), f"rank int, block bigint, begin bigint, doc_id {kind}, text string")
    taken = parts.join(dealt, ["rank", "block"]).select("rank", "begin", "shard", "slot", F.size(F.split("text", " ")).cast("bigint").alias("words"), "text")
    own = placed.where("size > 0").select("doc_id", "source", "size", "source_size", "target", F.col("rank").alias("_rank"), F.col("begin").alias("_begin"))
    full = own.join(taken, (F.col("rank") == F.col("_rank")) & (F.col("begin") == F.col("_begin")), "left")
    columns = ["doc_id", "source", "size", "source_size", "target", "shard", "slot"]
    rest = placed.where("size = 0").select(*columns[:5], F.lit(None).cast("bigint").alias("shard"), F.lit(None).cast("bigint").alias("slot"), F.lit(0).cast("bigint").alias("words"), F.lit(None).cast("string").alias("text"))
    return full.select(*columns, F.coalesce("words", F.lit(0)).cast("bigint").alias("words"), "text").union(rest)
