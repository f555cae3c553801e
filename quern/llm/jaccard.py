"""Exact Jaccard join on word shingles, by size-banded tiles and bitmap signatures.

1. A document is the set of hashes of its distinct shingles of n words; equal sets are one node.
2. Sizes fall into bands.  Two sets that link lie in one band or in neighbours, and differ
   in at most d shingles, where d follows from the band.  Hashing shingles into d + 1 + w
   parts, linked sets agree on w + 1 whole parts at least: a tile is (band, part, content of the part).
   A set gives no tile for its w parts of fewest shingles: what it leaves out are no more than w of the parts
   that two linked sets agree on, and never the fullest of these.  So linked sets still share a tile, and empty or
   tiny parts, which any two sets may share, make none: else unrelated sets hang together, ever more with their number.
   The nodes of a tile hang on its least node; connected parts of that graph are candidate groups.
3. Inside a group, sets are compared within size bands: bitmaps of their shingles bound the
   overlap from above, and what passes is intersected exactly, as sorted arrays.  A
   search from node to node only compares with nodes not yet reached, so a group of n near copies takes
   about n intersections and gives n - 1 links, not n squared; see links() for large groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _tables as tables
from . import _words as W

#: Words of a shingle, and linked if NUM * |A or B| <= DEN * |A and B|: the contract of the query; operators take others.
SHINGLE = 3
NUM, DEN = 90, 100
#: Bits of the filter of documents whose sets are fetched: 1 MB.
FILTER_BITS = 1 << 23
#: Sets of a block, and bytes of their hashes, on average; a task of a large candidate group holds two blocks.
BLOCK = 20_000
BLOCK_BYTES = 1 << 26
_BAND = 1.3
#: Parts of fewest shingles that give no tile, to those that do.
SPARE = 0.3


def bands(largest: int, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size, parts, and largest size that a set of the next band may have to link, of each band up to a size."""
    first = [1]
    while first[-1] <= largest:
        first.append(max(first[-1] + 1, int(np.ceil(first[-1] * max(_BAND, 1.02 * den / num)))))
    first = np.array(first + [int(first[-1] * 2)], np.int64)
    top = first[1:] - 1
    reach = den * top // num
    # |A or B| - |A and B| <= (|A| + |B|) (den - num) / (den + num)
    parts = (top + reach) * (den - num) // (den + num) + 1
    return first[:-1], parts, reach


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each text's begin."""
    got = W.words(texts)
    text = got.text_of_word()
    gram = W.grams(got.hash, n)
    whole = W.inside_text(text, n)
    owner, hashes = text[: len(gram)][whole], gram[whole]
    counts = np.diff(got.first)
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        more = np.array([W.grams(got.hash[got.first[t] : got.first[t + 1]], int(counts[t]))[0] for t in few], np.uint64)
        owner, hashes = np.concatenate([owner, few]), np.concatenate([hashes, more])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes = owner[new], hashes[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def _node(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size of each set and a 64-bit digest of it."""
    size = np.diff(first)
    total = np.concatenate([[W.U64(0)], np.cumsum(W.mix(hashes + W.U64(77)), dtype=np.uint64)])
    return size, W.mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64) * W._BASE)


def _tiles(hashes: np.ndarray, first: np.ndarray, fresh: np.ndarray | None = None, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """Tile keys of each set (of the fresh ones only), one after another, and where each set's begin."""
    size = np.diff(first)
    low, parts, reach = bands(int(size.max(initial=1)), num, den)
    band = np.searchsorted(low, size, "right") - 1
    keys, owner = [], []
    for down in (0, 1):
        tile = band - down
        use = np.flatnonzero((size > 0 if fresh is None else fresh) & (tile >= 0) & ((down == 0) | (size <= reach[tile])) & (parts[tile] > 1))
        if not len(use):
            continue
        given = parts[tile[use]]
        spare = np.ceil(SPARE * given).astype(np.int64)
        n = given + spare
        begin = np.concatenate([[0], np.cumsum(n)])
        slot = np.full(len(size), -1)
        slot[use] = np.arange(len(use))
        mine = np.repeat(slot, size)
        member = mine >= 0
        mine, own = mine[member], hashes[member]
        part = ((own >> W.U64(32)) * n[mine].astype(np.uint64) >> W.U64(32)).astype(np.int64)
        content = np.zeros(begin[-1], np.uint64)
        np.add.at(content, begin[mine] + part, W.mix(own ^ W._BASE))
        place = np.arange(begin[-1]) - np.repeat(begin[:-1], n)
        label = np.repeat(tile[use], n) * (1 << 32) + place
        # of each set in order of (shingles, place): all parts but the spare ones
        order = np.lexsort((place, np.bincount(begin[mine] + part, minlength=begin[-1]), np.repeat(np.arange(len(use)), n)))
        kept = order[place >= np.repeat(spare, n)]
        keys.append(W.mix(content[kept] ^ W.mix(label[kept].astype(np.uint64))))
        owner.append(np.repeat(use, given))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(size) + 1, np.int64)
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return keys[order], np.searchsorted(owner[order], np.arange(len(size) + 1))


def _combined(keys: np.ndarray, begin: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tiles of the sets of a batch, combined before they are shuffled: a tile stays with the least node of the batch that
    has it.  Each other set that has it shares a tile of their own with that least one instead, one for all that they
    have in common.  So a tile that very many sets have leaves a batch once."""
    owner = np.repeat(np.arange(len(node)), np.diff(begin))
    order = np.argsort(node.view(np.int64), kind="stable")
    place = np.empty(len(node), np.int64)
    place[order] = np.arange(len(node))
    by_node = np.argsort(place[owner], kind="stable")
    _, head, inverse = np.unique(keys[by_node], return_index=True, return_inverse=True)
    leader = np.empty(len(keys), np.int64)
    leader[by_node] = owner[by_node][head][inverse]
    first = leader == owner
    pairs = np.unique(owner[~first] * len(node) + leader[~first])
    a, b = pairs // len(node), pairs % len(node)
    pair = W.mix(node[a] ^ W.mix(node[b] ^ W._BASE))
    owner, keys = np.concatenate([owner[first], a, b]), np.concatenate([keys[first], pair, pair])
    order = np.argsort(owner, kind="stable")
    return keys[order], np.searchsorted(owner[order], np.arange(len(node) + 1))


def _sets(docs: DataFrame, what: str, known=None, n: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id and size, node, and with what: tiles (tile keys) or set (sorted hashes, of documents in the filter known)."""

    def run(batches):
        seen: set[int] = set()  # nodes whose tiles this task has given: copies give them once a task
        for batch in W.steps(batches):
            if known is not None:
                key = batch.column("key").to_numpy().view(np.uint64)
                batch = batch.filter(pa.array(tables.in_bitmap(known.value, key)))
            hashes, first = shingles(batch.column("text"), n)
            size, node = _node(hashes, first)
            columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(node.view(np.int64), mask=size == 0)]
            names = ["doc_id", "n_shingles", "node"]
            if what == "tiles":
                fresh = size > 0
                for i, digest in enumerate(node.tolist()):
                    if fresh[i]:
                        fresh[i] = digest not in seen
                        seen.add(digest)
                keys, begin = _combined(*_tiles(hashes, first, fresh, num, den), node)
                columns, names = [*columns, W.lists(W.longs(keys), begin)], [*names, "tiles"]
            elif what == "set":
                raw = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "set"]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = {"tiles": ", tiles array<bigint>", "set": ", set binary"}.get(what, "")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInArrow(run, f"doc_id {kind}, n_shingles bigint, node bigint{more}")


class _Tile:
    """Sets in order of size with bitmaps of their shingles."""

    def __init__(self, sets: list[np.ndarray], num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        size = np.array([len(s) for s in sets], np.int64)
        self.order = np.argsort(size, kind="stable")
        self.size = size[self.order]
        self.sets = [sets[i] for i in self.order]
        width = 1 << int(np.ceil(np.log2(max(64, min(4 * size.max(initial=1), 4096)))))
        self.bits = np.zeros((len(sets), width // 64), np.uint64)
        for row, own in zip(self.bits, self.sets):
            slot = own & np.uint64(width - 1)
            np.bitwise_or.at(row, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        self.ones = np.bitwise_count(self.bits).sum(1, dtype=np.int64)

    def linked(self, at: int, wanted: np.ndarray) -> list[int]:
        """Sets that link with set `at`, among those wanted: those of a fitting size whose bitmap does not
        rule the link out are intersected."""
        lo = np.searchsorted(self.size, -(-self.num * self.size[at] // self.den))
        hi = np.searchsorted(self.size, self.den * self.size[at] // self.num, "right")
        other = lo + np.flatnonzero(wanted[lo:hi])
        if not len(other):
            return []
        need = -(-self.num * (self.size[at] + self.size[other]) // (self.den + self.num))
        # a bit that one set alone has stands for a shingle of its own
        both = np.bitwise_count(self.bits[other] & self.bits[at]).sum(1, dtype=np.int64)
        bound = np.minimum(self.size[at] - self.ones[at], self.size[other] - self.ones[other]) + both
        out, own = [], self.sets[at]
        for to, least in zip(other[bound >= need], need[bound >= need]):
            place = np.searchsorted(own, self.sets[to])
            place[place == len(own)] = 0
            if int((own[place] == self.sets[to]).sum()) >= least:
                out.append(int(to))
        return out


def compare(sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> np.ndarray:
    """Of each of these sets (sorted distinct uint64), the least index among the sets it is linked with over any links."""
    tile = _Tile(sets, num, den)
    root = np.full(len(sets), -1)
    left = np.ones(len(sets), bool)
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        reached, work = [seed], [seed]
        while work:
            new = tile.linked(work.pop(), left)
            left[new] = False
            reached += new
            work += new
        members = tile.order[reached]
        root[members] = members.min()
    return root


def _sets_of(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(s.as_py(), np.uint64) for s in table.column("set")]


def _within(table: pa.Table, num: int, den: int) -> pa.Table:
    """Links (a, b) that hold the classes of one block together."""
    nodes = table.column("node").to_numpy()
    root = compare(_sets_of(table), num, den)
    linked = root != np.arange(len(root))
    return pa.table({"a": nodes[linked], "b": nodes[root[linked]]})


def _across(table: pa.Table, num: int, den: int) -> pa.Table:
    """Links between the asking sets of a block pair and sets of other classes, one for each two classes at least."""
    nodes, asks = table.column("node").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
    tile = _Tile(_sets_of(table), num, den)
    klass = table.column("class").to_numpy()[tile.order].copy()
    a, b = [], []
    for at in np.flatnonzero(asks[tile.order]):
        for to in tile.linked(int(at), klass != klass[at]):
            if klass[to] != klass[at]:
                a.append(nodes[tile.order[at]])
                b.append(nodes[tile.order[to]])
                klass[klass == klass[to]] = klass[at]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _block(by: str = "blocks"):
    return F.pmod(F.xxhash64("node"), F.col(by))


def _block_count(shingles):
    """Blocks that sets need, from their total number of shingles."""
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(shingles) * 8 / BLOCK_BYTES))


def _numbers(count: str):
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))


def links(sets: DataFrame, groups: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Links (a, b) that hold together the classes of candidate groups: sets (component, node, set), distinct nodes;
    groups (component, node, n_shingles) of the same nodes.

    A group of up to BLOCK sets and BLOCK_BYTES is searched in one task.  A larger one goes in three steps.  Each block is searched by itself;
    one set of every class found is then compared with those of all other blocks, block pair by block pair; and what does
    not belong to the group's largest class by then is compared with all sets of other classes, again block pair by
    block pair.  No pair of different classes is left out, and near copies, which come to be one class in the
    first two steps, are not compared pair by pair.
    """
    size = groups.groupBy("component").agg(_block_count("n_shingles").alias("blocks"))
    placed = sets.join(size, "component").withColumn("mine", _block())
    inside = tables.written(placed.select("component", "mine", "node", "set").groupBy("component", "mine").applyInArrow(lambda t: _within(t, num, den), "a bigint, b bigint"))
    if not size.where("blocks > 1").limit(1).count():
        return inside
    large = tables.written(placed.where("blocks > 1"))

    def classes(edges: DataFrame) -> DataFrame:
        """large with the class of each node so far."""
        found = tables.connected_components(edges.join(large.select(F.col("node").alias("a")), "a", "left_semi"))
        return large.join(found.select("node", F.col("component").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node"))

    def meet(asking: DataFrame, all_: DataFrame) -> DataFrame:
        """Links of asking sets with sets of other classes; both sides in blocks, every two of which meet once."""
        n = asking.groupBy("component").agg(_block_count(F.length("set") / 8).alias("ask_blocks"))
        columns = ["component", "i", "j", "node", "class", "set", "asks"]
        ask = asking.join(n, "component").withColumn("j", _block("ask_blocks")).withColumn("asks", F.lit(True)).withColumn("i", _numbers("blocks")).select(*columns)
        rest = all_.join(n, "component").withColumn("i", _block()).withColumn("asks", F.lit(False)).withColumn("j", _numbers("ask_blocks")).select(*columns)
        return ask.union(rest).groupBy("component", "i", "j").applyInArrow(lambda t: _across(t, num, den), "a bigint, b bigint")

    once = tables.written(classes(inside))
    firsts = once.where("node = class")
    counts = firsts.groupBy("component").agg(_block_count(F.length("set") / 8).alias("blocks"))
    firsts = firsts.drop("blocks").join(counts, "component")
    edges = inside.union(tables.written(meet(firsts, firsts)))
    twice = tables.written(classes(edges))
    sizes = twice.groupBy("component", "class").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("component").agg(F.max_by("class", F.struct("n", "class")).alias("largest"))
    stray = twice.join(largest, "component").where(F.col("class") != F.col("largest")).drop("largest")
    return edges.union(tables.written(meet(stray, twice)))


def candidate_groups(docs: DataFrame, n: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(node, component): nodes that share tiles, directly or over others."""
    tiles = _sets(docs, "tiles", None, n, num, den).where("n_shingles > 0").select("node", F.explode("tiles").alias("tile"))
    least = F.first("node").over(Window.partitionBy("tile").orderBy("node"))
    edges = tiles.select(F.col("node").alias("a"), least.alias("b")).where("a <> b").distinct()
    return tables.connected_components(tables.written(edges))


def linked_classes(docs: DataFrame, n: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs, linked over shingles of n words at a Jaccard of num / den.

    component_id is the least doc_id that links reach.  Documents without words (null and empty
    texts) have size 0 and are their own.  Rows with equal sets are linked; rows that share a
    doc_id keep a row each.  A row without doc_id gets the component of an equal set, else null.
    """
    spark = docs.sparkSession
    sized = tables.written(_sets(docs, "node", None, n))
    groups = candidate_groups(docs, n, num, den)
    firsts = sized.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"))
    wanted = tables.written(groups.join(firsts, "node"))  # node, component, first, n_shingles
    known = spark.sparkContext.broadcast(tables.bitmap(wanted.select(F.xxhash64("first").alias("key")), "key", FILTER_BITS))
    sets = _sets(docs, "set", known, n).select(F.col("doc_id").alias("first"), "node", "set")
    sets = sets.join(wanted, ["first", "node"]).dropDuplicates(["node"])
    classes = tables.connected_components(links(sets.select("component", "node", "set"), wanted, num, den))
    named = firsts.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    ids = named.groupBy("class").agg(F.min("first").alias("component_id"))
    of_node = named.join(ids, "class").select("node", "component_id")
    return sized.join(of_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, n: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs with one document, that of least doc_id, of each class.  Rows that share the id that stays all
    stay; so do rows without an id."""
    classes = linked_classes(docs, n, num, den)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


#: All pairs that share a shingle, then reachability.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)
"""
