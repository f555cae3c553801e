"""Phrase collocation mining over vertical positional inverted lists.

A task cuts its documents into shards by language and inverts each: of every word, the ascending positions where it stands, with a
gap between pieces.  A phrase of k words is a list too, of its start positions; it is extended by merge-joining the positions
behind its occurrences with the postings of the words there.  The length of a list is the exact frequency within its shard, and
frequencies are sums over shards.

Levels go up word by word (Apriori): a phrase is extended only where it, and the phrase without its first word, are frequent
over the whole corpus.  Tasks know what is frequent from bitmaps of fixed size, which let some rare phrases through but
stop no frequent one.  A level is counted by 64-bit keys first, then by its words for keys that reached the least
frequency: rare phrases are never shuffled as text, and keys that collide only cost work.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _tables as tables
from . import _words as W

LONGEST = 3
LEAST = 10
KEPT = 2000
#: Percentage of a candidate's occurrences within a longer one from which it is dropped.
WITHIN = 50
#: Bytes of text of a shard, or one longer text.
SHARD_BYTES = 1 << 23
#: Bits of the bitmap of a level at most (8 MB); fewer where it has fewer keys.
BITS = 1 << 26
#: Rows that one window of the ranking holds, or a few times the rows kept.
RANKED = 100_000

_BREAK = np.isin(np.arange(256), [*map(ord, ".,;:!?"), *range(0x0A, 0x0E)])
_WORD = ~(_BREAK | np.isin(np.arange(256), [0x20, 0x09]))
_LEVEL = W.U64(0x9FB21C651E98DF25)


class Lists(NamedTuple):
    """Phrases of one number of words in a shard: the words of each, and its start positions."""

    words: np.ndarray  # a row of word ids a phrase
    first: np.ndarray  # of each phrase, its first entry in `at`; one more entry at the end
    at: np.ndarray  # ascending within a phrase

    def length(self) -> np.ndarray:
        return np.diff(self.first)

    def where(self, keep: np.ndarray) -> Lists:
        size = self.length()
        return Lists(self.words[keep], np.concatenate([[0], np.cumsum(size[keep])]), self.at[np.repeat(keep, size)])


class Shard:
    """Texts of one language, inverted."""

    def __init__(self, texts: pa.Array, lang: str):
        raw, offsets = W.buffers(texts)
        inside = _WORD[raw]
        opens = np.zeros(len(raw) + 1, bool)
        opens[offsets] = True
        start = np.flatnonzero(inside & (~np.append(False, inside[:-1]) | opens[:-1])) if len(raw) else np.zeros(0, np.int64)
        end = np.flatnonzero(inside & (~np.append(inside[1:], False) | opens[1:])) + 1 if len(raw) else start
        borders = np.sort(np.concatenate([np.flatnonzero(_BREAK[raw]), offsets[1:-1]]))
        piece = np.searchsorted(borders, start, "right")
        #: Positions of the occurrences: neighbours within a piece differ by 1, others by more.
        self.at = np.arange(len(start)) + np.cumsum(np.diff(piece, prepend=piece[:1]) != 0)
        spelt = W.LOWER[raw[inside]]
        bounds = np.concatenate([[0], np.cumsum(end - start)])
        found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(spelt))).dictionary_encode()
        self.vocabulary, self.word = found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        data, edges = W.buffers(self.vocabulary)
        self.hash = W._hash(data, np.ones(len(data), bool), edges[:-1], edges[1:])
        self.lang = lang
        self.salt = W.U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))

    def postings(self) -> Lists:
        order = np.argsort(self.word, kind="stable")
        return Lists(np.arange(len(self.vocabulary))[:, None], np.searchsorted(self.word[order], np.arange(len(self.vocabulary) + 1)), self.at[order])

    def keys(self, words: np.ndarray) -> np.ndarray:
        """64-bit keys of phrases, given as rows of word ids."""
        total = np.full(len(words), words.shape[1], np.uint64) * _LEVEL + self.salt
        for i in range(words.shape[1]):
            total += self.hash[words[:, i]] * W._GRAM[i]
        return W.mix(total)

    def extended(self, lists: Lists, postings: Lists) -> Lists:
        """Phrases one word longer: the positions behind each occurrence, merge-joined with the postings."""
        size = lists.words.shape[1]
        behind = lists.at + size
        phrase = np.repeat(np.arange(len(lists.words)), lists.length())
        order = np.argsort(behind, kind="stable")
        behind, phrase = behind[order], phrase[order]
        by_place = np.argsort(postings.at, kind="stable")
        places, word = postings.at[by_place], np.repeat(postings.words[:, 0], postings.length())[by_place]
        met = np.searchsorted(places, behind)  # both sides ascend
        hit = met < len(places)
        hit[hit] = places[met[hit]] == behind[hit]
        at, phrase, word = behind[hit] - size, phrase[hit], word[met[hit]]
        key = phrase * max(1, len(self.vocabulary)) + word
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        head = order[first]
        return Lists(np.column_stack([lists.words[phrase[head]], word[head]]), np.append(first, len(key)), at)

    def phrases(self, words: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(*(self.vocabulary.take(pa.array(words[:, i])) for i in range(words.shape[1])), pa.scalar(" ", pa.large_string()))


def _shards(batches, most: int):
    """Shards of Arrow batches of text and lang: texts of one language add up to about `most` bytes."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    for batch in W.steps(batches):
        langs = pc.fill_null(batch.column("lang"), "und")
        for lang in langs.unique().to_pylist():
            texts = batch.column("text").filter(pc.equal(langs, lang)).cast(pa.large_string())
            held.setdefault(lang, []).append(texts)
            size[lang] = size.get(lang, 0) + texts.nbytes
        while size and sum(size.values()) > most:  # the largest leaves first
            lang = max(size, key=size.get)
            del size[lang]
            yield Shard(pa.concat_arrays(held.pop(lang)), lang)
    for lang, texts in held.items():
        yield Shard(pa.concat_arrays(texts), lang)


def _frequent(shard: Shard, words: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return tables.in_bitmap(seen, shard.keys(words))


def _level(shard: Shard, size: int, frequent: list[np.ndarray]) -> Lists:
    """Lists of the phrases of `size` words whose parts are all frequent, and themselves, where `frequent` reaches as far."""
    postings = shard.postings()
    if frequent:
        postings = postings.where(_frequent(shard, postings.words, frequent[0]))
    lists = postings
    for k in range(2, size + 1):
        lists = shard.extended(lists, postings)
        if k > 2:  # the first words were extended because they are frequent
            lists = lists.where(_frequent(shard, lists.words[:, 1:], frequent[k - 2]))
        if len(frequent) >= k:
            lists = lists.where(_frequent(shard, lists.words, frequent[k - 1]))
    return lists


def _counted_by_key(texts: DataFrame, size: int, frequent: list[np.ndarray], least: int, shard_bytes: int) -> DataFrame:
    """key of the phrases of `size` words that may have `least` occurrences: those of each key together have."""

    def run(batches):
        for shard in _shards(batches, shard_bytes):
            lists = _level(shard, size, frequent)
            yield pa.RecordBatch.from_arrays([W.longs(shard.keys(lists.words)), pa.array(lists.length())], ["key", "f"])

    return texts.mapInArrow(run, "key bigint, f bigint").groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("key")


def _counted(texts: DataFrame, size: int, frequent: list[np.ndarray], least: int, shard_bytes: int) -> DataFrame:
    """lang, phrase, f and key of the phrases of `size` words with f >= least; for words, also a row of each
    language without a phrase, whose f counts all words."""

    def run(batches):
        for shard in _shards(batches, shard_bytes):
            lists = _level(shard, size, frequent)
            phrase, f, key = shard.phrases(lists.words), pa.array(lists.length()), W.longs(shard.keys(lists.words))
            yield pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(f), pa.string()), phrase.cast(pa.string()), f, key], ["lang", "phrase", "f", "key"])
            if size == 1:
                yield pa.RecordBatch.from_arrays([pa.array([shard.lang]), pa.array([None], pa.string()), pa.array([len(shard.word)]), pa.array([0])], ["lang", "phrase", "f", "key"])

    found = texts.mapInArrow(run, "lang string, phrase string, f bigint, key bigint")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.max("key").alias("key")).where((F.col("f") >= least) | F.col("phrase").isNull())


def _bitmap(keys: DataFrame) -> np.ndarray:
    bits = 1 << 16
    count = keys.count()
    while bits < min(BITS, 16 * count):
        bits *= 2
    return tables.bitmap(keys, "key", bits)


def frequencies(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> list[DataFrame]:
    """For 1 to `longest` words, the written lang, phrase and f of all phrases with at least `least` occurrences.

    The first also holds a row of each language whose phrase is null and whose f counts all words.
    A null text is empty, a null language `und`; repeated rows count again.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    out, frequent = [], []
    for size in range(1, longest + 1):
        if size > 1:
            keys = tables.written(_counted_by_key(texts, size, frequent, least, shard_bytes))
            frequent.append(_bitmap(keys))
            tables.drop(keys)
        out.append(tables.written(_counted(texts, size, frequent, least, shard_bytes)))
        if size == 1:
            frequent.append(_bitmap(out[0].where("phrase is not null")))
    return out


def first_of_each(df: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first `most` rows of each group, with their rank; the order is total but for equal rows.

    A window never takes a large group whole: hash pieces of it are ranked first, then what is left of 32 of them at a time.
    """
    pieces = -(-df.count() // RANKED)
    while pieces > 1:
        part = Window.partitionBy(group, "piece").orderBy(*order)
        df = df.withColumn("piece", F.pmod(F.xxhash64(*df.columns), F.lit(pieces))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most).drop("piece", "rank")
        pieces = pieces // 32
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, kept: int = KEPT, within: int = WITHIN, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Of each language the first `kept` phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n and score.

    a counts the phrase, l and r the parts of its lowest-scoring cut (ties: the earliest), n the words of the language; score is
    floor(1000000 a a / (l r)).  A phrase of which a longer candidate holds `within` percent is dropped.  Order: score and a
    falling, then phrase by bytes.  Products are decimals of 38 digits: exact for counts below 10^15.
    """
    levels = [df.select("lang", "phrase", "f") for df in frequencies(docs, longest, least, text_col, lang_col, shard_bytes)]
    totals = levels[0].where("phrase is null").select("lang", F.col("f").alias("n"))
    parts = levels[0].where("phrase is not null")
    found = parts.limit(0)
    for level in levels[1:]:
        found = found.unionByName(level)
    for level in levels[1:-1]:
        parts = parts.unionByName(level)
    words = F.split("phrase", " ")
    joined = lambda at, size: F.array_join(F.slice(words, at, size), " ")
    candidates = found.withColumn("size", F.size(words))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", F.col("f").alias("a"), "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("square", wide("a") * wide("a") * F.lit(1000000).cast("decimal(7,0)")).withColumn("product", wide("l") * wide("r"))
    scored = cuts.withColumn("score", F.expr("square div product")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where("size > 2").withColumn("size_in", F.explode(F.expr("sequence(2, size - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, size - size_in + 1)")))
    holders = inner.select("lang", joined(F.col("at"), F.col("size_in")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    stay = scored.join(holders, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * within)
    ready = tables.written(stay.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    ranked = first_of_each(ready, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], kept)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with d as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), p as (
  select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d
), w as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p
), g as (
  select lang, 1 as size, unnest(words) as phrase from w
  union all select lang, 2, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) from w
  union all select lang, 3, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) from w
), f as (
  select lang, size, phrase, count(*) as f from g group by all
), n as (
  select lang, sum(f)::bigint as n from f where size = 1 group by lang
), c as (
  select lang, size, phrase, f as a, string_split(phrase, ' ') as words from f where size > 1 and f >= 10
), cut as (
  select c.*, k, array_to_string(words[1:k], ' ') as left_part, array_to_string(words[k + 1:], ' ') as right_part from c, (values (1), (2)) as cuts(k) where k < size
), s as (
  select cut.lang, cut.phrase, cut.a, k, x.f as l, y.f as r, (1000000::hugeint * cut.a * cut.a) // (x.f::hugeint * y.f) as score
  from cut join f as x on x.lang = cut.lang and x.phrase = left_part join f as y on y.lang = cut.lang and y.phrase = right_part
), best as (
  select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1
), longer as (
  select lang, phrase, max(a) as longer from (
    select lang, array_to_string(words[1:2], ' ') as phrase, a from c where size = 3
    union all select lang, array_to_string(words[2:3], ' '), a from c where size = 3
  ) group by all
), stay as (
  select best.* from best left join longer using (lang, phrase) where 100 * coalesce(longer, 0) < 50 * a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from stay join n using (lang)
qualify rank <= 2000
"""
