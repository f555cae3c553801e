"""Collocations against brute force."""

import collections
import random
import re

import pytest

from quern.llm import phrases

SCHEMA = "doc_id int, text string, lang string, f int, key string, `rank` int, phrase string"
LOW = str.maketrans({c: c + 32 for c in range(65, 91)})


def brute(rows, longest=3, least=10, kept=2000, within=50):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inner = collections.Counter()
    for (lang, words), a in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner[lang, words[i : i + k]] = max(inner[lang, words[i : i + k]], a)
    out = []
    for (lang, words), a in found.items():
        if 100 * inner[lang, words] >= within * a:
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        out.append((lang, -score, -a, " ".join(words).encode(), l, r))
    ranks, rows = collections.Counter(), []
    for lang, score, a, phrase, l, r in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= kept:
            rows.append((lang, ranks[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return rows


def some_rows(n=400, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "in", "a", "new", "york", "times", "É", "naïve", "\x00", "\xa0x", "\U0001f600", "x-y", "zz"]
    weights = [1 / (i + 1) for i in range(len(words))]
    ends = ["", ".", ",", ";", ":", "!", "?", "\n", "\r\n", "\x0b", "\x0c", "..", " . "]
    rows = []
    for _ in range(n):
        text = " ".join(w + (rng.choice(ends) if rng.random() < 0.15 else "") for w in rng.choices(words, weights, k=rng.choice([1, 2, 3, 20, 60])))
        rows.append((text.replace(" ", rng.choice([" ", "  ", "\t"])), rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return [*rows, (None, "en"), ("", None), (" \t\n", "fr"), ("aa aa aa aa aa " * 10, "rep"), ("p" * 50_000 + " q", "en")]


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, t, lang, 1, "x", 2, "p") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, **more).collect())


@pytest.mark.parametrize("more", [{}, {"shard_bytes": 500}, {"least": 4, "kept": 7, "within": 80}, {"longest": 2}, {"longest": 5, "least": 5}])
def test_equals_brute_force(spark, more):
    rows = some_rows()
    want = brute(rows, **{k: v for k, v in more.items() if k != "shard_bytes"})
    assert len(want) > 20
    assert mined(spark, rows, **more) == sorted(want)


def test_full_bitmaps_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BITS", 64)  # every key is let through
    assert mined(spark, some_rows(150, 2)) == sorted(brute(some_rows(150, 2)))


def test_large_rankings_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANKED", 3)
    assert mined(spark, some_rows(), kept=5) == sorted(brute(some_rows(), kept=5))


def test_products_beyond_64_bits(spark):
    rows = [("a b " * 1500, "en")] * 4000
    want = [(lang, rank, phrase, a * 4000, l * 4000, r * 4000, n * 4000, score) for lang, rank, phrase, a, l, r, n, score in brute(rows[:1])]
    assert mined(spark, rows) == sorted(want) and 1_000_000 * want[0][3] ** 2 > 1 << 63


def test_lists_of_a_shard(spark):
    import pyarrow as pa

    shard = phrases.Shard(pa.array(["a b. b a b", "b"], pa.large_string()), "en")
    postings = shard.postings()
    spelt = shard.vocabulary.to_pylist()
    assert spelt == ["a", "b"] and postings.length().tolist() == [2, 4]
    pairs = shard.extended(postings, postings)
    assert {tuple(spelt[w] for w in row): n for row, n in zip(pairs.words, pairs.length())} == {("a", "b"): 2, ("b", "a"): 1}
