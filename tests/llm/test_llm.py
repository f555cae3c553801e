"""The operators for training data against brute force, and their edge cases."""

import base64
import bz2
import collections
import gzip
import hashlib
import lzma
import math
import random
import re
import time
import urllib.parse
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard

from quern.llm import _words, chat, decontaminate, jaccard, language_model, license_scan, mixing, pii, quality, queries, rules, secrets

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({c: c + 32 for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, hits string, size int, words string"


def docs_of(spark, texts, start=0):
    """documents with odd columns that operators must not trip over."""
    rows = [(i, t, None, None if i % 5 == 0 else f"s{i % 3}", None, 1, "x", 3, "y") for i, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, DOCS)


def some_texts(n=60, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["The", "É", "naïve", "x|y", "A1b2"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 9, 10, 30, 80]))) for _ in range(n)]
    texts += [None, "", " \t\n\r\x0b\x0c", texts[0], texts[0], "\x85\xa0 odd spaces", "long " * 5000]
    return texts


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# words


def test_words_equal_regular_expressions():
    texts = some_texts() + ["x" * 300_000 + " y", "a\x00b", "ÀB-c"]
    for table, pattern in ((_words.SPACED, SPACED), (_words.ALNUM, ALNUM)):
        got = _words.words(pa.array(texts, pa.string()), table)
        seen: dict[int, bytes] = {}
        for i, t in enumerate(texts):
            want = [w.encode() for w in pattern.findall((t or "").translate(LOW))]
            span = range(got.first[i], got.first[i + 1])
            assert [got.data[got.start[k] : got.end[k]].tobytes() for k in span] == want
            for k, w in zip(span, want):
                assert seen.setdefault(int(got.hash[k]), w) == w
        assert len(seen) == len(set(seen.values()))


def test_steps_cut_and_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 1_500_000, "b", None, "c" * 3_000_000, "d"]), pa.array(range(5))], ["text", "k"])
    assert [k for b in _words.steps([batch, batch.slice(0, 0)]) for k in b.column("k").to_pylist()] == list(range(5))


# 1


def test_secret_base_equals_plain_scan(spark):
    texts = ['Token: "abcdefghijkl"', "password: token: abcdefghijklmnop", "AKIA" + "A" * 13 + " AKIA" + "B" * 14, "0" * 15 + "g" + "f" * 16, "api_key=x secret='abcdefghijkl", "K" * 3 + "toKen=abcdefghijklmn", "é" * 5 + " passwd  =  abcdefghijkl", None, ""]
    kinds = [("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]
    got = {r["doc_id"]: r for r in secrets.secret_spans(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(t or "") if ok(m))
        spans = [f"{n}:{a}:{b}" for a, _, n, b in want]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[i][f"n_{n}"] for n, *_ in kinds] == [sum(w[2] == n for w in want) for n, *_ in kinds]
        assert set(spans) <= set(got[i]["spans"].split(",")) | {""}


@pytest.mark.parametrize("depth", range(6))
def test_nested_secrets_are_found_in_place(depth):
    secret = 'password = "abcDEF123456xyz"'
    wraps = [
        lambda s: "".join(f"%{b:02X}" for b in s.encode()),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.urlsafe_b64encode(zlib.compress(s.encode())).decode().rstrip("="),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: s.replace("=", "&#61;").replace('"', "&quot;"),
    ]
    rng = random.Random(depth)
    for _ in range(8):
        inner, names = secret, rng.sample(range(len(wraps) - 1), min(depth, 3))
        for n in names:
            inner = wraps[n](inner)
        text = f"héllo {inner} end"
        hits = [f for f in secrets.find(text) if f[0] == "assign" and f[5].startswith("password")]
        assert hits, (names, text)
        start, end = hits[0][1:3]
        assert 6 <= start < end <= len(text) - 4
    assert secrets.find(f"x {wraps[5](secret)} y")[0][:3] == ("assign", 2, 2 + len(wraps[5](secret)) - len("&quot;"))


SECRET = 'password = "abcDEF123456xyz"'


@pytest.mark.parametrize("odd", ["\0", "\x1b", " ", "​", "　", "﻿"])
@pytest.mark.parametrize("code", ["utf-8", "utf-16", "utf-16-le", "utf-16-be"])
def test_secrets_in_layers_with_odd_characters(odd, code):
    raw = f"{odd} some text {SECRET} more".encode(code)
    for run in (base64.b64encode(raw).decode(), base64.b64encode(gzip.compress(raw)).decode(), "".join(f"%{b:02x}" for b in raw), "".join(f"\\x{b:02x}" for b in raw)):
        assert any(k == "assign" and 6 <= a < b <= 6 + len(run) for k, a, b, *_ in secrets.find(f"héllo {run} end")), run
    assert secrets.find(f"x {base64.b64encode('é '.encode('latin-1') + SECRET.encode()).decode()} y")


@pytest.mark.parametrize("line_break", ["\n", "\r\n"])
@pytest.mark.parametrize("width", [64, 76])
def test_secrets_in_wrapped_base64(width, line_break):
    rng = random.Random(width)
    for before in range(0, 60, 3):
        for pack in (bytes, gzip.compress):
            noise = "".join(rng.choice("ghijklmnop ") for _ in range(200))
            raw = pack((noise[:before] + SECRET + noise).encode())
            run = base64.b64encode(raw).decode()
            run = line_break.join(run[i : i + width] for i in range(0, len(run), width))
            got = [f for f in secrets.find(f"héllo {run}\nend") if f[0] == "assign" and f[5] == SECRET[:-1]]
            assert got and 6 <= got[0][1] < got[0][2] <= 7 + len(run), run


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_secrets_in_compressed_bytes_of_escape_runs(pack):
    raw = pack(random.Random(1).randbytes(100).hex(" ").encode() + SECRET.encode())
    for run in ("".join(f"%{b:02X}" for b in raw), urllib.parse.quote(raw), urllib.parse.quote_plus(raw), "".join(f"\\x{b:02x}" for b in raw), repr(raw)[2:-1], "".join(f"&#{b};" for b in raw)):
        got = [f for f in secrets.find(f"é {run}\nend") if f[0] == "assign"]
        assert got and got[0][1:3] == (2, 2 + len(run)), (run, got)


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_secrets_anywhere_in_long_and_many_streams(pack, monkeypatch):
    long = base64.b64encode(pack(("é filler" * 2_000_000 + SECRET + "z " * 9_000_000).encode())).decode()
    assert [f[5] for f in secrets.find(long) if f[0] == "assign"] == [SECRET[:-1]]
    two = base64.b64encode(pack(b"nothing here") + pack(SECRET.encode())).decode()
    if pack is not zlib.compress:
        assert [f[1:3] for f in secrets.find(f"x {two} y") if f[0] == "assign"] == [(2, 2 + len(two.rstrip("=")))]
    monkeypatch.setattr(secrets, "PIECE", 1000)
    monkeypatch.setattr(secrets, "OVERLAP", 200)
    inner = base64.b64encode(SECRET.encode()).decode()
    for before in range(940, 1240, 7):
        for secret in (SECRET, inner):
            raw = pack(("." * before + " " + secret + " " + "." * 3000).encode())
            for run in (raw, pack(raw)):
                assert [f[5] for f in secrets.find(base64.b64encode(run).decode()) if f[0] == "assign"] == [SECRET[:-1]], before


def test_secret_worklist_ends_on_cycles_and_bombs():
    bomb = base64.b64encode(gzip.compress(b"a " * 20_000_000)).decode()
    assert secrets.find("%25" * 50 + " " + bomb) is not None
    assert secrets.find("%41" * 3) == []


def test_every_copy_of_an_encoded_secret_is_found_and_redacted():
    """Copies, glued to words on either side, nested and packed: as many spans as copies, each around its own copy, and none left."""
    run = base64.b64encode(SECRET.encode()).decode().rstrip("=")
    packed = base64.b64encode(gzip.compress(SECRET.encode())).decode().rstrip("=")
    quoted = "".join(f"%{b:02X}" for b in SECRET.encode())
    twice = base64.b64encode(quoted.encode()).decode().rstrip("=")
    for one in (run, packed, quoted, twice):
        for glue in ("x {} B {} z", "key-{} id_{}", "a/{} bb+{}", "ab{} abc{}", "{}, {}\n{}"):
            n = glue.count("{}")
            text = glue.format(*[one] * n)
            found = [f for f in secrets.find(text) if f[0] == "assign"]
            spans = sorted({f[1:3] for f in found if f[5] == SECRET[:-1]})
            begins = [m.start() for m in re.finditer(re.escape(one), text)]
            assert len(begins) == n and all(any(a < b0 + len(one) and b > b0 for a, b in spans) for b0 in begins), (one, glue, spans)
            assert not secrets.find(secrets.redact(text, secrets.find(text))), (one, glue)


def test_escape_chains_of_any_depth_take_one_pass():
    for chain in ("%" + "25" * 300_000, "\\u0025" + "25" * 100_000, "&amp;" + "amp;" * 50_000, "%5Cu0025" + "5Cu0025" * 40_000):
        begin = time.perf_counter()
        assert all(f[0] == "hex" for f in secrets.find(chain))
        assert time.perf_counter() - begin < 20
    for wrap in (lambda s: s.replace("%", "%25"), lambda s: s.replace("%", "\\u0025"), lambda s: s.replace("%", "&#37;")):
        inner = "".join(f"%{b:02X}" for b in SECRET.encode())
        for depth in range(12):
            got = [f for f in secrets.find(f"é {inner} end") if f[0] == "assign"]
            assert got and got[0][1] == 2 and got[0][2] <= 2 + len(inner), depth
            inner = wrap(inner) if depth < 7 else "".join(f"%{b:02X}" for b in inner.encode()) if len(inner) < 30_000 else inner


def test_a_stream_that_unpacks_to_itself_ends(monkeypatch):
    def same(chunks, used=None):
        raw = b"".join(map(bytes, chunks))
        if secrets.codec(raw) != "gzip":
            return
        if used is not None:
            used[:] = [len(raw), len(raw)]
        yield raw

    monkeypatch.setattr(secrets, "unpack", same)
    assert secrets.find("x " + base64.b64encode(gzip.compress(SECRET.encode())).decode()) == []


def test_secrets_in_a_long_text_of_many_runs():
    run = base64.b64encode(b"nothing to see here " * 3).decode()
    text = " ".join(f"{run} w{i}" for i in range(20_000)) + " " + base64.b64encode(SECRET.encode()).decode()
    begin = time.perf_counter()
    assert [f[5] for f in secrets.find(text)] == [SECRET[:-1]] and time.perf_counter() - begin < 60


def test_redaction_keeps_rows_and_other_columns(spark):
    t = "key token=abcdefghijklmno and AKIA" + "Z" * 16
    got = secrets.redact_secrets(docs_of(spark, [t, None, "", "clean"])).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["key [assign] and [access]", None, "", "clean"]
    assert [r["n_chars"] for r in got] == [25, None, 0, 5] and got[0]["words"] == "y"


# 2


def water_level(sizes, weights, share=1.5, most=2.0):
    out, left, want = {}, dict(weights), share * sum(sizes.values())
    while left:
        total = sum(left.values())
        part = {s: want * w / total for s, w in left.items()}
        over = [s for s in left if part[s] > most * sizes[s]]
        if not over:
            return out | part
        for s in over:
            out[s] = most * sizes[s]
            want -= out[s]
            del left[s]
    return out


def test_mix_targets_and_taken(spark):
    texts = some_texts(300, 4)
    docs = docs_of(spark, texts)
    got = mixing.mix_counts(docs).collect()
    again = mixing.mix_counts(docs.repartition(7)).collect()
    assert sorted(got) == sorted(again) and len(got) == len(texts)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = collections.Counter()
    for r in got:
        assert r["size"] == len(SPACED.findall(texts[r["doc_id"]] or ""))
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[source[r["doc_id"]]] += r["size"]
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = water_level(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    for s in names:
        rows = [r for r in got if source[r["doc_id"]] == s]
        assert {r["source_size"] for r in rows} == {sizes[s]}
        assert rows[0]["target"] == pytest.approx(want[s])
        assert sum(r["taken"] for r in rows) == pytest.approx(want[s], rel=0.05, abs=2 * mixing.BLOCK)


def test_taken_follows_from_slots(spark):
    docs = docs_of(spark, some_texts(80, 5))
    placed, fragments, slots = mixing.mix_sources(docs)
    uses = collections.Counter((r["rank"], r["block"]) for r in slots.collect())
    want = collections.Counter()
    for r in placed.where("size > 0").collect():
        for k in range(r["begin"], r["begin"] + r["size"]):
            want[r["doc_id"]] += uses[r["rank"], k // mixing.BLOCK]
    got = {r["doc_id"]: r["taken"] for r in mixing.mix_counts(docs).collect()}
    assert got == {i: want[i] for i in got}


def test_mixed_corpus_is_the_words_that_slots_take(spark):
    texts = some_texts(80, 5)
    docs = docs_of(spark, texts)
    rows = mixing.mixed_corpus(docs).collect()
    _, _, slots = mixing.mix_sources(docs)
    got = collections.Counter()
    for r in rows:
        got[r["doc_id"]] += r["words"]
        assert (r["text"] is None) == (r["shard"] is None) == (r["words"] == 0)
        assert r["text"] is None or f" {r['text']} " in f" {' '.join(SPACED.findall(texts[r['doc_id']]))} "
    assert got == {r["doc_id"]: r["taken"] for r in mixing.mix_counts(docs).collect()} and len(got) == len(texts)
    held = collections.Counter()
    for r in rows:
        if r["shard"] is not None:
            held[r["shard"], r["source"], r["slot"]] += r["words"]
    assert len(held) == slots.count() and max(held.values()) == mixing.BLOCK
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mixed_corpus(docs.repartition(5)).collect()), key=repr)


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 64, 1000):
        p = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64))
        assert sorted(p.tolist()) == list(range(n))


def test_mix_of_nothing(spark):
    assert mixing.mix_counts(docs_of(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix_counts(docs_of(spark, [None, "", " "])).collect()] == [0, 0, 0]


# 3


def test_language_model_counts_and_base(spark):
    texts = some_texts(120, 6)
    got = {r["doc_id"]: r for r in language_model.score_documents(docs_of(spark, texts)).collect()}
    tokens = {i: SPACED.findall((t or "").translate(LOW)) + ["\n"] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, types = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ws))
        assert r["score"] < 0


def test_language_model_scores_equal_a_plain_model(spark, monkeypatch):
    """Counts in dictionaries, the same histogram and weights: each score to the last digits, over many batches and ranges."""
    monkeypatch.setattr(language_model, "RANGE_KEYS", 40)
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["a", "B", "c", "dd", "é"]) for _ in range(rng.randrange(0, 40))) for _ in range(150)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(9, "doc_id")
    got = {r["doc_id"]: r for r in language_model.score_documents(docs).collect()}
    tokens = [[*SPACED.findall((t or "").translate(LOW)), "\n"] for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    one = collections.Counter(w for i in train for w in tokens[i])
    two = collections.Counter(p for i in train for p in zip(["\n", *tokens[i]], tokens[i]))
    total, types = sum(one.values()), len(one)
    places = collections.Counter()
    for i in train:
        for v, w in zip(["\n", *tokens[i]], tokens[i]):
            p2 = np.array([(two[v, w] - 1) / (one[v] - 1) if one[v] > 1 else 0.0])
            p1 = np.array([(one[w] - 1) / (total - 1)])
            places[int(((language_model.bucket(np.array([one[v] - 1])) * 4096 + language_model._place(p2)) * 4096 + language_model._place(p1))[0])] += 1
    at = sorted(places)
    weights = language_model.learn_weights(np.array(at), np.array([float(places[x]) for x in at]), types)
    for i, own in enumerate(tokens):
        want = 0.0
        for v, w in zip(["\n", *own], own):
            a = weights[language_model.bucket(np.array([one[v]]))[0]]
            want += math.log10(a[0] * two[v, w] / max(one[v], 1) + a[1] * one[w] / total + a[2] / (types + 1))
        assert got[i]["score"] == pytest.approx(want, rel=1e-9)


def test_language_model_probabilities_sum_to_one_and_beat_base(spark):
    """Over all words after one context, and an unknown one, chances sum to 1."""
    rng = random.Random(2)
    follow = {w: rng.sample("abcdefghij", 2) for w in "abcdefghij"}
    texts = []
    for _ in range(200):
        w, out = "a", []
        for _ in range(30):
            out.append(w)
            w = rng.choice(follow[w])
        texts.append(" ".join(out))
    got = [r for r in language_model.score_documents(docs_of(spark, texts)).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) * 0.6
    one = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9000 + i, f"a {w}") for i, w in enumerate([*"abcdefghij", "zzz"])] + [(8000, "a")], "doc_id bigint, text string")
    s = {r["doc_id"]: r["score"] for r in language_model.score_documents(one, "doc_id >= 8000").collect()}
    # P(w | a) = P("a w" up to w) / P("a"): compare through texts whose end chance is shared is not possible, so check order only
    seen = {w for t in texts for a, w in zip(t.split(), t.split()[1:]) if a == "a"}
    likely = [s[9000 + i] for i, w in enumerate("abcdefghij") if w in seen]
    assert min(likely) > s[9010]


def test_weights_of_em_are_distributions():
    place = np.array([(1 * 4096 + 2) * 4096 + 9, (1 * 4096 + 4095) * 4096 + 20, (0 * 4096 + 4095) * 4096 + 12])
    w = language_model.learn_weights(place, np.array([5.0, 3.0, 2.0]), 100)
    assert w.shape == (language_model.BUCKETS, 3) and np.allclose(w.sum(1), 1) and w[0, 0] == 0


def test_packing_round_trips():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), np.array([0], np.uint64), np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))):
        assert (language_model.unpack(language_model.pack(values)) == values).all()
        assert (language_model.unpack_sorted(language_model.pack_sorted(values)) == values).all()


def test_language_model_without_training_rows(spark):
    assert language_model.score_documents(docs_of(spark, [])).collect() == []
    r = language_model.score_documents(docs_of(spark, ["a b"]), "true").first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


# 4


def brute_contamination(texts, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(i)
    out = {}
    for i, t in texts:
        w, hit, found = ALNUM.findall((t or "").translate(LOW)), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if k := windows.get(tuple(w[j : j + n])):
                    found |= k
                    hit |= set(range(j, j + n))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def test_mix_of_many_sources(spark, monkeypatch):
    """Drawn in groups, neither table broadcast: targets, bounds and reruns hold."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    monkeypatch.setattr(mixing, "DRAWN", 4)
    monkeypatch.setattr(mixing, "PIECE_ROWS", 1)
    rng = random.Random(11)
    rows = [(i, "w " * rng.randrange(0, 400), f"s{min(rng.randrange(60), 40):02d}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_counts(docs).collect()
    assert sorted(got) == sorted(mixing.mix_counts(docs.repartition(5)).collect()) and len(got) == 600
    source = {i: s for i, _, s in rows}
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    want = water_level(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))})
    assert all(taken[s] == pytest.approx(want[s], rel=0.15, abs=3 * mixing.BLOCK) for s in sizes)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_contamination_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    words = [f"q{i}" for i in range(12)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 7, 9, 10, 11, 14, 30]))) for i in range(40)] + [(40, None), (41, " - "), (42, "Same Same"), (43, "same same")]
    texts = []
    for i in range(80):
        cut = (rng.choice(items)[1] or "").split()
        a = rng.randrange(len(cut) + 1)
        texts.append((i, f"{say(rng.randrange(12))}, {' '.join(cut[a : a + rng.choice([8, 9, 10, 12])]).upper()} {say(rng.randrange(12))}"))
    texts += [(100, None), (101, ""), (102, say(3000)), (103, "same, SAME same")]
    docs = spark.createDataFrame([(i, t, 1, "h") for i, t in texts], "doc_id bigint, text string, row int, hits string")
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    want = brute_contamination(texts, items)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want


def test_contamination_edges(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id bigint, text string")
    hit = "x one two three four five six seven eight nine ten y"
    docs = docs_of(spark, [hit, "clean text", None]).union(docs_of(spark, [hit]))
    got = sorted((r["doc_id"], r["n_hit"]) for r in decontaminate.contamination(docs, bench).collect())
    assert got == [(0, 10), (0, 10), (1, 0), (2, 0)]
    kept = decontaminate.clean_documents(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2] and kept.columns[0] == "doc_id" and set(kept.columns) == set(docs.columns)
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0


# 5


def test_chat_round_trips_anything():
    rng = random.Random(1)
    pieces = ["\\", "### ", "</turn>", " ", "\n", "a", "Assistant: ", ":", "#", "<", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))
        role = rng.choice(["user", "assistant", "User", "", "=x", "a: b\n", "é", "### "])
        rendered, _ = chat.render(role, text)
        assert [t[:2] for t in chat.parse(rendered)] == [(role, text)]
    whole = "".join(chat.render("user", t)[0] for t in ("a", "### x: </turn>\n", "\\"))
    assert [t[1] for t in chat.parse(whole)] == ["a", "### x: </turn>\n", "\\"]
    assert chat.parse("### User: no end") is None and chat.parse("junk") is None


def test_chat_query_equals_sql(spark):
    c = duckdb.connect()
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### a</turn>\\"), (1, 1, "assistant", None), (2, 0, None, None), (2, 0, "we ird", "x\\"), (2, 0, "user", "b"), (2, 0, "user", "### a"), (2, 0, "system", "x"), (3, None, "user", "é"), (3, 0, "tool", "y")] + [(4, i % 7, "assistant", "t" * (i % 5)) for i in range(200)]
    t = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    conversations = t.toPandas()  # noqa: F841  read by name below
    got = chat.query(t).toPandas().sort_values("conv_id").reset_index(drop=True)
    want = c.sql(chat.ORACLE).df().sort_values("conv_id").reset_index(drop=True)
    assert got.astype(str).values.tolist() == want[got.columns].astype(str).values.tolist()
    assert got[got.conv_id == -7].loss_chars.item() == len(chat.FIXED[1])
    assert got[got.conv_id == 2].n_turns.item() == 5


# 6


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = SPACED.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize(("block", "size"), [(20_000, 1 << 26), (7, 1 << 26), (20_000, 600)])
def test_jaccard_classes_equal_brute_force(spark, monkeypatch, block, size):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", size)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = base[: rng.choice([1, 2, 3, 5, 11, 12, 13, 20, 21, 22, 30, 40])]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w = w[:-1] if rng.random() < 0.5 and len(w) > 1 else [*w, rng.choice(base)]
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "  ")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, node int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked_classes(docs).collect()}
    assert got == brute_links(rows)


def test_near_copies_of_five_words_at_four_fifths(spark):
    rng, texts = random.Random(3), []
    for k in range(60):
        words = [f"k{k}w{i}" for i in range(rng.choice([4, 5, 30, 120, 400]))]
        texts.append(" ".join(words))
        for edits in range(1, 6):
            for at in rng.sample(range(len(words)), min(edits, len(words))):
                words[at] = f"e{rng.random()}"
            texts.append(" ".join(words))
    texts += ["", None, texts[0].upper(), "a b", "A b"]
    grams = [[tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else [] for w in ((t or "").translate(LOW).split() for t in texts)]
    sets, first = [set(g) for g in grams], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((first[a], first[b]))
                first = [low if x == high else x for x in first]
    kept = {i for i, x in enumerate(first) if i == x}
    assert 60 < len(kept) < len(texts) - 60
    assert {r["doc_id"] for r in jaccard.first_of_each(docs_of(spark, texts), 5, 80, 100).collect()} == kept
    assert {r["doc_id"] for r in jaccard.first_of_each(docs_of(spark, texts)).collect()} != kept


def test_jaccard_tiles_miss_no_pair_at_the_threshold():
    """Any two sets that link share a digest or a tile, for many sizes."""
    rng = np.random.default_rng(4)
    for n in [9, 10, 18, 19, 20, 37, 58, 100, 333]:
        for _ in range(20):
            a = rng.integers(1, 1 << 63, n + n // 9 + 2, dtype=np.uint64)
            for m in range(n, n + n // 9 + 1):
                drop = next(d for d in range(n, -1, -1) if 190 * (n - d) >= 90 * (n + m - d - (0 if True else 0)) - 0 and 100 * (n - d) >= 90 * (m + d)) if 100 * n >= 90 * m else None
                if drop is None:
                    continue
                x, y = np.sort(a[:n]), np.sort(np.concatenate([a[drop:n], a[n : n + m - (n - drop)]])) if n + m - (n - drop) <= len(a) else np.sort(a[: min(m, len(a))])
                if 100 * len(np.intersect1d(x, y)) < 90 * len(np.union1d(x, y)):
                    continue
                both = np.concatenate([x, y])
                first = np.array([0, len(x), len(both)])
                keys, begin = jaccard._tiles(both, first)
                shared = set(keys[: begin[1]].tolist()) & set(keys[begin[1] :].tolist())
                assert shared or set(x.tolist()) == set(y.tolist()), (n, m, drop)


def test_jaccard_combined_tiles_connect_the_same_sets():
    """Sets that share a tile stay connected over the combined ones, and sets that share none stay apart."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 12))
        each = [rng.choice(15, int(rng.integers(0, 5)), replace=False).astype(np.uint64) for _ in range(n)]
        begin = np.concatenate([[0], np.cumsum([len(k) for k in each])])
        keys, at = jaccard._combined(np.concatenate(each), begin, np.arange(100, 100 + n, dtype=np.uint64))
        after = [keys[a:b] for a, b in zip(at[:-1], at[1:])]

        def parts(tiles):
            group = list(range(n))
            for _ in range(n):
                for i in range(n):
                    for j in range(n):
                        if set(tiles[i].tolist()) & set(tiles[j].tolist()):
                            group[i] = group[j] = min(group[i], group[j])
            return group

        assert parts(each) == parts(after)
        kept = [k for tiles in after for k in tiles.tolist() if k < 15]
        assert len(kept) == len(set(kept)) and set(kept) == {k for tiles in each for k in tiles.tolist()}


def test_jaccard_hot_copies_and_empty(spark):
    near = [" ".join(f"t{k}" for k in range(80) if k != i % 40 + 20) if i % 2 else " ".join(f"t{k}" for k in range(80)) for i in range(400)]
    got = jaccard.linked_classes(docs_of(spark, near, 10)).collect()
    want = brute_links(list(enumerate(near, 10)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert jaccard.linked_classes(docs_of(spark, [])).count() == 0
    kept = jaccard.first_of_each(docs_of(spark, ["a b c d", "A b c d", None, None, "other words here now"]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4] and "words" in kept.columns


# 7


def luhn(x):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) if int(c) < 5 else 2 * int(c) - 9) for i, c in enumerate(x[::-1])) % 10 == 0


def plain_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
        ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 10 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, n, m.end()) for k, (n, p, ok) in enumerate(kinds) for m in p.finditer(t) if ok(m[0]))


def test_pii_base_equals_plain_scan(spark, documents):
    odd = ["a@b.com_x@y.com..z@q.org 1.2.3.4.5.6.7.8 999.1.1.1 00001.2.3.4 é +49 (170) 123-4567 4111 1111 1111 1111 1-2-3 " + "1 " * 5000 + "x@" + "a." * 4000 + "b", None, "", "9" * 30000, "x" * 50000 + "@y.z"]
    texts = odd + [r["text"] for r in documents.collect()]
    docs = docs_of(spark, texts)
    got = pii.query(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = [f"{n}:{a}:{b}" for a, _, n, b in plain_pii(texts[r["doc_id"]] or "")]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) | {""}
        assert r["n_email"] == sum(w.startswith("email") for w in want)


def planted_pii(spark, n=160):
    """Documents of a corpus, and texts with personal data that no base rule sees, or with what only looks like it: (text, kind, start, end) or (text, None)."""
    rng = random.Random(8)
    some = ["over", "there", "call", "then", "lies", "nothing", "here", "ask"]
    say = lambda: " ".join(rng.choice(some) for _ in range(rng.randrange(3, 9)))
    digits = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    out = []
    for i in range(n):
        card = digits(15)
        card += next(c for c in "0123456789" if luhn(card + c))
        wrong = card[:-1] + str((int(card[-1]) + 1 + i % 9) % 10)
        fours = lambda c, by: by.join(c[k : k + 4] for k in range(0, 16, 4))
        right = [
            ("email", f"jane{i}{rng.choice([' [at] ', '(at)'])}example{rng.choice([' [dot] ', '.'])}org"),
            ("phone", f"({digits(3)}) {digits(3)}-{digits(4)}"),
            ("card", fours(card, rng.choice([".", "  "]))),
            ("ip", f"{rng.randrange(1, 250)}[.]{rng.randrange(250)}[.]{rng.randrange(250)}[.]{rng.randrange(250)}"),
        ]
        fake = [f"{digits(11)}", fours(wrong, "."), f"2{digits(3)}[.]{digits(2)}[.]{digits(2)}[.]{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)} {digits(2)}"]
        for kind, span in (*right, *((None, f) for f in fake)):
            begin = say()
            out.append((f"{begin} {span} {say()}", kind, len(begin) + 1, len(begin) + 1 + len(span)))
    return out


def test_pii_trees_add_spans_that_the_base_rules_miss(spark):
    planted = planted_pii(spark)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1 - i, p[0]) for i, p in enumerate(planted)], "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).where("doc_id < 0").collect()}
    hit, said, right = collections.Counter(), collections.Counter(), 0
    for i, (_, kind, start, end) in enumerate(planted):
        r = got[-1 - i]
        assert not r["base"] or kind is None
        added = [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"] if s not in r["base"]]
        hit[kind] += any(k == kind and a <= start and b >= end for k, a, b in added)
        said[kind] += bool(added)
    kinds = pii.KINDS
    recall = {k: hit[k] / sum(p[1] == k for p in planted) for k in kinds}
    precision = sum(hit[k] for k in kinds) / max(1, sum(said.values()))
    assert all(recall[k] >= 0.9 for k in kinds), recall
    assert precision >= 0.95, (precision, said)


def unseen_pii(n=80):
    """Forms that no training form has, and look-alikes of them: (text, kind or None, start, end)."""
    rng = random.Random(11)
    some = ["over", "there", "then", "lies", "nothing", "here", "ask"]
    say = lambda: " ".join(rng.choice(some) for _ in range(rng.randrange(3, 9)))
    digits = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    parts = lambda: [str(rng.randrange(1, 250)) for _ in range(4)]
    out = []
    for i in range(n):
        card = digits(15)
        card += next(c for c in "0123456789" if luhn(card + c))
        wrong = card[:-1] + str((int(card[-1]) + 1 + i % 9) % 10)
        odd = lambda c: "  ".join((c[:6], c[6:10], c[10:]))
        right = [
            ("email", f"jane{i} AT example DOT com"),
            ("email", f"jane{i} {{at}} mail {{dot}} example {{dot}} org"),
            ("email", f"j.doe{i} <at> example <dot> net"),
            ("email", f"jane{i}@mail{{dot}}example{{dot}}com"),
            ("ip", "{.}".join(parts())),
            ("ip", " <dot> ".join(parts())),
            ("phone", f"0044 {digits(2)} {digits(4)} {digits(4)}"),
            ("phone", f"({digits(3)}) {digits(3)} {digits(2)} {digits(2)}"),
            ("card", odd(card)),
        ]
        fake = [
            f"population {rng.randrange(1, 9)} {digits(3)} {digits(3)} {digits(3)}",
            odd(wrong),
            "{.}".join(["3" + digits(2), *parts()[1:]]),
            f"{rng.choice(some)} at docs.example.org",
            f"serial {digits(13)}",
        ]
        for kind, span in (*right, *((None, f) for f in fake)):
            begin = say()
            out.append((f"{begin} {span} {say()}", kind, len(begin) + 1, len(begin) + 1 + len(span)))
    return out


def test_pii_of_forms_that_training_never_saw(spark):
    planted = unseen_pii()
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1 - i, p[0]) for i, p in enumerate(planted)], "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).where("doc_id < 0").collect()}
    hit, said = collections.Counter(), 0
    for i, (_, kind, start, end) in enumerate(planted):
        added = [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in got[-1 - i]["spans"]]
        hit[kind] += any(k == kind and a <= start and b >= end for k, a, b in added)
        said += bool(added)
    recall = {k: hit[k] / sum(p[1] == k for p in planted) for k in pii.KINDS}
    precision = sum(hit[k] for k in pii.KINDS) / max(1, said)
    assert all(r >= 0.8 for r in recall.values()), (recall, precision)
    assert precision >= 0.9, (recall, precision)


def test_pii_learns_contexts_from_all_rows(spark):
    texts = ["reach bo on +49 170 1234567 whenever or rather write to a@b.org"] * 30 + ["serial number 12345678901 and part number 98765432109"] * 30
    found = pii.proposals(docs_of(spark, texts))
    known = pii.contexts(found)
    phone, mail = pii.KINDS.index("phone"), pii.KINDS.index("email")
    assert known[phone, "on"] > 1 > 0 > known[phone, "number"]
    assert known[mail, "write"] > 1 > 0 > known[mail, "on"]
    assert pii.contexts(pii.proposals(docs_of(spark, ["nothing", None]))) == {}


def test_pii_of_texts_with_very_many_matches(spark):
    many = " ".join(f"a{i}@b{i}.org 1.2.3.{i % 256} +49 (170) 123-{i:05d}" for i in range(20_000))
    loose = " ".join(f"b{i} [at] c [dot] org 170 123 {i:05d}" for i in range(20_000))
    docs = docs_of(spark, [many, loose])
    begin = time.perf_counter()
    got = {r["doc_id"]: r for r in pii.query(docs).collect()}
    assert time.perf_counter() - begin < 90
    want = [f"{n}:{a}:{b}" for a, _, n, b in plain_pii(many)]
    assert got[0]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest() and len(want) == 60_000
    assert (got[0]["n_email"], got[1]["n_email"]) == (20_000, 0)


def test_pii_without_proposals(spark):
    assert [tuple(r)[1:5] for r in pii.query(docs_of(spark, ["nothing", None])).collect()] == [(0, 0, 0, 0)] * 2
    assert pii.query(docs_of(spark, [])).collect() == []


# 8


def plain_statistics(t):
    w = SPACED.findall(t)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics_and_verdicts(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = [None, "", "a b", "a b c a b c", "x\nx\n\nx y\n", "# " * 60, "w " * 20000]
    texts = odd + [r["text"] for r in documents.collect()]
    docs = docs_of(spark, texts, -len(odd))
    got = {r["doc_id"]: r for r in rules.query(docs, labels).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts, -len(odd)):
        r, want = got[i], plain_statistics(t or "")
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    none = rules.query(docs, labels.where("false")).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in none)


def test_rules_find_a_planted_threshold(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(k) + ("#" if i % 4 == 0 else "") for k in range(60)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)] + [(None, 0, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    got = rules.query(docs_of(spark, texts), labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in got)


def test_rules_tell_held_out_rows(spark):
    """Rules learnt from four fifths of the labels, on documents of the last fifth; those that base rules fail count as rejected."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = quality.remainder() == 0
    rows = rules.rule_verdicts(docs, labels.where(~held)).join(labels.where(held), "doc_id").select("kept", "quality").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert len(bad) > 80 and sum(good) / len(good) > 0.95 and 1 - sum(bad) / len(bad) > 0.8, (sum(good), len(good), sum(bad), len(bad))


# 9


def test_license_places_and_labels(spark):
    texts = [
        "Released under the MIT License.",
        "mit-license (Apache License) general public LICENSE mit license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: x",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "a drivers license for the public, conditions met",
        None,
        "",
        "word " * 3000,
    ]
    got = {r["doc_id"]: r for r in license_scan.query(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = ALNUM.findall((t or "").translate(LOW))
        places = [(k, b) for p, b in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({b for _, b in places})))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
    assert got[2]["labels"] == "bsd" and got[3]["labels"] == "mit" and got[3]["base_labels"] == "" and got[4]["labels"] == ""
    assert license_scan.query(docs_of(spark, [])).count() == 0


def test_license_passages_side_by_side_and_in_long_text(spark):
    passage = {label: max(passages, key=len) for label, (_, passages) in license_scan.TEMPLATES.items()}
    sets = [("mit", "apache"), ("mit", "bsd", "isc"), ("apache", "bsd", "gpl", "isc", "mit", "mpl")]
    texts = [" and then ".join(passage[label] for label in own) for own in sets]
    # one passage in a long text that holds the words of all the others, but not their order
    strewn = sorted({w for label, p in passage.items() if label != "isc" for w in p.split()})
    random.Random(4).shuffle(strewn)
    texts.append(" filler ".join(strewn * 20) + " " + passage["isc"] + " " + "word " * 20_000)
    got = {r["doc_id"]: r for r in license_scan.query(docs_of(spark, texts + [f"plain text {i}" for i in range(200)])).collect()}
    for i, own in enumerate([*sets, ("isc",)]):
        assert set(own) <= set(got[i]["labels"].split(",")), (i, got[i]["labels"])
        assert got[i]["base_labels"] != "" or got[i]["score"] > 0.99
    assert got[3]["labels"] == "isc" and all(got[i]["labels"] == "" and got[i]["score"] == 0 for i in range(4, 204))


def plain_licenses(texts):
    """labels and score of each text: every shift of every template whose licence has a key phrase there, word by word; no weights."""
    out = []
    for t in texts:
        ws = ALNUM.findall((t or "").translate(LOW))
        whole = f" {' '.join(ws)} "
        labels, best = {b for p, b in license_scan.BASE.items() if f" {p} " in whole}, 0.0
        for label, (keys, passages) in license_scan.TEMPLATES.items():
            if not any(f" {k} " in whole for k in keys):
                continue
            for passage in passages:
                own = passage.split()
                for shift in range(-len(own), len(ws)):
                    agree = sum(0 <= shift + i < len(ws) and ws[shift + i] == own[i] for i in range(len(own)))
                    if 2 * agree >= len(own):
                        labels.add(label)
                        best = max(best, agree / len(own))
        out.append((",".join(sorted(labels)), best))
    return out


def test_license_labels_and_scores_equal_brute_force(spark):
    rng = random.Random(7)
    passages = [p for _, ps in license_scan.TEMPLATES.values() for p in ps]
    keys = [k for ks, _ in license_scan.TEMPLATES.values() for k in ks]
    texts = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(4)):
            own = rng.choice(passages).split()
            a = rng.randrange(len(own))
            own = own[a : a + rng.choice([5, 15, 60])] if rng.random() < 0.6 else own
            own = [w if rng.random() > 0.15 else rng.choice(["x", "the", "license"]) for w in own]
            parts += [" ".join(own), rng.choice(keys + ["plain words stand here"])]
        texts.append(rng.choice([" ", ", ", ".\n"]).join(parts))
    texts += [None, "", " and ".join(passages), " and ".join(keys)]
    got = {r["doc_id"]: r for r in license_scan.query(docs_of(spark, texts)).collect()}
    for i, (labels, score) in enumerate(plain_licenses(texts)):
        assert got[i]["labels"] == labels, (i, texts[i], labels, got[i])
        assert got[i]["score"] == pytest.approx(score), (i, texts[i], score, got[i])
    assert got[len(texts) - 2]["labels"] == ",".join(sorted(license_scan.TEMPLATES))


def test_a_license_has_its_label_in_any_corpus(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    cut = bsd.split(":\n1. ")[1]
    said = "we do not use the mit license here"
    plain = [f"unrelated words {i} stand in this file" for i in range(6)]
    seen = {t: set() for t in (bsd, cut, said)}
    for texts in ([bsd], [cut], [said], [bsd] * 5, [cut] * 5, [bsd] * 3 + plain, [bsd, cut, said] * 2 + plain, [bsd, cut, said] + plain[:1]):
        rows = {r["doc_id"]: r for r in license_scan.query(docs_of(spark, texts)).collect()}
        for i, t in enumerate(texts):
            if t in seen:
                seen[t].add((rows[i]["labels"], rows[i]["score"]))
    assert [len(s) for s in seen.values()] == [1, 1, 1]
    assert seen[bsd] == {("bsd", 1.0)} and seen[cut] == {("bsd", 1.0)}
    ((labels, score),) = seen[said]
    assert labels == "mit" and score == pytest.approx(0.6)  # three of the five words of the shortest notice


# 10


def test_attention_gradient_is_right():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    weights = quality.learn(x, first, y, rounds=0)
    loss = lambda w: -np.mean(y * np.log(p := quality.forward(w, x, first)[0]) + (1 - y) * np.log(1 - p))
    assert loss(quality.learn(x, first, y, rounds=60)) < 0.3 * loss(weights)


def test_attention_gradient_equals_differences():
    rng = np.random.default_rng(5)
    x, first, y = rng.normal(size=(11, 6)), np.array([0, 3, 4, 11]), np.array([1.0, 0.0, 1.0])
    weights = [w.astype(float) for w in quality._start(6)]
    loss = lambda w: -np.mean(y * np.log(p := quality.forward(w, x, first)[0]) + (1 - y) * np.log(1 - p))
    for i, grad in enumerate(quality.gradient(weights, x, first, y)):
        flat = grad.reshape(-1)
        for k in rng.choice(len(flat), min(8, len(flat)), replace=False):
            up, down = ([w.copy() for w in weights] for _ in range(2))
            up[i].reshape(-1)[k] += 1e-5
            down[i].reshape(-1)[k] -= 1e-5
            assert flat[k] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def test_quality_scores_equal_a_plain_forward_pass():
    """Passage by passage in loops, also over several blocks and for texts without words."""
    rng = random.Random(6)
    texts = [None, "", " ".join(rng.choice(["Alpha", "be", "gamma,", "é", "x|y"]) for _ in range(1500)), "one two", "z" * 5000]
    weights = [w.astype(float) for w in quality._start(quality.FEATURES + quality.LEXICAL)]
    got = quality.passages(pa.array(texts, pa.string()))
    mean, spread = got.format.mean(0), got.format.std(0) + 1e-3
    w1, b1, v, u, a_, c, c0 = weights
    for i, t in enumerate(texts):
        words = SPACED.findall(t or "")
        parts = [words[k : k + quality.PASSAGE] for k in range(0, len(words), quality.PASSAGE)] or [[]]
        assert got.first[i + 1] - got.first[i] == len(parts)
        h, gate = [], []
        for k, part in enumerate(parts):
            lexical = np.zeros(quality.LEXICAL)
            for at, bucket in got.tokens:
                for b in bucket[at == got.first[i] + k]:
                    lexical[b] += 1
            follows = k < len(parts) - 1
            assert lexical.sum() == max(0, 4 * len(part) - (len(part) > 0 and not follows))  # words, pairs, beginnings, endings
            row = np.concatenate([(got.format[got.first[i] + k] - mean) / spread, np.sqrt(lexical / max(1, lexical.sum()))])
            h.append(np.maximum(0, row @ w1 + b1))
            gate.append((np.tanh(h[-1] @ v) / (1 + np.exp(-(h[-1] @ u)))) @ a_)
        share = np.exp(np.array(gate) - max(gate))
        z = sum(s * x for s, x in zip(share / share.sum(), h))
        want = 1 / (1 + np.exp(-(z @ c + c0[0])))
        for block in (1024, 5):
            quality.BLOCK, before = block, quality.BLOCK
            assert quality.Classifier(weights, mean, spread, 0.5).score(pa.array(texts, pa.string()))[i] == pytest.approx(want, abs=1e-5)
            quality.BLOCK = before


def test_quality_learns_from_words_alone(spark):
    """Labels that follow from a word in one passage of many, texts alike in format: held-out rows are told apart."""
    rng = random.Random(9)
    filler = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    rows, labels = [], []
    for i in range(900):
        words, good = [rng.choice(filler) for _ in range(400)], i % 2
        at = rng.randrange(0, 370)
        for k in range(30):
            words[at + k] = ["plumy", "crest", "glint"][k % 3] if good else ["murky", "sludg", "grime"][k % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, good, 0))
    got = quality.quality_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    held = [(r["score"], r["doc_id"] % 2) for r in got.collect() if r["held_out"]]
    above = np.mean([(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x > y])
    assert len(held) > 100 and above > 0.97


def test_quality_sample_is_whole_rows_within_its_bounds(spark):
    docs = spark.createDataFrame([(i, "w " * (10 + 40 * i)) for i in range(50)] + [(7, "copy")] * 30, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id bigint, quality int, toxic int")
    whole = {"w " * (10 + 40 * i) for i in range(50)} | {"copy"}
    for most in (50, 3000, 1 << 30):
        got = quality.sample_of(docs, labels, 40, most)
        assert len(got) <= 40 and sum(len(t) for _, t in got) <= most and {t for _, t in got} <= whole
    assert len(got) == 40


def test_quality_held_out_auc(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = [(r["score"], r["quality"]) for r in quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()]
    assert np.mean([(a > b) + 0.5 * (a == b) for a, x in rows for b, y in rows if x > y]) > 0.97


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_quality_reads_the_text_alone(spark):
    docs = docs_of(spark, [None, "", "same text here", "same text here"])
    labels = spark.createDataFrame([(2, 1, 0), (1, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    assert got[2] == got[3] and got[0] == got[1] and all(0 <= s <= 1 for s in got.values())
    assert quality.quality_scores(docs, labels.where("false")).where("predicted = 1").count() == 4
    odd = docs.withColumn("score", docs.doc_id).withColumn("predicted", docs.text)
    kept = quality.accepted(odd, labels.where("false"))
    assert kept.schema == odd.schema and kept.count() == 4


# pipeline and registry


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, now, SF)
        if k < len(p.STAGES) - 1:
            assert out.columns == docs.columns and out.schema == now.schema
            out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage{k}")
            now = spark.read.parquet(path)
    left = {r["doc_id"] for r in now.collect()}
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    predicted = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    good = [(i, t) for i, t in texts if predicted[i] == 1]
    first = {i for i, (_, c) in brute_links(good).items() if i == c}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, v in brute_contamination([(i, t) for i, t in good if i in first], bench).items() if not v[4]}
    assert left == clean
    assert {r["doc_id"] for r in p.run(spark, SF).collect()} == clean


def test_pipeline_redacts_encoded_secrets(spark):
    import corpus_pipeline as p

    run = base64.b64encode(SECRET.encode()).decode()
    quoted = "".join(f"%{b:02X}" for b in base64.b64encode(gzip.compress(SECRET.encode())))
    texts = [f"x {run} B {run} z", f"q={quoted}", f"key-{run}", SECRET, "clean", None]
    out = {r["doc_id"]: r["text"] for r in p.secret_scan(spark, docs_of(spark, texts), SF).collect()}
    assert all(not secrets.find(t or "") for t in out.values()) and out[4] == "clean" and out[5] is None and out[0].startswith("x [assign]")


def test_pipeline_gives_the_mixed_corpus(spark):
    import corpus_pipeline as p

    rows = p.run(spark, SF).collect()
    taken, whole = collections.Counter(), {}
    for r in rows:
        taken[r["doc_id"]] += r["words"]
        whole[r["doc_id"]] = r["size"], r["source"], r["target"]
    assert all(0 <= taken[i] <= 2 * whole[i][0] for i in whole)
    for source, target in {(s, t) for _, s, t in whole.values()}:
        assert sum(taken[i] for i in whole if whole[i][1] == source) == pytest.approx(target, rel=0.1, abs=2 * mixing.BLOCK)


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_sparse_rows_are_those_of_the_matrix():
    rng = np.random.default_rng(3)
    got = quality.joined([quality.passages(pa.array(t, pa.string())) for t in (some_texts(20, 5), ["", None], ["word " * 700])])
    n = int(got.first[-1])
    dense, sparse = got.matrix(0, n), got.sparse(0, n)
    w, d = rng.normal(size=(dense.shape[1], 4)), rng.normal(size=(n, 4))
    assert sparse.shape == dense.shape
    assert np.allclose(sparse @ w, dense @ w, atol=1e-5) and np.allclose(sparse.T @ d, dense.T @ d, atol=1e-5)
    begin, end = got.first[[5, 2, 21]], got.first[[6, 3, 22]]
    rows = np.concatenate([np.arange(a, b) for a, b in zip(begin, end)])
    assert np.allclose(sparse.of(begin, end) @ w, dense[rows] @ w, atol=1e-5)
    assert np.allclose(got.sparse(3, 9) @ w, dense[3:9] @ w, atol=1e-5)


def test_quality_sample_does_not_lean_to_short_texts(spark):
    docs = spark.createDataFrame([(i, "w " * (20 if i % 2 else 400)) for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(400)], "doc_id bigint, quality int")
    got = quality.sample_of(docs, labels, 4000, 40_000)
    long = sum(len(t) > 500 for _, t in got) / len(got)
    assert 60 < len(got) < 150 and 0.35 < long < 0.65, (len(got), long)


def test_secrets_behind_simple_escapes(spark):
    """Quotes as JSON in JSON has them, however often, octal and %u escapes; spans reach over the escaped text."""
    said = 'password": "hunter2hunter2x'
    once = said.replace('"', '\\"')
    twice = once.replace("\\", "\\\\").replace('"', '\\"')
    deep = said
    for _ in range(6):
        deep = deep.replace("\\", "\\\\").replace('"', '\\"')
    octal = "".join(f"\\{ord(c):03o}" for c in "password=hunter2hunter2x")
    marked = "".join(f"%u{ord(c):04x}" for c in "password=hunter2hunter2x")
    texts = [f'{{\\"{once}\\"}}', f"x {twice} y", f"x {deep} y", f"a {octal} b", f"a {marked} b", "%u0070assword=hunter2hunter2x", r"path C:\\dir\160\"plain\" \/ words", "https:\\/\\/a.org\\/token=hunter2hunter2"]
    got = {r["doc_id"]: [s.split(":") for s in r["spans"].split(",") if s] for r in secrets.secret_spans(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = [(k, t[int(a) : int(b)]) for k, a, b in got[i]]
        if i == 6:
            assert spans == []
        else:
            assert any(k == "assign" and s.endswith(("x", "0078", "\\170", "hunter2")) for k, s in spans), (t, spans)
    assert got[3] == [["assign", "2", str(2 + len(octal))]] and got[4] == [["assign", "2", str(2 + len(marked))]]
    rows = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs_of(spark, texts)).collect()}
    assert all("hunter2" not in t for t in rows.values())
