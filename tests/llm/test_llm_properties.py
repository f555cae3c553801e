"""Properties of the helpers of the training-data operators, on generated input."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import _words, chat, jaccard, language_model, mixing, secrets

text = st.text(alphabet=st.one_of(st.sampled_from("\\#</>turn: \n=%&;aAbB0\t\r\x0b\x0c"), st.characters(codec="utf-8")), max_size=60)


@given(st.lists(st.tuples(text, text), max_size=5))
@settings(max_examples=200, deadline=None)
def test_chat_round_trip(turns):
    rendered = "".join(chat.render(r, t)[0] for r, t in turns)
    assert [x[:2] for x in chat.parse(rendered)] == turns


@given(st.lists(st.one_of(st.none(), text), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_patterns(texts):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    for table, pattern in ((_words.SPACED, r"[^\x20\x09-\x0D]+"), (_words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = _words.words(pa.array(texts, pa.string()), table)
        for i, t in enumerate(texts):
            want = re.findall(pattern, (t or "").translate(low))
            assert [got.data[got.start[k] : got.end[k]].tobytes().decode() for k in range(got.first[i], got.first[i + 1])] == want


@given(text)
@settings(max_examples=200, deadline=None)
def test_secret_scan_ends_and_its_spans_lie_in_the_text(t):
    for kind, start, end, *_ in secrets.find(t):
        assert kind in secrets.KINDS and 0 <= start < end <= len(t)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
@settings(max_examples=100, deadline=None)
def test_packing(values):
    v = np.array(sorted(values), np.uint64)
    assert (language_model.unpack(language_model.pack(v)) == v).all() and (language_model.unpack_sorted(language_model.pack_sorted(v)) == v).all()


@given(st.integers(1, 500), st.integers(0, 2**63))
@settings(max_examples=60, deadline=None)
def test_permutation(n, key):
    assert sorted(mixing.permute(np.arange(n), np.full(n, n), np.full(n, key, np.uint64)).tolist()) == list(range(n))


@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=1, max_size=12))
@settings(max_examples=100, deadline=None)
def test_tile_search_finds_all_classes(sets):
    arrays = [_words.mix(np.array(sorted(s), np.uint64)) for s in sets]
    root = jaccard.compare([np.sort(a) for a in arrays])
    top = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 90 * len(a | b):
                    top[i] = top[j] = min(top[i], top[j])
    assert root.tolist() == top
