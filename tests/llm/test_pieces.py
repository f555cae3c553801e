"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quern.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces._model(PATH))


def odd_texts(n=2000, seed=3):
    rng = random.Random(seed)
    letters = " " * 6 + "ab▁ \n\t\x00éß\U0001f600中<s></s><0x41>▁́ﬁTthe²m²_.,;9٣​"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*texts, "", " ", "  ", "▁", "▁ ▁", "a" * 3000, " " * 5000, "<s>", "</s> x", "<0x0A>", "\n\n", "ab" * 2000 + " tail", "it's m² 3.5kg", "�"]


def test_ids_and_texts_equal_the_library(codec, library):
    texts = odd_texts()
    want = library.encode(texts, add_bos=True, add_eos=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == want
    assert [codec.decode(ids) for ids in want] == library.decode(want)


def test_both_agendas_agree(codec):
    sections = sorted({s for t in odd_texts(500, 5) if t for s in codec.section.findall(pieces.MARK + t.replace(" ", pieces.MARK))})
    assert len(sections) > 500
    assert codec.merged_together(sections) == [np.array(codec.merged(s), "<u4").tobytes() for s in sections]


def test_sections_hold_the_whole_text(codec):
    for t in odd_texts(500, 6):
        whole = pieces.MARK + t.replace(" ", pieces.MARK)
        assert "".join(codec.section.findall(whole)) == whole


def test_decoding_any_ids_equals_the_library(codec, library):
    rng = random.Random(4)
    kinds = [0, 1, 2, *range(3, 259), *range(259, 300), 29871, 28705]
    for _ in range(3000):
        ids = [rng.choice(kinds) for _ in range(rng.randint(0, 20))]
        assert codec.decode(ids) == library.decode(ids)


def test_a_full_memory_starts_anew(library):
    small = pieces.Codec(pieces._model(PATH), remembered=50)
    texts = odd_texts(200, 7)
    got = [np.frombuffer(x, "<u4").tolist() for i in range(0, len(texts), 10) for x in small.encode(texts[i : i + 10])]
    assert got == library.encode(texts, add_bos=True, add_eos=True)


def test_a_difference_from_the_library_is_not_passed_over(codec):
    wrong = pieces.Codec(pieces._model(PATH))
    wrong.rank = wrong.rank.max() - wrong.rank
    with pytest.raises(ValueError, match="differ"):
        wrong.encode(["some ordinary words that merge in many steps"])


def test_query_equals_the_library_on_whole_tables(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_sentencepiece"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_tables_encode_and_decode(spark, library):
    rows = [(1, None, "kept"), (1, "two  spaces\n", None), (None, "", "x"), (2, "é" * 40 + "\x00", "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    both = pieces.decoded(pieces.encoded(docs, PATH), PATH).collect()
    assert sorted((str(r.doc_id), str(r.text), r.ids, r.decoded) for r in both) == sorted(
        (str(d), str(t), ids := library.encode(t or "", add_bos=True, add_eos=True), library.decode(ids)) for d, t, _ in rows
    )
    assert pieces.decoded(spark.createDataFrame([(None,)], "ids array<int>"), PATH).first().decoded is None
    assert pieces.encoded(docs.limit(0), PATH).count() == 0
