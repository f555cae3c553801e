"""All queries and the pipeline over empty tables, and over nulls, repeated rows and odd columns."""

import pytest

from quern.llm import queries

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
CLASH = ", score double, words string, node bigint, hits int, id string, `row` bigint, size int, base string, component bigint, held_out string"
ODD = (0.5, "w", 1, 2, "x", 3, 4, "b", 5, "h")


def tables(spark, name, rows, more="", odd=()):
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/{name}"
    for table, schema in SCHEMAS.items():
        spark.createDataFrame([(*r, *odd) for r in rows.get(table, [])], schema + more).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return folder


#: Queries that give a row a document (op5: a conversation).
BY_DOCUMENT = sorted(q for q in queries.QUERIES if not q.startswith(("op11_", "op12_")))


@pytest.fixture(scope="module")
def empty(spark):
    return tables(spark, "empty", {})


@pytest.fixture(scope="module")
def odd(spark):
    long = "the MIT License token=abcdefghijklmnop " + " ".join(f"v{i}" for i in range(3000))
    rows = {
        "documents": [(1, "a b c d e f g h i j k", "en", "s", 5), (1, "a b c d e f g h i j k", "en", "s", 5), (None, None, None, None, None), (None, "lonely text", None, None, 1), (2, "", "en", None, 0), (3, long, "de", "s", 9), (4, "\x00 é \U0001f600", None, "t", 3)],
        "labels": [(1, 1, 0), (1, 0, 0), (None, 1, 1), (3, None, None), (99, 0, 0)],
        "benchmark": [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (None, "lonely"), (2, None), (3, "")],
        "embeddings": [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [3.0, -1.0], None), (2, None, 1), (3, [None, 1.0], 1), (4, [], 1), (5, [5.0, 5.5], 1)],
        "conversations": [(1, 0, "user", None), (1, None, None, "### x"), (None, 1, "assistant", "</turn>"), (1, 0, "user", None)],
    }
    return tables(spark, "odd", rows, CLASH, ODD), rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == (1 if name.startswith("op5_") else 0)


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_odd_rows_and_columns(spark, odd, name):
    folder, rows = odd
    got = queries.QUERIES[name](spark, folder).collect()
    assert len(got) == (3 if name.startswith("op5_") else len(rows["documents"]))
    if "doc_id" in got[0].asDict():
        assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(r[0]) for r in rows["documents"])


def test_odd_vectors_and_phrases(spark, odd):
    rows = queries.QUERIES["op11_whitening"](spark, odd[0]).collect()
    assert sorted(str(r.vec_id) for r in rows if r.component == 1) == ["1", "1", "5", "None"] and {r.n for r in rows} == {4}
    assert queries.QUERIES["op12_collocations"](spark, odd[0]).count() == 0  # no phrase of ten occurrences


@pytest.fixture(scope="module")
def long(spark):
    """One very long text, a copy of it, and short ones."""
    text = " ".join(f"w{i % 5000} v{i % 77}." + ("\n" if i % 9 == 0 else "") for i in range(100_000)) + " token=abcdefghijklmnop a@b.org released under the MIT license"
    rows = {
        "documents": [(1, text, "en", "s", 9), (2, text, "en", "s", 9), *((i, f"short text {i} " * 30, "en", "t", 9) for i in range(3, 30))],
        "labels": [(i, i % 2, 0) for i in range(1, 30)],
        "benchmark": [(1, " ".join(f"w{i} v{i}" for i in range(70, 76)))],
        "conversations": [(1, 0, "user", text), (1, 1, "assistant", text)],
    }
    return tables(spark, "long", rows)


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_very_long_texts(spark, long, name):
    got = queries.QUERIES[name](spark, long).collect()
    assert len(got) == (2 if name.startswith("op5_") else 29)
    one = {r["doc_id"]: r.asDict() for r in got} if not name.startswith("op5_") else {}
    if one and not name.startswith("op2_"):
        assert {k: v for k, v in one[1].items() if k not in ("doc_id", "held_out")} == {k: v for k, v in one[2].items() if k not in ("doc_id", "held_out")}
    for column, want in {"n_assign": 1, "n_email": 1, "base_labels": "mit", "component_id": 1, "size": 200_007, "n_tokens": 200_008}.items():
        if name.startswith("op13_"):  # its tokens are pieces
            continue
        assert not one or column not in one[1] or one[1][column] == want, column


def test_pipeline_on_empty_and_odd_tables(spark, empty, odd):
    import corpus_pipeline as p

    assert p.run(spark, empty).count() == 0
    kept = p.run(spark, odd[0]).collect()
    assert {r["doc_id"] for r in kept} <= {None, 2, 3, 4} and any(r["doc_id"] is None for r in kept)
