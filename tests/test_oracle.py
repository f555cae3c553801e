"""Every query of the library against its DuckDB SQL on the smallest tables."""

import decimal

import duckdb
import pytest

from quern.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool):
        return int(v)
    return float(v) if isinstance(v, decimal.Decimal) else v


def ordered(rows, columns, names):
    at = [columns.index(n) for n in names]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rel = duck.sql(registry.ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    got, want = ordered(df.collect(), df.columns, names), ordered(rel.fetchall(), list(rel.columns), names)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-6, rel=1e-9, nan_ok=True) if all(isinstance(x, (int, float)) for x in (*a, *b)) else a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).limit(5).collect() is not None
