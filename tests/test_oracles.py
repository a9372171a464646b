"""Every query with an SQL twin, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "documents labels events pages embeddings benchmark conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    result = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(r) for r in result.fetchall()), key=_key)
    got = sorted((tuple(r) for r in df.select(names).collect()), key=_key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a == pytest.approx(b, abs=2e-6, nan_ok=True) if any(isinstance(v, float) for v in a) else a == b


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["split", "label", "n", "mean_words"] and out.count() == 6


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_twin(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0
