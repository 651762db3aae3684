"""Every registered dialogue query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from turnwise.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(float(v), 8) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, duck, sf, name):
    df = Q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    found = duck.execute(Q.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    key = lambda r: tuple(map(str, r))
    assert sorted(rows, key=key) == sorted(want, key=key)


def test_only_sequential_queries_have_no_sql():
    assert Q.QUERIES.keys() - Q.ORACLE_SQL.keys() == {"word_errors", "word_error_kinds"}  # see test_whole.py
