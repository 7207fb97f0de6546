"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quarry.plans import basics, lookups, retrieval, search, stored, structure, understanding

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CASES = [(p, n) for p in (basics, retrieval, search, understanding, structure, lookups, stored) for n in p.QUERIES]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(D, t)}.parquet'")
    return c


def plain(x):
    return round(x, 6) if isinstance(x, float) else bool(x) if isinstance(x, bool) else x


@pytest.mark.parametrize("plan,name", CASES, ids=[n for _, n in CASES])
def test_query(spark, duck, plan, name):
    df = plan.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name not in plan.ORACLE:
        assert rows
        return
    rel = duck.sql(plan.ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def test_every_sql_has_a_query():
    for p in (basics, retrieval, search, understanding, structure, lookups, stored):
        assert set(p.ORACLE) <= set(p.QUERIES)
