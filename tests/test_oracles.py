"""Every query with SQL gives the same rows as DuckDB over the same tables."""

import math
import os

import duckdb
import pytest

from docsieve.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else float(v) if type(v).__name__ == "Decimal" else str(v)
    return sorted(repr(tuple(cell(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    rel = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    want, got = plain(rel.fetchall(), names), plain(df.collect(), df.columns)
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    assert len(got) == len(want) and not wrong, (len(got), len(want), wrong[:3])


def test_queries_without_sql_give_rows(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, DATA).limit(5).count() > 0, name
