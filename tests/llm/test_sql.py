"""The queries that SQL can express give the same rows as DuckDB."""

import duckdb
import pytest

from docsieve.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    rel = con.execute(registry.oracle_sql()[name])
    names = sorted(d[0] for d in rel.description)
    want = sorted(map(tuple, con.execute(f"SELECT {', '.join(names)} FROM ({registry.oracle_sql()[name]})").fetchall()), key=str)
    got = sorted((tuple(r) for r in registry.queries()[name](spark, SF).select(*names).collect()), key=str)
    assert got == want
