"""Queries against their SQL, over whole tables."""

import duckdb
import pytest

from clauselake.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    rows = [dict(zip([c[0] for c in want.description], row, strict=True)) for row in want.fetchall()]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    key = lambda row: tuple((row[c] is None, str(row[c])) for c in columns)
    assert sorted(map(key, rows)) == sorted(key(r.asDict()) for r in got.collect())
