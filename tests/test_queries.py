"""Every query of the core runs over small tables and, where it has SQL, gives DuckDB's rows."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from clauselake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    result = duck.execute(catalog.ORACLE_SQL[name])
    said = [d[0] for d in result.description]
    assert sorted(said) == columns
    want = sorted((tuple(plain(r[said.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "value"]
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.ORACLE_SQL) <= set(entry.oracle_sql())
