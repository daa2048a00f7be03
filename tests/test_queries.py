"""Each of the engine's queries against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from lakeloom import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = queries.queries()[name](spark, FOLDER)
    relation = duck.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    key = lambda row: tuple(repr(x) for x in row)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted((tuple(r[k] for k in at) for r in relation.fetchall()), key=key)
