"""Operators that SQL can express, against DuckDB."""

import math
import os

import duckdb
import pytest

from lakeloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    df = queries.queries()[name](spark, FOLDER)
    relation = con.sql(queries.oracle_sql()[name])
    assert sorted(relation.columns) == sorted(df.columns)
    want = {r[relation.columns.index("doc_id")]: dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()}
    found = {r.doc_id: r.asDict() for r in df.collect()}
    assert found.keys() == want.keys()
    for key, row in found.items():
        for column, value in row.items():
            other = want[key][column]
            assert value == other or isinstance(value, float) and math.isclose(value, other, rel_tol=1e-12), (key, column)
