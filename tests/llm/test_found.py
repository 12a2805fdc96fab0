"""The text queries over the smallest tables, and against DuckDB where SQL can say them."""

import glob
import os

import duckdb
import pytest

from loamstone.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows)) and rows
    if name in queries.ORACLE:
        result = duck.execute(queries.ORACLE[name])
        names = [x[0] for x in result.description]
        assert sorted(names) == columns
        want = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
        assert sorted(rows, key=repr) == sorted(want, key=repr)
