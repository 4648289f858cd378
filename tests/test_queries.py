"""Every registered query against its SQL on the small tables."""

import os

import duckdb
import pytest

from tallyhold import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, SF)
    sql = queries.oracle_sql()[name]
    assert sorted(d[0] for d in con.execute(sql).description) == sorted(df.columns)
    want = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall(), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want
