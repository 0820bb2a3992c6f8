"""The parts of the operators' results that SQL can express, against it in DuckDB."""

import os

import duckdb
import pytest

from varnika.llm import queries

DATA = os.environ.get("VARNIKA_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


ALL = queries.QUERIES | queries.PARTS


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_part(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "embeddings"):
        con.execute(f"create view {name_} as select * from '{DATA}/{name_}.parquet'")
    df, want = ALL[name](spark, DATA), con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.project(", ".join(columns)).fetchall())


def test_every_part_has_sql():
    assert set(queries.PARTS) <= set(queries.ORACLES) <= set(ALL)
