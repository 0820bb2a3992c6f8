"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from varnika.plans import catalog

DATA = os.environ.get("VARNIKA_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def rows(found):
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    assert rows(df.select(*columns).collect()) == rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", ["encode_ids", "one_hot_shifted", "one_hot_sparse", "pad_ids", "teacher_shift", "tile_ids", "tokenizer_json"])
def test_query_counts_characters_without_sorting_them(spark, name, monkeypatch):
    fitted, fit = [], catalog.vocab.fit_vocab
    monkeypatch.setattr(catalog.vocab, "fit_vocab", lambda *a, **b: fitted.append(fit(*a, **b)) or fitted[-1])
    catalog.QUERIES[name](spark, DATA)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in fitted]
    assert plans and not any("SortAggregate" in plan for plan in plans)  # else a task holds a row for each of its characters


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
