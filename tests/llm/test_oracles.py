"""Queries of this subpackage against their SQL twins."""

import duckdb
import pytest

import __spark_entry__ as entry
from stratagrid.llm.oracles import SQL
from stratagrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = c.sql(SQL[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(order).collect()), key=str)
    assert got == sorted((tuple(r[want.columns.index(k)] for k in order) for r in want.fetchall()), key=str)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and set(QUERIES) <= set(names) and set(entry.oracle_sql()) <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
