"""Every query against its SQL twin, on the smallest tables."""

import math
import os

import pytest

from stratagrid.plans.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(order).collect()), key=str)
    if name not in SQL:
        assert got
        return
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == order
    want = sorted((tuple(map(plain, (row[rel.columns.index(c)] for c in order))) for row in rel.fetchall()), key=str)
    assert len(got) == len(want)
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        close = all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5) for a, b in bad for x, y in zip(a, b))
        assert close, bad[:3]
