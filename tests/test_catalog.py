"""Every registered ledger query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from tallyspark.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else str(v) if hasattr(v, "year") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(map(plain, r)) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    want = duck.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert sorted(map(repr, got)) == sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert 0 < len(rows) <= 5 and [r["sum"] for r in rows] == sorted((r["sum"] for r in rows), reverse=True)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
