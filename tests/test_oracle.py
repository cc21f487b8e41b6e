"""Every image query equals its SQL in another engine."""

import duckdb
import pytest

from pixelgrove.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_sql(spark, sf, duck, name):
    ours = registry.queries()[name](spark, sf)
    assert name in registry.oracle_sql()
    columns = sorted(ours.columns)
    theirs = duck.execute(registry.oracle_sql()[name])
    order = [d[0] for d in theirs.description]
    assert sorted(order) == columns
    pick = [order.index(c) for c in columns]
    a = sorted(repr(tuple(r)) for r in ours.select(*columns).collect())
    b = sorted(repr(tuple(r[i] for i in pick)) for r in theirs.fetchall())
    assert a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.queries()) <= set(e.queries())
