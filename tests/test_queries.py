"""Queries against their SQL in DuckDB at the smallest scale."""

import duckdb
import pytest

from glyphmill.plans import queries as plans

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equal(spark, con, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    found = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(dict(zip(names, r, strict=True))[c] for c in cols) for r in found.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
