"""Every query that SQL can express gives the same rows in both engines."""

import duckdb
import pytest

from perigee.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("customer", "events"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    r = duck.sql(SQL[name])
    assert sorted(r.columns) == columns
    theirs = sorted((tuple(x[r.columns.index(c)] for c in columns) for x in r.fetchall()), key=str)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).collect()[0]["total"] == 150
    assert set(e.oracle_sql()) <= set(e.queries())
