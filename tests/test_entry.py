"""Every graph query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from chronoweave.plans.oracle import oracle_sql
from chronoweave.plans.queries import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(value):
    return round(float(value), 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, sf, duck, name):
    got = queries()[name](spark, sf)
    want = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    left = sorted(str([plain(r[c]) for c in order]) for r in got.collect())
    right = sorted(str([plain(dict(zip(columns, r))[c]) for c in order]) for r in want.fetchall())
    assert left == right


def test_entry(spark):
    top = __spark_entry__.entry(spark).collect()
    assert len(top) == 50 and set(queries()) <= set(__spark_entry__.queries())
