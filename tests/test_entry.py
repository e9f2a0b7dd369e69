"""Every query against its SQL on the smallest tables; queries without SQL must run."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodeframe.plans.core_queries import core_queries
from lodeframe.plans.core_sql import core_sql
from lodeframe.plans.engine_queries import engine_queries, engine_sql
from lodeframe.plans.wal_sql import wal_sql

QUERIES = {**core_queries(), **engine_queries()}
SQL = {**core_sql(), **wal_sql(), **engine_sql()}


def canon(rows):
    def one(x):
        if isinstance(x, bool) or x is None:
            return str(x)
        return repr(float(x)) if isinstance(x, (int, float)) else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{small}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = canon(map(tuple, df.select(*cols).collect()))
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == cols
        assert got == canon(rel.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90
    assert e.entry(spark).count() > 0
