"""Every registered query with an SQL equivalent gives the same rows as DuckDB."""

import os

import duckdb
import pytest

from graphloom import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def plain(rows):
    text = lambda x: None if x is None else str(round(float(x), 9)) if isinstance(x, float) else str(int(x)) if isinstance(x, bool) else str(x)
    return sorted((tuple(map(text, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = duck.execute(ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(map(tuple, df.select(*names).collect())) == plain(got.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_runs_alike(spark, sf, name):
    first = QUERIES[name](spark, sf).collect()
    assert first and plain(map(tuple, first)) == plain(map(tuple, QUERIES[name](spark, sf).collect()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
