"""Every query with an SQL twin gives the rows that DuckDB gives for it."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7)} <= set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = df.collect()
    if name not in SQL:
        return
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    text = lambda row: repr(tuple(row[n] for n in order))
    assert sorted(text(r.asDict()) for r in got) == sorted(text(dict(zip(names, r))) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["ident_id"]
