"""The driver's contract: queries run, and equal their SQL twins."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from loomgraph.plans import code_queries, oracle, queries

WITH_SQL = sorted(set(queries.QUERIES) & set(oracle.ORACLE_SQL) | set(code_queries.QUERIES) & set(code_queries.ORACLE_SQL))


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 5)
    return tuple(plain(x) for x in value) if isinstance(value, list | tuple) else value


@pytest.fixture(scope="module")
def tables(data):
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, tables, data, name):
    frame = __spark_entry__.queries()[name](spark, data)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    result = tables.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_dfs_visits_what_bfs_reaches(spark, data):
    rows = queries.dfs_preorder(spark, data).collect()
    assert sorted(r["place"] for r in rows) == list(range(len(rows))) and len({r["id"] for r in rows}) == len(rows)
    from loomgraph.plans.trade_graph import navigator

    reached = navigator(spark, data, "imports").bfs("nation:0")
    assert {r["id"] for r in rows} == {r["id"] for r in reached.collect()}
