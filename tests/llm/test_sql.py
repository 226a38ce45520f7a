"""The operators' queries against their SQL twins on whole tables."""

import glob
import os

import duckdb
import pytest

from loomgraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = queries.QUERIES[name](spark, data)
    columns = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    result = connection.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)


def test_queries_without_sql_cover_their_tables(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id")
    for name in set(queries.QUERIES) - set(queries.ORACLE_SQL):
        got = queries.QUERIES[name](spark, data).select("doc_id")
        assert got.exceptAll(documents).count() == 0 and documents.exceptAll(got).count() == 0, name
