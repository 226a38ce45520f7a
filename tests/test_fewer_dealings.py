"""Rows are dealt no more often than a step needs, and questions that no method takes part in make none."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph, resolve, symbols
from loomgraph.plans import code_graph, code_queries
from loomgraph.schemas import EDGES, NODES, SYMBOLS


@pytest.fixture
def sorted_joins(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


@pytest.fixture
def own(spark, data):
    code_graph.forget()
    yield code_graph.code(spark, data)
    code_graph.forget()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_dealt_once_an_end(sorted_joins, tmp_path):
    spark = sorted_joins
    nodes = spark.createDataFrame([("r", i, "Class", i, i, None, True, None, None, n) for n, i in enumerate("abc")], NODES)
    edges = spark.createDataFrame([("r", "a", "b", "CALLS", "{}", 2), ("r", "a", "b", "CALLS", "{}", 1), ("r", "a", "x", "CALLS", "{}", 3), ("r", "x", "a", "CALLS", "{}", 4), ("r", "c", "a", "CALLS", "{}", 5)], EDGES)
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.parquet(str(tmp_path / name))
    found = graph.valid_edges(*(spark.read.parquet(str(tmp_path / name)) for name in ("edges", "nodes")))
    assert _plan(found).count("Exchange hashpartitioning") == 4
    assert {(r["src"], r["dst"], r["ord"]) for r in found.collect()} == {("a", "b", 1), ("c", "a", 5)}


def test_declarations_are_dealt_once(sorted_joins, own):
    found = symbols.extract_symbols(own.files, own.outer)
    plan = _plan(found)
    assert plan.count("xxhash64") >= 1 and "named_export" not in plan
    # Joins of files to files only.
    assert plan.count("SortMergeJoin") == _plan(symbols.file_symbols(own.files)).count("SortMergeJoin") * 2


def test_exports_and_files_without_a_module(spark, own):
    """An export of its name exports a declaration; a record of a file that isn't among the files makes no symbol."""
    one = own.outer.filter("category = 'classes'").limit(1)
    file, name = one.select("file_id", "name").first()
    rows = own.outer.filter((F.col("file_id") == file) & (F.col("category") == "classes")).withColumn("exported", F.lit(None).cast("boolean"))
    export = rows.filter(F.col("name") == name).withColumns({"category": F.lit("exports"), "start_offset": F.lit(None).cast("int")})
    lost = rows.withColumn("file_id", F.lit("none.js"))
    found = symbols.extract_symbols(own.files, rows.unionByName(export).unionByName(export).unionByName(lost)).filter("kind = 'class'")
    assert found.count() == rows.count() and {r["name"] for r in found.filter("exported").collect()} == {name}


def test_a_place_keeps_its_columns(spark):
    row = dict.fromkeys([p.strip().split(" ")[0] for p in SYMBOLS.replace("array<struct<name:string,type:string>>", "x").split(",")])
    spans = [("s0", 0, 100, 0), ("s1", 10, 20, 1)]
    owned = spark.createDataFrame([tuple((row | {"repository_id": "r", "file_id": "f", "id": i, "kind": "class", "start_offset": a, "end_offset": b, "ord": n}).values()) for i, a, b, n in spans], SYMBOLS)
    asked = spark.createDataFrame([("r", "f", 12, 13, "x", 1), ("r", "f", 12, 13, "y", 2), ("r", "f", 30, 31, "x", 3), ("r", "f", 200, 201, "x", 4), ("r", "g", 1, 2, "x", 5)], "repository_id string, file_id string, start_offset int, end_offset int, wanted string, ord bigint")
    found = resolve.containing_scopes(asked, owned, "wanted", "ord")
    assert {(r["ord"], r["wanted"], r["scope"]) for r in found.collect()} == {(1, "x", "s1"), (2, "y", "s1"), (3, "x", "s0")}


@pytest.mark.parametrize("name", ["class_levels", "class_order", "leaf_modules"])
def test_questions_without_methods_read_no_lines(spark, data, own, name):
    assert code_queries.QUERIES[name](spark, data).count() > 0
    assert not {"records", "symbols", "nodes", "references"} & set(own.__dict__)


def test_references_are_counted_without_relations(spark, data, own):
    assert code_queries.QUERIES["references_counted"](spark, data).count() == 6
    assert "references" not in own.__dict__


@pytest.mark.parametrize("name", ["arch_units", "arch_scope"])
def test_units_need_no_whole_graph(spark, data, own, name):
    assert code_queries.QUERIES[name](spark, data).count() >= 0
    assert "navigator" not in own.__dict__ and "references" not in own.__dict__
