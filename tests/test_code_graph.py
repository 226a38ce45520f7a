"""The code graph makes no more of its tables than a question needs."""

import re

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import resolve
from loomgraph.plans import code_graph, code_queries
from loomgraph.session import stored

ONE_RELATION = {"edges_of_relation": "EXPORTS", "imported_files": "IMPORTS", "implemented_interfaces": "IMPLEMENTS", "class_ancestors": "EXTENDS"}


@pytest.fixture
def fresh():
    code_graph.forget()
    yield
    code_graph.forget()


@pytest.mark.parametrize("name", ["graph_nodes", "nodes_found", "structure_nodes", "external_dependencies"])
def test_questions_about_nodes_resolve_nothing(spark, data, fresh, monkeypatch, name):
    def never(*_):
        raise AssertionError("resolved")

    monkeypatch.setattr(resolve, "resolve", lambda *a: never())
    monkeypatch.setattr(code_graph.graph, "valid_edges", never)
    assert code_queries.QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", sorted(ONE_RELATION))
def test_questions_about_a_relation_make_its_edges_only(spark, data, fresh, monkeypatch, name):
    made = []

    def kept(df, label):
        made.append((label, stored(df, label)))
        return made[-1][1]

    monkeypatch.setattr(code_graph, "stored", kept)
    code_queries.QUERIES[name](spark, data).count()
    edges = [df for label, df in made if label == "edges"]
    assert len(edges) == 1 and "relations" not in [label for label, _ in made]
    assert {r[0] for r in edges[0].select("relation").distinct().collect()} == {ONE_RELATION[name]}
    whole = code_graph.code(spark, data).navigator.edges.filter(F.col("relation") == ONE_RELATION[name])
    assert sorted(map(tuple, edges[0].collect())) == sorted(map(tuple, whole.collect()))


def test_a_name_is_looked_up_once_a_file(spark):
    symbols = spark.createDataFrame(
        [("r", "a.C", "C", "class", "module:a", "a.js", True, 1), ("r", "a.C.m", "m", "method", "a.C", "a.js", False, 2)],
        "repository_id string, id string, name string, kind string, parent string, file_id string, exported boolean, ord bigint",
    )
    bindings = spark.createDataFrame([("r", "b.js", "x", "a.js", "a.C", 1)], "repository_id string, file_id string, local string, target_file string, target string, ord bigint")
    wanted = spark.createDataFrame([("r", "b.js", name, i) for i, name in enumerate(["x.m", "x.m", "x", "C", "no", "no", None])], "repository_id string, file_id string, wanted string, n int")
    found = resolve.resolve_names(wanted, bindings, symbols)
    assert found.columns == ["repository_id", "file_id", "wanted", "n", "target"]
    assert [r["target"] for r in found.orderBy("n").collect()] == ["a.C.m", "a.C.m", "a.C", "a.C", None, None, None]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[repository_id#\d+, file_id#\d+, wanted#\d+\]", plan)
