"""Components are looked for among links that lead on, and their members are gathered only for who asks."""

from loomgraph.operators import traversal
from loomgraph.plans import code_graph, code_queries
from loomgraph.session import Scratch


def test_links_into_dead_ends_are_not_written(spark, monkeypatch):
    written, store = {}, Scratch.store

    def kept(self, df, label):
        written.setdefault(label, store(self, df, label).count())
        return store(self, df, label)

    monkeypatch.setattr(Scratch, "store", kept)
    pairs = [("a", "b"), ("b", "a"), ("a", "a"), *[("a", f"x{i}") for i in range(50)], ("y", "a")]
    edges = spark.createDataFrame([("r", a, b, "CALLS") for a, b in pairs], "repository_id string, src string, dst string, relation string")
    nodes = spark.createDataFrame([("r", i) for i in ("a", "b", "y", *(f"x{i}" for i in range(50)))], "repository_id string, id string")
    parts = traversal.strong_components(nodes, edges)
    assert {(r["id"], r["component"]) for r in parts.collect() if r["id"] in "aby"} == {("a", "a"), ("b", "a"), ("y", "y")}
    assert written["scc-links"] == 3
    between = traversal.between_components(edges, parts)
    assert between.count() == 51 and {(r["src"], r["dst"]) for r in between.collect()} == {("y", "a"), *(("a", f"x{i}") for i in range(50))}


def test_condensed_edges_gather_no_members(spark, data, monkeypatch):
    def never(*_):
        raise AssertionError("numbered")

    monkeypatch.setattr(traversal, "ranked", never)
    code_graph.forget()
    assert code_queries.QUERIES["call_condensation"](spark, data).count() > 0
    code_graph.forget()
