"""What holds a node is found without summing up all that a task reads of a file."""

from loomgraph.operators import traversal
from loomgraph.operators.navigator import Navigator
from loomgraph.plans import trade_graph


def test_edges_are_dealt_before_they_are_summed_up(spark, data):
    nav = trade_graph.navigator(spark, data, "contains")
    plan = nav.parents()._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("partial_min_by") < plan.index("REPARTITION_BY_COL")


def test_ids_that_repeat_or_have_no_parent_are_found_once(spark):
    nodes = spark.createDataFrame([("r", "R", "Region"), ("r", "n", "Nation"), ("r", "c", "Customer"), ("r", "alone", "Customer")], "repository_id string, id string, type string")
    edges = spark.createDataFrame([("r", "R", "n", "CONTAINS", "{}", 1), ("r", "n", "c", "CONTAINS", "{}", 2)], "repository_id string, src string, dst string, relation string, metadata_json string, ord bigint")
    nav = Navigator(nodes, edges)
    asked = spark.createDataFrame([("r", i) for i in ("c", "c", "alone", "R", "unknown")], "repository_id string, id string")
    found = sorted((r["id"], r["container"]) for r in nav.containing("Region", asked).collect())
    assert found == [("R", "R"), ("alone", None), ("c", "R"), ("unknown", None)]
    every = traversal.nearest_above(nodes.select("repository_id", "id"), nav.parents(), nodes.filter("type = 'Nation'").select("repository_id", "id"))
    assert sorted((r["id"], r["container"]) for r in every.collect()) == [("R", None), ("alone", None), ("c", "n"), ("n", "n")]
