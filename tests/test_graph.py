"""Graph operators on hand-built nodes and edges."""

import itertools

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import diagram, graph, search, traversal
from loomgraph.operators.navigator import Navigator
from loomgraph.schemas import EDGES, NODES


def make(spark, pairs, kind="Function", relation="CALLS", names=None):
    ids = names or sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([("r", i, kind, i, i, None, True, f"Src/{i}.js", None, n) for n, i in enumerate(ids)], NODES)
    edges = spark.createDataFrame([("r", a, b, relation, "{}", n) for n, (a, b) in enumerate(pairs)], EDGES)
    return nodes, edges


def rows(df, *columns):
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}


CASES = {
    "chain": ["ab", "bc", "cd"],
    "diamond": ["ab", "ac", "bd", "cd"],
    "loop": ["aa", "ab"],
    "cycle_tail": ["ab", "ba", "bc", "cd"],
    "two": ["ab", "cd", "dc", "de", "ef", "fd"],
}


def brute_reach(pairs, ids):
    reach = {i: {i} for i in ids}
    for _ in ids:
        for a, b in pairs:
            for i in ids:
                if a in reach[i]:
                    reach[i].add(b)
    return reach


@pytest.mark.parametrize("case", ["diamond", "two"])
def test_components_cycles_and_levels(spark, case):
    pairs = [tuple(p) for p in CASES[case]]
    ids = sorted({x for p in pairs for x in p})
    nodes, edges = make(spark, pairs)
    reach = brute_reach(pairs, ids)
    strong = {i: min(j for j in ids if j in reach[i] and i in reach[j]) for i in ids}
    parts = traversal.strong_components(nodes, edges)
    assert rows(parts, "id", "component") == set(strong.items())
    weak = brute_reach([*pairs, *[(b, a) for a, b in pairs]], ids)
    assert rows(traversal.weak_components(nodes, edges), "id", "component") == {(i, min(weak[i])) for i in ids}
    cyclic = {i for i in ids if any((i, j) in pairs and i in reach[j] for j in ids)}
    levels = traversal.topological_levels(nodes, edges).collect()
    assert {r["id"] for r in levels if r["unresolved"]} == {i for i in ids if any(i in reach[c] for c in cyclic)}
    level = {r["id"]: r["level"] for r in levels}
    assert all(level[a] < level[b] for a, b in pairs if level[a] is not None and level[b] is not None)
    members = {c: {i for i in ids if strong[i] == c} for c in strong.values()}
    want = {c for c, m in members.items() if len(m) > 1 or (c, c) in pairs}
    assert rows(traversal.cycles(nodes, edges, parts), "component") == {(c,) for c in want}
    _, between, _ = traversal.condensation(nodes, edges, parts)
    assert rows(between, "src", "dst") == {(strong[a], strong[b]) for a, b in pairs if strong[a] != strong[b]}


def test_self_loop_is_a_cycle(spark):
    assert rows(traversal.cycles(*make(spark, [("a", "a"), ("a", "b")])), "component") == {("a",)}


def test_bfs_and_dfs(spark):
    nodes, edges = make(spark, [tuple(p) for p in CASES["diamond"]])
    nav = Navigator(nodes, edges)
    assert rows(nav.bfs("a"), "id", "depth", "parent") == {("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b")}
    assert rows(nav.bfs("d", 1, direction="incoming"), "id") == {("d",), ("b",), ("c",)}
    walk = sorted(rows(nav.dfs("a"), "place", "id", "depth", "parent"))
    assert walk == [(0, "a", 0, None), (1, "b", 1, "a"), (2, "d", 2, "b"), (3, "c", 1, "a")]
    nodes, edges = make(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")])
    limited = rows(Navigator(nodes, edges).dfs("a", 2), "id", "depth")
    assert limited == {("a", 0), ("b", 1), ("c", 2)}  # d is hidden behind the longer path


def test_inheritance_stops_in_a_cycle(spark):
    nav = Navigator(*make(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "x")], relation="EXTENDS"))
    assert sorted(rows(nav.get_inheritance_tree("a"), "depth", "ancestor")) == [(0, "a"), (1, "b"), (2, "c")]


def test_edges_need_both_ends_and_are_distinct_by_metadata(spark):
    nodes, _ = make(spark, [("a", "b")])
    again = spark.createDataFrame([("r", "a", "b", "CALLS", "{}", 0), ("r", "a", "b", "CALLS", "{}", 5), ("r", "a", "b", "CALLS", '{"callee":"x"}', 1), ("r", "a", "zz", "CALLS", "{}", 2)], EDGES)
    assert rows(graph.valid_edges(again, nodes), "src", "dst", "metadata_json", "ord") == {("a", "b", "{}", 0), ("a", "b", '{"callee":"x"}', 1)}
    assert Navigator(nodes, again).get_calls("a").filter("neighbor = 'b'").count() == 1
    twice = nodes.unionByName(nodes.withColumns({"name": F.lit("other"), "ord": F.col("ord") + 10}))
    assert rows(graph.first_nodes(twice), "id", "name") == {("a", "a"), ("b", "b")}


def test_navigator_lookups(spark):
    nodes, edges = make(spark, [("a", "b"), ("b", "c")], relation="CONTAINS")
    nav = Navigator(nodes, edges)
    assert rows(nav.get_nodes(["a", "zz"]), "id") == {("a",)} and rows(nav.get_node("b"), "id") == {("b",)}
    assert rows(nav.get_children("a"), "child") == {("b",)} and rows(nav.get_parent("c"), "parent") == {("b",)}
    assert rows(nav.get_public_api("a"), "id") == {("a",), ("b",), ("c",)} and rows(nav.get_related_symbols("b"), "neighbor") == {("a",), ("c",)}
    assert rows(nav.has_edge(edges.select("repository_id", "src", "dst"), ("CALLS",))) == set()
    assert rows(nav.get_symbol_by_qualified_name("c"), "id") == {("c",)} and nav.search_by_relation("CONTAINS").count() == 2
    found, within = nav.get_neighbourhood("b")
    assert rows(found, "id") == {("a",), ("b",), ("c",)} and within.count() == 2
    assert nav.repository("other").nodes.count() == 0 and nav.edges_to("b").count() == nav.edges_from("b").count() == 1
    full = nav.get_documentation_context("b").first()
    assert full["parent"] == "a" and full["children"] == ["c"] and full["file"] is None


def brute_score(value, query):
    v, q = value.lower(), query.lower()
    if v == q:
        return 1000
    if v.startswith(q):
        return 800 - len(v)
    if q in v:
        return 600 - len(v)
    at, total = 0, 0
    for c in q:
        i = v.find(c, at)
        if i < 0:
            return 0
        total += 10 - min(i - at, 9)
        at = i + 1
    return total


def test_search(spark):
    names = ["Reader", "readAll", "spread", "rxeyaz", "re", "RE", "b", "Zebra", "threadpool"]
    nodes, _ = make(spark, [], names=names)
    for query in ("read", "re", "b", "rea", "xq"):
        scores = {r["name"]: r["score"] for r in nodes.withColumn("score", __import__("loomgraph.functions.text", fromlist=["x"]).fuzzy_score(F.col("name"), query)).collect()}
        assert scores == {n: brute_score(n, query) for n in names}
        grams = [query[i : i + 3] for i in range(len(query) - 2)] if len(query) >= 3 else [query]
        own = {n: {n.lower()[i : i + 3] for i in range(len(n) - 2)} if len(n) >= 3 else {n.lower()} for n in names}
        pool = [n for n in names if all(g in own[n] for g in grams)] or names
        want = sorted((-brute_score(n, query), n.lower(), n) for n in pool if brute_score(n, query) > 0)
        got = [(r["score"], r["name"].lower()) for r in search.fuzzy(nodes, query).collect()]
        assert got == [(-s, low) for s, low, _ in want]
    assert [r["name"] for r in search.by_name(nodes, "READ", limit=2).collect()] == ["Reader", "readAll"]
    assert [r["name"] for r in search.by_name(nodes, "re", exact=True).collect()] == ["re", "RE"] and search.by_path(nodes, "src/Z").count() == 1


def test_diagram_cut_and_labels(spark):
    ids = [f"m{i:02d}" for i in range(90)]
    nodes, edges = make(spark, list(itertools.pairwise(ids)), kind="Module", relation="IMPORTS")
    shown, kept = diagram.build_diagram(Navigator(nodes, edges))
    assert shown.count() == 80 and kept.count() == 79
    odd = nodes.limit(2).withColumns({"name": F.lit('a[b]"c"\n(d)'), "type": F.lit("ExternalDependency")})
    text = diagram.to_mermaid(odd.withColumn("place", F.col("ord")).select("repository_id", "id", "name", "type", "place"), kept.limit(1)).first()["mermaid"]
    assert "  N0([ab&quot;c&quot; d])" in text.split("\n")
    line = diagram.dot_lines(odd, edges.limit(0)).filter("part = 1").first()["line"]
    assert 'label="ExternalDependency\\\\na[b]\\"c\\"\\n(d)"' in line


def test_what_many_nodes_point_to_is_met_in_no_single_task(spark, monkeypatch):
    from loomgraph.operators import traversal

    monkeypatch.setattr(traversal, "_MANY", 100)
    of = spark.range(1000, numPartitions=4)
    parents = of.selectExpr("'R' as repository_id", "concat('a', id) as id", "concat('b', id % 50) as parent").unionByName(
        spark.range(50).selectExpr("'R' as repository_id", "concat('b', id) as id", "if(id < 40, 'c', 'd') as parent")
    ).unionByName(spark.range(1).selectExpr("'R' as repository_id", "'c' as id", "'top' as parent"))
    ids = parents.select("repository_id", "id")
    targets = spark.createDataFrame([("R", "top")], "repository_id string, id string")
    joined = []
    followed = traversal._followed

    def watched(rows, further, count, scratch):
        out = followed(rows, further, count, scratch)
        joined.append((count, out.filter("done").count()))
        return out

    monkeypatch.setattr(traversal, "_followed", watched)
    found = {r["id"]: r["container"] for r in traversal.nearest_above(ids, parents, targets).collect()}
    assert len(found) == 1051
    assert all(found[f"a{i}"] == ("top" if i % 50 < 40 else None) for i in range(1000))
    assert all(found[f"b{i}"] == ("top" if i < 40 else None) for i in range(50)) and found["c"] == "top"
    # What has met its target, or the top, is not joined again.
    assert [count for count, _ in joined] == sorted((count for count, _ in joined), reverse=True) and joined[-1][0] == joined[-1][1]


def test_context_of_a_few_nodes_walks_few_parents(spark, monkeypatch):
    from loomgraph.operators import traversal
    from loomgraph.operators.navigator import Navigator
    from loomgraph.schemas import EDGES, NODES

    node = lambda i, kind: ("R", i, kind, i, i, None, False, None, None, 0)
    nodes = spark.createDataFrame([node("f", "File"), node("m", "Module"), node("c", "Class"), *[node(f"x{i}", "Method") for i in range(200)]], NODES)
    links = [("f", "m"), ("m", "c"), *[("c", f"x{i}") for i in range(200)]]
    edges = spark.createDataFrame([("R", a, b, "CONTAINS", "{}", i) for i, (a, b) in enumerate(links)], EDGES)
    walked = []
    above = traversal.nearest_above
    monkeypatch.setattr(traversal, "nearest_above", lambda ids, parents, targets: walked.append(parents.count()) or above(ids, parents, targets))
    row = Navigator(nodes, edges).get_documentation_context("c").first()
    assert (row["parent"], row["file"], row["module"], len(row["children"])) == ("m", "f", "m", 200)
    assert walked == [2, 2]
