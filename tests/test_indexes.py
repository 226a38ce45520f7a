"""Stored indexes, places, sweeps and orders against brute force."""

import itertools
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import adjacency, diagram, gram_index, rag, ranks, resolve, search, symbols, traversal, vector_index
from loomgraph.operators.navigator import Navigator
from loomgraph.schemas import EDGES, NODES, SYMBOLS


def folder(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"


# -- vectors -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, one of which holds a third of all vectors; null, zero and repeated vectors; groups, null among them."""
    draw = np.random.default_rng(2)
    middle = draw.standard_normal((12, 16)) * 3
    own = np.where(draw.random(900) < 0.33, 0, draw.integers(0, 12, 900))
    rows = [(i, (middle[c] + draw.standard_normal(16)).tolist(), f"g{i % 3}") for i, c in enumerate(own)]
    rows += [(900, rows[5][1], "g0"), (901, None, "g0"), (902, [0.0] * 16, "g0"), (903, rows[6][1], None)]
    return spark.createDataFrame(rows, "id bigint, embedding array<double>, g string").repartition(4)


def same(found, exact):
    pick = lambda df: {(r["query_id"], r["place"], r["id"], round(r["score"], 9)) for r in df.collect()}
    assert pick(found) == pick(exact)


def test_every_list_gives_the_exact_result(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 40)
    monkeypatch.setattr(vector_index, "BLOCK", 5)
    asked = vectors.filter("id % 20 = 0")
    path = folder(spark)
    vector_index.build(vectors, path)
    index = vector_index.load(spark, path)
    assert index.lists.count() == 902 and index.sizes.agg(F.max("parts")).first()[0] > 1
    same(vector_index.search(index, asked, 5, share=1.0), rag.search_many(vectors, asked, "id", "embedding", 5))
    grouped = vector_index.build(vectors, folder(spark), group="g")
    found = vector_index.search(grouped, asked, 5, group="g", share=1.0)
    for g in ("g0", "g1", "g2"):
        own = vectors.filter(F.col("g") == g)
        same(found.join(asked.filter(F.col("g") == g).select(F.col("id").alias("query_id")), "query_id"), rag.search_many(own, asked.filter(F.col("g") == g), "id", "embedding", 5))


def test_recall_with_few_lists(spark, vectors):
    index = vector_index.build(vectors, folder(spark))
    asked = vectors.filter("id % 20 = 0")
    probed = vector_index._probes(index, asked.select(F.col("id").alias("query_id"), F.lit("").alias("group"), F.col("embedding").alias("vector")), 100, index.share)
    row = vector_index.recall(vector_index.search(index, asked, 5), rag.search_many(vectors, asked, "id", "embedding", 5)).first()
    assert row["n_queries"] == 46 and row["recall"] >= 0.9 and index.share < 0.5
    assert probed.groupBy("query_id").count().agg(F.avg("count")).first()[0] < 0.6 * len(index.centroids)


def test_an_index_of_nothing(spark, vectors):
    index = vector_index.build(vectors.limit(0), folder(spark))
    assert vector_index.search(index, vectors, 5).count() == 0
    assert vector_index.search(vector_index.build(vectors, folder(spark)), vectors.limit(0), 5).count() == 0


# -- trigrams ----------------------------------------------------------------------------------------


def scored(query, name):
    v = name.lower()
    if v == query:
        return 1000
    if v.startswith(query):
        return 800 - len(v)
    if query in v:
        return 600 - len(v)
    at = total = 0
    for c in query:
        to = v.find(c, at)
        if to < 0:
            return 0
        total += 10 - min(to - at, 9)
        at = to + 1
    return total


def grams(value):
    flat = " ".join(value.lower().split())
    return {flat[i : i + 3] for i in range(len(flat) - 2)} if len(flat) >= 3 else {flat}


def brute(nodes, query, limit):
    q = query.lower().strip()
    if not q:
        return []
    pool = [n for n in nodes if n[1] is not None and grams(q) <= grams(n[1])] or [n for n in nodes if n[1] is not None]
    best = sorted(((-scored(q, n[1]), n[1], n[2], n[0]) for n in pool if scored(q, n[1]) > 0))[:limit]
    return [(i, name, -s) for s, name, _, i in best]


def test_fuzzy_search_from_lists(spark):
    draw = random.Random(1)
    parts = ["get", "User", "set", " Name", "index", "Foo", "a", "É", "  ", "Bar\t", "ab"]
    names = ["".join(draw.choices(parts, k=draw.randrange(1, 5))) for _ in range(150)] + ["index"] * 60 + [None, "", "ab", "foo"]
    nodes = [(f"n{i}", name, i * 7 % 221) for i, name in enumerate(names)]
    frame = spark.createDataFrame([("r", *n) for n in nodes] + [("s", "other", "index", 0)], "repository_id string, id string, name string, ord bigint").repartition(3)
    asked = ["", "  ", " foo ", "FOO", "ab", "a", "index", "getuser", "user  name", "user name", "gsn", "zzz", "xiu", "é", None, "get\tuser", "foo"] + names[:25]
    queries = spark.createDataFrame([("r", i, q) for i, q in enumerate(asked)], "repository_id string, query_id int, query string")
    index = gram_index.build(frame, folder(spark))
    found = {}
    for r in gram_index.search_many(index, queries, 7, binary=True).orderBy("query_id", "place").collect():
        found.setdefault(r["query_id"], []).append((r["id"], r["name"], r["score"]))
    own = frame.filter("repository_id = 'r'")
    for i, q in enumerate(asked):
        assert found.get(i, []) == (brute(nodes, q, 7) if q is not None else []), q
    for q in ("", "  ", " foo ", "ab", "getuser", "gsn", "user  name"):
        assert [(r["id"], r["name"], r["score"]) for r in search.fuzzy(own, q, 7, binary=True).collect()] == brute(nodes, q, 7), q
    assert gram_index.search_many(index, queries.limit(0)).count() == 0


def test_text_of_names(spark):
    row = spark.range(1).select(text.trimmed(F.lit("  a b\t\n")).alias("t"), text.collapsed(F.lit(" A   b\tC ")).alias("c")).first()
    assert tuple(row) == ("a b", "a b c")


# -- places ------------------------------------------------------------------------------------------


def test_places_go_on_over_partitions(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None]) if i % 3 else "hot", draw.randrange(40) if i % 11 else None, i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, k int, i int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.ranked(frame, ["g"], ["k", "i"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("hot", "a", "b", None):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [(r["k"], r["i"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])] == [r[1:] for r in want]
        assert {r["place_total"] for r in got if r["g"] == g} == {len(want)}
    assert ranks.ranked(frame.limit(0), ["g"], ["k"]).count() == 0


# -- order -------------------------------------------------------------------------------------------


def kahn(ids, edges, relations):
    """The queue itself: ids in their order, edges (src, dst, relation) in theirs."""
    ahead = {}
    for i in ids:
        own = [e for e in edges if e[0] == i]
        turn = relations or list(dict.fromkeys(e[2] for e in own))
        ahead[i] = list(dict.fromkeys(e[1] for r in turn for e in own if e[2] == r))
    degree = {i: 0 for i in ids}
    for i in ids:
        for x in ahead[i]:
            if x in degree:
                degree[x] += 1
    order = [i for i in ids if not degree[i]]
    for i in order:
        for x in ahead[i]:
            if x in degree:
                degree[x] -= 1
                if not degree[x]:
                    order.append(x)
    return order


@pytest.mark.parametrize("relations", [None, ("CALLS", "IMPORTS")])
def test_topological_order_is_kahns(spark, relations):
    draw = random.Random(8)
    ids = [f"n{i}" for i in range(40)]
    draw.shuffle(ids)
    rank = {i: k for k, i in enumerate(sorted(ids, key=lambda i: draw.random()))}
    pairs = [(a, b, draw.choice(["IMPORTS", "CALLS", "USES"])) for a, b in itertools.permutations(ids, 2) if rank[a] < rank[b] and draw.random() < 0.06]
    pairs += [("n1", "n2", "CALLS"), ("n2", "n1", "CALLS"), pairs[0], ("n1", "gone", "CALLS"), ("n3", "n3", "IMPORTS")]
    draw.shuffle(pairs)
    nodes = spark.createDataFrame([("r", i, "Function", i, i, None, True, None, None, n) for n, i in enumerate(ids)], NODES)
    edges = spark.createDataFrame([("r", a, b, r, "{}", n) for n, (a, b, r) in enumerate(pairs)], EDGES)
    used = [p for p in pairs if relations is None or p[2] in relations]
    got = traversal.topological_order(nodes, edges, relations).collect()
    placed = sorted((r["place"], r["id"]) for r in got if r["place"] is not None)
    assert [i for _, i in placed] == kahn(ids, used, relations) and [p for p, _ in placed] == list(range(len(placed)))
    assert {r["id"] for r in got if r["unresolved"]} == set(ids) - {i for _, i in placed}


# -- scopes ------------------------------------------------------------------------------------------


def symbol_rows(spans):
    row = dict.fromkeys([p.strip().split(" ")[0] for p in SYMBOLS.replace("array<struct<name:string,type:string>>", "x").split(",")])
    return [tuple((row | {"repository_id": "r", "file_id": f, "id": i, "kind": k, "start_offset": s, "end_offset": e, "ord": n}).values()) for n, (f, i, k, s, e) in enumerate(spans)]


def test_innermost_scopes_by_a_sweep(spark):
    draw = random.Random(6)
    spans = [(f"f{draw.randrange(3)}", f"s{i}", draw.choice(["class", "function", "variable"]), a, a + draw.choice([0, 2, 5, 9, 30])) for i in range(120) for a in [draw.randrange(60)]]
    places = {(f"f{draw.randrange(4)}", a, a + draw.choice([0, 1, 4])) for a in (draw.randrange(70) for _ in range(200))}
    own = spark.createDataFrame(symbol_rows(spans), SYMBOLS).repartition(3)
    asked = spark.createDataFrame([("r", *p) for p in places] * 2, "repository_id string, file_id string, start_offset int, end_offset int")
    want = {}
    for f, a, b in places:
        around = [(s, e, -n, i) for n, (g, i, k, s, e) in enumerate(spans) if g == f and k != "variable" and s <= a and e >= b]
        if around:
            want[(f, a, b)] = max(around)[3]
    got = resolve.containing_scopes(asked, own).collect()
    assert {(r["file_id"], r["start_offset"], r["end_offset"]): r["scope"] for r in got} == want and len(got) == len(want)


def test_a_file_with_many_scopes_and_calls_is_read_once(spark):
    import time

    n = 10_000
    spans = [("f", "top", "class", 0, 100 * n)] + [("f", f"m{i}", "method", i * 100 + 1, i * 100 + 90) for i in range(n)]
    own = spark.createDataFrame(symbol_rows(spans), SYMBOLS)
    asked = spark.range(n).select(F.lit("r").alias("repository_id"), F.lit("f").alias("file_id"), (F.col("id") * 100 + 5).cast("int").alias("start_offset"), (F.col("id") * 100 + 20).cast("int").alias("end_offset"))
    begun = time.time()
    got = {r["start_offset"]: r["scope"] for r in resolve.containing_scopes(asked, own).collect()}
    assert got == {i * 100 + 5: f"m{i}" for i in range(n)} and time.time() - begun < 30
    plan = resolve.containing_scopes(asked, own)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_relations_are_ordered_by_file_then_step(spark):
    names = [f"f{i:04}.js" for i in range(300)]
    files = spark.createDataFrame([("r", p, "javascript", i) for i, p in enumerate(names)], "repository_id string, path string, language string, ord bigint")
    base = {"repository_id": "r"}
    rows = []
    for i, p in enumerate(names):
        own = base | {"file_id": p, "path": p}
        rows += [own | {"category": "exports", "kind": "default", "name": "A", "ord": i * 1_000_000 + 3}, own | {"category": "imports", "module": "./f0000", "ord": i * 1_000_000 + 9}]
        rows += [own | {"category": "classes", "name": "A", "extends": "A", "implements": ["A"], "start_offset": 0, "end_offset": 9, "ord": i * 1_000_000 + 1}]
    schema = "repository_id string, file_id string, path string, language string, category string, name string, kind string, module string, bindings array<struct<imported:string,local:string>>, extends string, implements array<string>, modifiers array<string>, parameters array<struct<name:string,type:string>>, return_type string, exported boolean, callee string, start_line int, end_line int, start_offset int, end_offset int, source string, ord bigint"
    columns = [p.strip().split(" ")[0] for p in schema.replace("imported:string,local", "x").replace("name:string,type", "x").split(",")]
    records = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)
    relations, _ = resolve.resolve(files, records, symbols.extract_symbols(files, records))
    got = [(r["source"].removeprefix("file:").split(".")[0], r["relation"]) for r in relations.orderBy("ord").collect()]
    assert got == [(p.split(".")[0], step) for p in names for step in ("IMPORTS", "EXPORTS", "EXTENDS", "IMPLEMENTS")]


# -- adjacency ---------------------------------------------------------------------------------------


def graph_of(spark, ids, pairs):
    nodes = spark.createDataFrame([("r", i, "Function", i, i, None, True, None, None, n) for n, i in enumerate(ids)], NODES)
    return nodes, spark.createDataFrame([("r", a, b, r, "{}", n) for n, (a, b, r) in enumerate(pairs)], EDGES)


@pytest.mark.parametrize("heavy", [20, 100_000])
def test_stored_adjacency_answers_alike(spark, heavy):
    draw = random.Random(4)
    ids = [f"n{i}" for i in range(60)]
    pairs = [(draw.choice(ids), draw.choice(ids), draw.choice(["CALLS", "IMPORTS", "CONTAINS"])) for _ in range(300)] + [("hub", i, "CALLS") for i in ids] + [(i, "hub", "CONTAINS") for i in ids]
    nodes, edges = graph_of(spark, [*ids, "hub"], pairs)
    plain = Navigator(nodes, edges)
    stored = Navigator(nodes, edges, {by: adjacency.store(edges, by, 4, heavy) for by in ("src", "dst")})
    assert (stored.adjacent["src"].heavy is not None) == (heavy == 20)
    asked = ["hub", "n1", "n2", "n3", "none"]
    for ask in (lambda n: n.get_callers(asked), lambda n: n.get_children(n.node_ids()), lambda n: n.get_dependents(asked), lambda n: n.get_related_symbols(asked), lambda n: n.get_parent(n.node_ids()), lambda n: n.edges_from(asked).select("src", "dst", "ord")):
        assert sorted(map(tuple, ask(stored).collect()), key=repr) == sorted(map(tuple, ask(plain).collect()), key=repr)


def test_questions_do_not_shuffle_stored_edges(spark):
    ids = [f"n{i}" for i in range(50)]
    nodes, edges = graph_of(spark, ids, [(a, b, "CALLS") for a in ids for b in ids[:5]])
    nav = Navigator(nodes, edges).indexed(4)
    for found in (nav.get_callers(nav.node_ids()), nav.get_dependents(nav.node_ids()), nav.get_children(nav.node_ids()), nav.parents()):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        lines = final.splitlines()
        scans = [i for i, line in enumerate(lines) if "edges_by_" in line and "Scan" in line]
        assert scans
        for at in scans:
            depth, above = lines[at].find("Scan"), []
            for line in reversed(lines[:at]):
                indent = len(line) - len(line.lstrip(" :+-"))
                if indent < depth:
                    depth = indent
                    above.append(line)
            assert not [line for line in above if "Exchange" in line], final


# -- strong components -------------------------------------------------------------------------------


def strong(ids, pairs):
    reach = {i: {i} for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a in reach and b in reach and not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    return {i: min(j for j in ids if j in reach[i] and i in reach[j]) for i in ids}


@pytest.mark.parametrize("seed", range(6))
def test_strong_components_of_chains_loops_and_random_graphs(spark, seed):
    draw = random.Random(seed)
    ids = [f"n{i:02}" for i in range(45)]
    order = draw.sample(ids, 45)
    pairs = [(draw.choice(ids), draw.choice(ids)) for _ in range(20 + 12 * seed)]
    chain = order[: 10 + seed]
    pairs += list(zip(chain, chain[1:], strict=False)) + [(chain[-1], chain[0])] * (seed % 2) + [(order[20], order[21]), (order[21], order[20])]
    nodes, edges = graph_of(spark, ids, [(a, b, "CALLS") for a, b in pairs])
    assert {r["id"]: r["component"] for r in traversal.strong_components(nodes, edges).collect()} == strong(ids, pairs)


def test_a_long_loop_takes_few_rounds(spark, monkeypatch):
    from loomgraph.session import Scratch

    n = 10_000
    draw = random.Random(0)
    order = draw.sample(range(n), n)
    rows = spark.createDataFrame([("r", f"n{a}", f"n{b}", "CALLS", "{}", i) for i, (a, b) in enumerate(zip(order, order[1:] + order[:1], strict=True))], EDGES)
    spurs = spark.createDataFrame([("r", f"n{order[0]}", "out", "CALLS", "{}", n), ("r", "in", f"n{order[5]}", "CALLS", "{}", n + 1), ("r", f"n{order[9]}", f"n{order[7]}", "CALLS", "{}", n + 2)], EDGES)
    nodes = spark.createDataFrame([("r", f"n{i}", "Function", "x", "x", None, True, None, None, i) for i in range(n)] + [("r", x, "Function", "x", "x", None, True, None, None, n) for x in ("in", "out")], NODES)
    written = []
    plain = Scratch.store
    monkeypatch.setattr(Scratch, "store", lambda self, df, label: written.append(label) or plain(self, df, label))
    for edges in (rows, rows.unionByName(spurs)):
        written.clear()
        got = {r["component"]: r["count"] for r in traversal.strong_components(nodes, edges).groupBy("component").count().collect()}
        assert got == {"n0": n, "in": 1, "out": 1}
        assert len([x for x in written if x in ("scc-way", "spread")]) <= 30


# -- distances, text in order ------------------------------------------------------------------------


@pytest.mark.parametrize("direction", ["outgoing", "both"])
def test_distances_of_many_starts(spark, direction):
    draw = random.Random(9)
    ids = [f"n{i}" for i in range(150)]
    pairs = [(draw.choice(ids), draw.choice(ids)) for _ in range(220)] + [("n0", i) for i in ids[:80]]
    nodes, edges = graph_of(spark, ids, [(a, b, "CALLS") for a, b in pairs])
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
        if direction == "both":
            ahead.setdefault(b, set()).add(a)
    want = set()
    for start in ids:
        seen, front = {start: 0}, [start]
        for depth in range(1, 4):
            front = sorted({x for i in front for x in ahead.get(i, ())} - set(seen))
            seen |= dict.fromkeys(front, depth)
        want |= {(start, i, d) for i, d in seen.items()}
    got = traversal.distances(nodes, edges, 3, direction).collect()
    assert len(got) == len(want) and {(r["start"], r["id"], r["depth"]) for r in got} == want
    assert {(r["start"], r["id"]) for r in traversal.distances(nodes.limit(1), edges, 0).collect()} == {("n0", "n0")}


def test_deep_walks_are_compacted(spark):
    ids = [f"n{i:02}" for i in range(30)]
    nodes, edges = graph_of(spark, ids, [(a, b, "EXTENDS") for a, b in zip(ids, ids[1:], strict=False)])
    assert {(r["id"], r["depth"]) for r in traversal.bfs(nodes.filter("id = 'n00'"), edges).collect()} == {(i, n) for n, i in enumerate(ids)}


def test_dot_text_in_part_files(spark):
    import glob

    ids = [f"n{i:03}" for i in range(200)]
    nodes, edges = graph_of(spark, ids, [(a, b, "CALLS") for a, b in zip(ids, ids[1:], strict=False)])
    path = folder(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        diagram.write_dot(nodes, edges, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(glob.glob(f"{path}/repository_id=r/part-*"))
    written = "".join(open(p).read() for p in parts).splitlines()
    assert len(parts) > 1 and written == diagram.to_dot(nodes, edges).first()["dot"].split("\n")
    numbered = diagram.numbered_dot(nodes, edges).orderBy("number").collect()
    assert [r["line"] for r in numbered] == written and [r["number"] for r in numbered] == list(range(len(written)))
