"""Diagrams of modules are made from the files that refer to each other: no symbol or node of a declaration is made."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import diagram, resolve, symbols
from loomgraph.plans import code_graph, code_queries
from loomgraph.schemas import AST_RECORDS


@pytest.fixture
def fresh():
    code_graph.forget()
    yield
    code_graph.forget()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("name", ["arch_edges", "arch_shown"])
def test_a_diagram_of_modules_makes_no_symbols(spark, data, fresh, monkeypatch, name):
    def never(*_):
        raise AssertionError("symbols made")

    monkeypatch.setattr(symbols, "extract_symbols", never)
    monkeypatch.setattr(resolve, "resolve", lambda *a: never())
    found = rows_of(code_queries.QUERIES[name](spark, data))
    monkeypatch.undo()
    code_graph.forget()
    limit = {"max_nodes": 1 << 30} if name == "arch_edges" else {}
    _, edges = diagram.build_diagram(code_graph.code(spark, data).navigator, **limit)
    assert found == rows_of(edges.select("repository_id", "src", "dst", F.array_join("relations", ","))) and found


def test_files_refer_to_each_other_as_their_symbols_do(spark):
    """Names that shadow, bindings that are overridden or lead nowhere, calls in no scope, classes without a name."""
    kinds = [part.split(" ", 1)[0] for part in AST_RECORDS.replace("imported:string,local", "x").replace("name:string,type", "x").split(", ")]

    def record(file, category, order, **fields):
        return tuple((fields | {"repository_id": "r", "file_id": file, "path": file, "language": "javascript", "category": category, "ord": order}).get(c) for c in kinds)

    def scope(start, end):
        return {"start_line": 1, "end_line": 2, "start_offset": start, "end_offset": end}

    def call(file, order, name, start):
        return record(file, "calls", order, callee=name, start_offset=start, end_offset=start + 2)

    made = [
        record("a.js", "imports", 1, module="./b", bindings=[("B", "x"), ("default", "d"), ("*", "all"), ("No", "no"), ("B", "twice")]),
        record("a.js", "imports", 2, module="./c", bindings=[("No", "twice")]),
        record("a.js", "classes", 3, name="A", extends="x", implements=["d.I", "no", "Far"], exported=True, **scope(0, 100)),
        record("a.js", "functions", 4, name="f", **scope(10, 50)),
        record("a.js", "classes", 5, name="anonymous", extends="Only", **scope(200, 300)),
        record("a.js", "classes", 6, name="B", **scope(400, 500)),
        *[call("a.js", 10 + i, name, 20 + i) for i, name in enumerate(["all.f", "x.m", "twice", "B", "Shared", "nowhere", "A", "x"])],
        call("a.js", 30, "Only", 250), call("a.js", 31, "Only", 600), call("a.js", 32, "Beyond", 99),
        record("b.js", "classes", 1, name="B", exported=True, **scope(0, 100)),
        record("b.js", "methods", 2, name="m", **scope(10, 20)),
        record("b.js", "classes", 3, name="D", extends="A", **scope(200, 300)),
        record("b.js", "exports", 4, name="D", kind="default"),
        record("b.js", "classes", 5, name="Shared", exported=True, **scope(400, 500)),
        call("b.js", 9, "Shared", 12),
        record("c.js", "functions", 1, name="Shared", exported=True, **scope(0, 100)),
        record("c.js", "functions", 2, name="Far", exported=True, **scope(200, 300)),
        record("c.js", "functions", 3, name="Only", exported=True, **scope(400, 500)),
        record("c.js", "functions", 4, name="Beyond", exported=True, **scope(600, 700)),
        record("c.js", "enums", 5, name="E", **scope(800, 900)), call("c.js", 6, "D", 850), call("c.js", 7, "A.m", 450),
    ]
    records = spark.createDataFrame(made, AST_RECORDS)
    files = spark.createDataFrame([("r", f, "javascript", i) for i, f in enumerate(["a.js", "b.js", "c.js"])], "repository_id string, path string, language string, ord bigint")
    every = symbols.extract_symbols(files, records)
    relations, _ = resolve.resolve(files, records, every)
    of = every.select("repository_id", "id", "file_id")
    for end in ("source", "target"):
        relations = relations.join(of.select("repository_id", F.col("id").alias(end), F.concat(F.lit("file:"), "file_id").alias(f"{end}_file")), ["repository_id", end])
    whole = relations.filter("source_file <> target_file").select("source_file", "target_file", "relation").distinct()
    found = resolve.between_files(files, records)
    assert rows_of(found.select("source", "target", "relation")) == rows_of(whole)
    assert ("file:a.js", "file:c.js", "IMPLEMENTS") in rows_of(whole) and len(rows_of(whole)) == 9
    places = records.filter("category = 'calls'").select("repository_id", "file_id", "callee", "start_offset", "end_offset")
    by = ["repository_id", "file_id", "start_offset", "end_offset"]
    assert rows_of(resolve.within_scopes(places, records).select(*by)) == rows_of(resolve.containing_scopes(places, every).select(*by))
