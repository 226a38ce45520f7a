"""From micro-repositories to symbols, relations, graph and chunks."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import chunks, diagram, symbols
from loomgraph.plans.knowledge import build_knowledge
from loomgraph.sources.files import scan

FILES = {
    "src/util.js": "export function helper(a, b) {\n  return a + b;\n}\nexport const LIMIT = 3;\nfunction hidden() { return helper(1, 2); }\n",
    "src/base.js": "export default class Base {\n  run(x) { return x; }\n  static async make() { return new Base(); }\n}\n",
    "src/main.js": (
        "import Base from './base.js';\nimport { helper as h, LIMIT } from './util';\nimport * as util from './util.js';\nimport 'side';\n"
        "class Child extends Base implements One {\n  async go(a, b = 2) {\n    h(a, b);\n    return util.helper(a, 1);\n  }\n}\n"
        "export function start() {\n  const c = new Child();\n  function inner() { h(1, 2); }\n  return c?.go?.(1);\n}\nh(0, 0);\n"
    ),
    "src/types.ts": "export interface One { a: string }\nenum Color { Red }\nexport type Name = string;\nexport function f(p: number): string { return 'x'; }\n",
    "lib/tool.py": "import os\n\n\nclass Tool:\n    def work(self, n: int) -> int:\n        return helper_two(n)\n\n\ndef helper_two(n):\n    return n\n",
    "lib/App.java": 'import java.util.List;\npublic class App {\n  private int total = 0;\n  public int add(int a) { return sum(a); }\n  static int sum(int a) { return a; }\n}\n',
    "lib/main.go": 'package main\n\nimport (\n  "fmt"\n  "os"\n)\n\ntype Box struct {\n  n int\n}\n\nfunc (b Box) Size() int { return b.n }\n\nfunc main() {\n  x := Box{}\n  fmt.Println(x.Size())\n}\n',
    "lib/lib.rs": "use std::fmt;\npub struct Point { x: i32 }\ntrait Shape { fn area(&self) -> i32; }\nfn area() -> i32 { let z = square(2); z }\nfn square(a: i32) -> i32 { a * a }\n",
    "node_modules/x.js": "function no() {}\n",
    "logo.png": "not text",
    "empty.js": "",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (top / "big.js").write_text("x" * (1024 * 1024 + 1))
    (top / "edge.py").write_text("#" * (1024 * 1024))
    (top / "bin.js").write_bytes(b"a\0b")
    return str(top)


@pytest.fixture(scope="module")
def known(spark, root):
    return build_knowledge(scan(spark, root, "r"))


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_scan_leaves_out_ignored_files_and_large_or_binary_texts(spark, root):
    files = {r["path"]: r for r in scan(spark, root, "r").collect()}
    assert "node_modules/x.js" not in files and "logo.png" not in files
    assert files["big.js"]["content"] is None and files["bin.js"]["content"] is None
    assert len(files["edge.py"]["content"]) == 1024 * 1024
    assert files["src/types.ts"]["language"] == "typescript" and files["lib/tool.py"]["extension"] == ".py"
    assert [r for r in sorted(files)] == sorted(files, key=lambda p: files[p]["ord"])


def test_records_of_each_language(known):
    got = rows(known.records.filter("category not in ('calls', 'exports', 'imports')"), "path", "category", "name")
    assert {
        ("src/util.js", "functions", "helper"), ("src/util.js", "variables", "LIMIT"), ("src/base.js", "classes", "Base"), ("src/base.js", "methods", "run"), ("src/base.js", "methods", "make"),
        ("src/main.js", "classes", "Child"), ("src/main.js", "methods", "go"), ("src/types.ts", "interfaces", "One"), ("src/types.ts", "enums", "Color"), ("src/types.ts", "typeAliases", "Name"),
        ("lib/tool.py", "classes", "Tool"), ("lib/tool.py", "functions", "work"), ("lib/App.java", "classes", "App"), ("lib/App.java", "methods", "add"), ("lib/App.java", "variables", "total"),
        ("lib/main.go", "classes", "Box"), ("lib/main.go", "methods", "Size"), ("lib/main.go", "functions", "main"), ("lib/lib.rs", "classes", "Point"), ("lib/lib.rs", "interfaces", "Shape"), ("lib/lib.rs", "functions", "square"),
    } <= got
    make = known.records.filter("name = 'make'").first()
    assert make["is_static"] and make["is_async"] and make["source"].startswith("static async make()")
    f = known.records.filter("path = 'src/types.ts' and name = 'f' and category = 'functions'").first()
    assert f["return_type"] == "string" and [tuple(p) for p in f["parameters"]] == [("p", "number")]
    kinds = rows(known.records.filter("category = 'imports' and path = 'src/main.js'"), "module", "kind")
    assert kinds == {("./base.js", "default"), ("./util", "named"), ("./util.js", "namespace"), ("side", "side-effect")}


def test_symbols_have_scoped_ids(known):
    got = rows(known.symbols.filter("file_id = 'src/main.js'"), "id", "kind", "parent")
    assert ("file:src/main.js", "file", None) in got and ("module:src/main", "module", "file:src/main.js") in got
    assert ("src/main.Child", "class", "module:src/main") in got and ("src/main.Child.go", "method", "src/main.Child") in got
    assert ("src/main.start.inner", "function", "src/main.start") in got
    exported = rows(known.symbols.filter("exported"), "id")
    assert {("src/util.helper",), ("src/util.LIMIT",), ("src/base.Base",), ("src/main.start",)} <= exported and ("src/main.Child",) not in exported
    assert known.symbols.filter("id = 'src/util.LIMIT'").first()["kind"] == "constant"
    assert symbols.check_unique(known.symbols).count() == known.symbols.count()


def test_relations(known):
    got = rows(known.relations, "source", "target", "relation")
    assert {
        ("file:src/main.js", "file:src/base.js", "IMPORTS"), ("file:src/main.js", "file:src/util.js", "IMPORTS"), ("src/main.Child", "src/base.Base", "EXTENDS"), ("src/main.Child", "src/types.One", "IMPLEMENTS"),
        ("src/main.Child.go", "src/util.helper", "CALLS"), ("src/main.start.inner", "src/util.helper", "CALLS"), ("src/util.hidden", "src/util.helper", "CALLS"), ("file:src/util.js", "src/util.helper", "EXPORTS"),
        ("lib/tool.Tool.work", "lib/tool.helper_two", "CALLS"), ("lib/lib.area", "lib/lib.square", "CALLS"),
    } <= got
    assert not any(s.startswith("module:") and r == "CALLS" for s, _, r in got)  # a call outside any scope makes no edge
    unresolved = rows(known.references.filter("not resolved and reference = 'import'"), "name")
    assert ("side",) in unresolved


def test_graph_and_queries(known):
    nav = known.navigator
    assert rows(nav.get_callers("src/util.helper"), "neighbor") >= {("src/main.Child.go",), ("src/util.hidden",)}
    assert rows(nav.get_containing_module("src/main.start.inner"), "container") == {("module:src/main",)}
    assert rows(nav.get_entry_points(), "id") >= {("src/main.start",)}
    assert rows(nav.get_parent("dir:src"), "parent") == {("repository:r",)}
    assert rows(nav.get_internal_dependencies(), "id") == {("file:src/base.js",), ("file:src/util.js",)}
    assert ("module:src/main",) in rows(nav.get_root_components(), "id") and ("module:src/util",) in rows(nav.get_leaf_components(), "id")
    assert nav.get_external_dependencies().count() == 0
    shown, edges = diagram.build_diagram(nav)
    drawn = {(r["src"], r["dst"], tuple(r["relations"])) for r in edges.collect()}
    assert ("module:src/main", "module:src/util", ("CALLS", "IMPORTS")) in drawn
    text = diagram.to_mermaid(shown, edges).first()["mermaid"]
    assert text.startswith("```mermaid\nflowchart LR\n  N0[") and text.endswith("```")
    dot = diagram.to_dot(nav.nodes, nav.edges).first()["dot"]
    assert dot.startswith("digraph CodeKnowledgeGraph {") and 'label="File\\\\nmain.js"' in dot and dot.endswith("}")


def test_chunks(known):
    got = {r["symbol_id"]: r for r in known.chunks().collect()}
    assert "src/main.Child" in got and "src/main.Child.go" not in got  # a small class stands for its methods
    assert "src/util.LIMIT" in got and "src/main.start.inner" in got
    helper = got["src/util.helper"]
    assert helper["content"].startswith("Repository: r\nFile: src/util.js\nParent: util\nSymbol: helper\n\nfunction helper")
    assert helper["metadata"]["called_by"] == ["src/main.Child.go", "src/main.start.inner", "src/util.hidden"] and helper["metadata"]["calls"] is None
    large = {r["symbol_id"] for r in known.chunks(characters=10).collect()}
    assert "src/main.Child" not in large and "src/main.Child.go" in large


def test_large_rule_is_strict(spark):
    long = spark.createDataFrame([("x" * 12000,), ("x" * 12001,), ("\n" * 249,), ("\n" * 250,), ("😀" * 6001,)], "t string")
    assert [r[0] for r in long.select(chunks.is_large(F.col("t"))).collect()] == [False, True, False, True, True]


def test_files_of_one_name(spark):
    files = spark.createDataFrame([("r", "a.js", "javascript", 0), ("r", "a.ts", "typescript", 1)], "repository_id string, path string, language string, ord bigint")
    assert rows(symbols.file_symbols(files).filter("kind = 'module'"), "id") == {("module:a",), ("module:a.ts",)}
    with pytest.raises(Exception, match="duplicate symbol id"):
        symbols.file_symbols(files, strict=True).collect()
