"""Registered queries that run the operators from file scan to chunks, catalog and answers, and their SQL twins."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import catalog, chunks, diagram, gram_index, rag, resolve, symbols, traversal, vector_index
from loomgraph.session import shared_dir, stored
from loomgraph.sources import files as scanned
from loomgraph.sources import file_source, vector_store
from loomgraph.streaming import status

from .code_graph import REPO, SQL_FILES, SQL_GRAPH, SQL_REFERENCES, code
from .trade_graph import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


# -- scan --------------------------------------------------------------------------------------------

_SCANNED = """
k_doc AS (
  SELECT source AS repository_id, CASE doc_id % 5 WHEN 0 THEN 'node_modules/d' WHEN 1 THEN './src/d' ELSE 'lib/d' END || doc_id || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.go' END AS path, text
  FROM documents WHERE text IS NOT NULL),
k_kept AS (SELECT repository_id, regexp_replace(path, '^[.]/', '') AS path, text FROM k_doc WHERE path NOT LIKE 'node_modules/%')"""


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source's repository: what a listing gives, with bytes as contents."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    folder = F.when(F.col("doc_id") % 5 == 0, "node_modules/d").when(F.col("doc_id") % 5 == 1, "./src/d").otherwise("lib/d")
    ending = F.when(F.col("doc_id") % 3 == 0, ".py").when(F.col("doc_id") % 3 == 1, ".md").otherwise(".go")
    path = F.concat(folder, "doc_id", ending)
    rows = docs.select("source", path.alias("path"), scanned.normalized(path).alias("relative"), F.encode("text", "UTF-8").alias("content"), F.lit(None).cast("timestamp").alias("modificationTime"))
    return rows.withColumn("length", F.octet_length("content").cast("bigint")).filter(~scanned.ignored(F.col("relative")))


@query(f"""
WITH {_SCANNED}
SELECT repository_id, path, right(path, 3) AS extension, CASE right(path, 3) WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' ELSE 'go' END AS language,
  octet_length(encode(text))::BIGINT AS size, row_number() OVER (PARTITION BY repository_id ORDER BY path) - 1 AS ord, sha256(text) AS content_sha256
FROM k_kept""")
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata, place and whole text of every file that a scan keeps."""
    rows = scanned.file_table(_scan(spark, sf_dir), F.col("source"))
    return rows.select(REPO, "path", "extension", "language", "size", "ord", F.sha2("content", 256).alias("content_sha256"))


@query(ORACLE_SQL["file_scan"])
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents laid out as files and listed folder by folder, ignored ones never opened."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    folder = F.when(F.col("doc_id") % 5 == 0, "node_modules/d").when(F.col("doc_id") % 5 == 1, "./src/d").otherwise("lib/d")
    ending = F.when(F.col("doc_id") % 3 == 0, ".py").when(F.col("doc_id") % 3 == 1, ".md").otherwise(".go")
    root = f"{shared_dir(spark)}/laid-out-{uuid.uuid4().hex}"
    file_source.lay_out(docs.select("source", F.concat(folder, "doc_id", ending).alias("path"), F.encode("text", "UTF-8").alias("content")), root)
    rows = scanned.file_table(file_source.scan_folders(spark, root, repositories=True), F.col("source"))
    return rows.select(REPO, "path", "extension", "language", "size", "ord", F.sha2("content", 256).alias("content_sha256"))


@query(f"""
WITH {_SCANNED}
SELECT repository_id, path FROM k_kept WHERE right(path, 3) IN ('.py', '.go') AND text <> ''""")
def parse_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in a language that has a parser, with some content."""
    return scanned.parseable(scanned.file_table(_scan(spark, sf_dir), F.col("source"))).select(REPO, "path")


# -- symbols -----------------------------------------------------------------------------------------


@query(f"WITH {SQL_FILES} SELECT repo AS repository_id, id, kind, parent, exported FROM k_sym")
def symbols_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).symbols.select(REPO, "id", "kind", "parent", "exported")


@query(f"WITH {SQL_FILES} SELECT repo AS repository_id, kind, count(*) AS n FROM k_sym GROUP BY ALL")
def symbols_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols by kind; a repeated id would end the query."""
    return symbols.check_unique(code(spark, sf_dir).symbols).groupBy(REPO, "kind").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_FILES} SELECT repo AS repository_id, mid AS id FROM k_meth WHERE n = 7")
def symbols_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.find_by_name(code(spark, sf_dir).symbols, "m7").select(REPO, "id")


@query(f"WITH {SQL_REFERENCES} SELECT repo AS repository_id, file AS file_id, start_offset::INTEGER AS start_offset, mid AS scope FROM k_call")
def call_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost declaration around each call."""
    own = code(spark, sf_dir)
    return resolve.containing_scopes(own.records.filter("category = 'calls'"), own.symbols).select(REPO, "file_id", "start_offset", "scope")


# -- references --------------------------------------------------------------------------------------


@query(f"WITH {SQL_REFERENCES} SELECT repo AS repository_id, file AS file_id, module, target_file FROM k_imp")
def modules_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = code(spark, sf_dir)
    return resolve.resolve_modules(own.outer.filter("category = 'imports'"), own.files).select(REPO, "file_id", "module", "target_file")


@query(f"WITH {SQL_REFERENCES} SELECT repo AS repository_id, file AS file_id, local, imported, target_file, target FROM k_bind")
def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = code(spark, sf_dir)
    imports = resolve.resolve_modules(own.outer.filter("category = 'imports'"), own.files)
    return resolve.resolve_bindings(imports, own.outer, own.outer_symbols).select(REPO, "file_id", "local", "imported", "target_file", "target")


@query(f"""
WITH {SQL_REFERENCES} SELECT repo AS repository_id, 'o' || first AS name, file AS file_id, id AS target FROM k_class WHERE k = first AND c_custkey % 2 = 0""")
def default_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = code(spark, sf_dir)
    found = resolve.default_exports(own.outer, own.outer_symbols)
    return found.select(REPO, F.concat(F.lit("o"), F.substring_index("target", ".o", -1)).alias("name"), "file_id", "target")


@query(f"WITH {SQL_REFERENCES} SELECT repo AS repository_id, file AS file_id, start_offset::INTEGER AS start_offset, callee AS wanted, target FROM k_call")
def names_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each call refers to: a binding or its member, a definition of the file, or nothing."""
    own = code(spark, sf_dir)
    imports = resolve.resolve_modules(own.records.filter("category = 'imports'"), own.files)
    bound = resolve.resolve_bindings(imports, own.records, own.symbols)
    wanted = own.records.filter("category = 'calls'").select(REPO, "file_id", "start_offset", F.col("callee").alias("wanted"))
    return resolve.resolve_names(wanted, bound, own.symbols)


@query(f"WITH {SQL_REFERENCES} SELECT repo AS repository_id, src AS source, dst AS target, relation, meta AS metadata_json FROM k_rel")
def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).references[0].select(REPO, "source", "target", "relation", "metadata_json")


@query(f"""
WITH {SQL_REFERENCES}, r AS (
  SELECT 'import' AS reference, target_file IS NOT NULL AS ok FROM k_imp UNION ALL SELECT 'binding', target IS NOT NULL FROM k_bind
  UNION ALL SELECT 'export', true FROM k_class WHERE k = first AND c_custkey % 2 = 0 UNION ALL SELECT 'call', target IS NOT NULL FROM k_call
  UNION ALL SELECT 'extends', true FROM k_class WHERE status = 'O' AND before IS NOT NULL
  UNION ALL SELECT 'implements', unnest([true, false]) FROM k_class WHERE status = 'P')
SELECT reference, count(*) AS n, count(*) FILTER (ok) AS n_resolved FROM r GROUP BY reference""")
def references_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference, and how many of each kind have a target."""
    return code(spark, sf_dir).every_reference.groupBy("reference").agg(F.count("*").alias("n"), F.count_if("resolved").alias("n_resolved"))


# -- graph -------------------------------------------------------------------------------------------


@query(f"WITH {SQL_GRAPH} SELECT repo AS repository_id, id, type, name, exported FROM k_nodes")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).navigator_of().nodes.select(REPO, "id", "type", "name", "exported")


@query(f"WITH {SQL_GRAPH} SELECT repo AS repository_id, src, dst, relation, meta AS metadata_json FROM k_edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).navigator.edges.select(REPO, "src", "dst", "relation", "metadata_json")


@query(f"WITH {SQL_GRAPH} SELECT id, type, name FROM k_nodes WHERE id IN ('repository:R1', 'dir:n2', 'dir:n24')")
def nodes_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point look-up with an id that doesn't exist."""
    return code(spark, sf_dir).navigator_of().get_nodes(["repository:R1", "dir:n2", "dir:n24", "dir:n25"]).select("id", "type", "name")


@query(f"WITH {SQL_GRAPH} SELECT repo AS repository_id, id, type, name FROM k_nodes WHERE type IN ('Repository', 'Directory', 'File', 'Module')")
def structure_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = code(spark, sf_dir).navigator_of()
    rows = nav.get_repository().unionByName(nav.get_directories()).unionByName(nav.get_files()).unionByName(nav.get_modules())
    return rows.select(REPO, "id", "type", "name")


@query(f"""
WITH {SQL_GRAPH}, q AS (SELECT min(bare) AS bare FROM k_class)
SELECT id, type, name FROM k_nodes WHERE id = (SELECT 'module:' || bare FROM q) OR id IN (SELECT id FROM k_class WHERE k = first AND bare = (SELECT bare FROM q))""")
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module by its qualified name and a class by its id."""
    own = code(spark, sf_dir)
    nav = own.navigator_of()
    bare = own.symbols.filter("kind = 'class'").agg(F.min(F.substring_index("id", ".o", 1))).first()[0]
    first = own.symbols.filter((F.col("kind") == "class") & (F.substring_index("id", ".o", 1) == bare)).agg(F.min(F.substring_index("id", ".o", -1).cast("bigint"))).first()[0]
    return nav.get_symbol_by_qualified_name(bare).unionByName(nav.get_symbol(f"{bare}.o{first}")).select("id", "type", "name")


@query(f"WITH {SQL_GRAPH} SELECT repo AS repository_id, src, dst FROM k_edges WHERE relation = 'EXPORTS'")
def edges_of_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).outer_navigator_of("EXPORTS").search_by_relation("EXPORTS").select(REPO, "src", "dst")


@query(f"WITH {SQL_GRAPH} SELECT repo AS repository_id, src AS id, dst AS neighbor FROM k_edges WHERE relation = 'IMPLEMENTS'")
def implemented_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = code(spark, sf_dir).outer_navigator_of("IMPLEMENTS")
    return nav.get_implemented_interfaces(nav.search_by_type("Class")).select(REPO, "id", "neighbor")


@query(f"WITH {SQL_GRAPH} SELECT repo AS repository_id, mid AS id, 'file:' || file AS container FROM k_meth")
def containing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = code(spark, sf_dir).navigator_of("CONTAINS", "DECLARES")
    return nav.get_containing_file(nav.search_by_type("Method")).select(REPO, "id", "container")


_MODULES = "SELECT repo AS repository_id, 'module:' || module AS id FROM k_files"


@query(f"WITH {SQL_GRAPH} {_MODULES} WHERE path NOT IN (SELECT file FROM k_imp WHERE target_file IS NOT NULL)")
def leaf_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).outer_navigator_of("CONTAINS", "DECLARES", "IMPORTS").get_leaf_components().select(REPO, "id")


@query(f"WITH {SQL_GRAPH} {_MODULES} WHERE path NOT IN (SELECT target_file FROM k_imp WHERE target_file IS NOT NULL)")
def root_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).outer_navigator_of("CONTAINS", "DECLARES", "IMPORTS").get_root_components().select(REPO, "id")


@query(f"WITH {SQL_GRAPH} SELECT DISTINCT repo AS repository_id, 'file:' || target_file AS id FROM k_imp WHERE target_file IS NOT NULL")
def imported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).outer_navigator_of("IMPORTS").get_internal_dependencies().select(REPO, "id")


@query(f"WITH {SQL_GRAPH} SELECT count(*) AS n FROM k_nodes WHERE type = 'ExternalDependency'")
def external_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None: packages have no node of their own."""
    return code(spark, sf_dir).navigator_of().get_external_dependencies().agg(F.count("*").alias("n"))


@query(f"""
WITH RECURSIVE {SQL_GRAPH}, ext AS (SELECT src, dst FROM k_rel WHERE relation = 'EXTENDS'),
r AS (SELECT id, id AS ancestor, 0 AS depth FROM k_class UNION ALL SELECT r.id, dst, depth + 1 FROM r JOIN ext ON src = ancestor)
SELECT id, ancestor, depth FROM r""")
def class_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class with all that it extends."""
    nav = code(spark, sf_dir).outer_navigator_of("EXTENDS")
    return nav.get_inheritance_tree(nav.search_by_type("Class")).select("id", "ancestor", "depth")


@query(f"""
WITH RECURSIVE {SQL_GRAPH}, ext AS (SELECT src, dst FROM k_rel WHERE relation = 'EXTENDS'),
r AS (SELECT id, 0 AS level FROM k_class UNION ALL SELECT dst, level + 1 FROM r JOIN ext ON src = id)
SELECT id, max(level) AS level FROM r GROUP BY id""")
def class_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes in topological order: none comes before what extends it."""
    own = code(spark, sf_dir)
    nav = own.outer_navigator_of("EXTENDS")
    return traversal.topological_levels(nav.search_by_type("Class"), nav.iterate_edges(("EXTENDS",))).select("id", "level")


@query(f"""
WITH RECURSIVE {SQL_GRAPH}, ext AS (SELECT src, dst FROM k_rel WHERE relation = 'EXTENDS'),
r AS (SELECT id, id AS head, 0 AS level FROM k_class WHERE id NOT IN (SELECT dst FROM ext) UNION ALL SELECT dst, head, level + 1 FROM r JOIN ext ON src = r.id)
SELECT r.id, level, row_number() OVER (PARTITION BY h.repo ORDER BY level, h.file, h.i) - 1 AS place FROM r JOIN k_class h ON h.id = r.head""")
def class_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order itself: a class after all that extend it, in the order of Kahn's queue."""
    nav = code(spark, sf_dir).outer_navigator_of("EXTENDS")
    classes = nav.search_by_type("Class")
    return traversal.topological_order(classes, nav.edges, ("EXTENDS",)).select("id", "level", "place")


@query(f"""
WITH {SQL_GRAPH} SELECT 'caller' AS role, repo AS repository_id, dst AS id, src AS neighbor FROM k_edges WHERE relation = 'CALLS' GROUP BY ALL
UNION ALL SELECT 'child', repo, src, dst FROM k_edges WHERE relation = 'CONTAINS' GROUP BY ALL
UNION ALL SELECT 'dependent', repo, dst, src FROM k_edges WHERE relation IN ('IMPORTS', 'CALLS', 'EXTENDS', 'IMPLEMENTS') GROUP BY ALL
UNION ALL SELECT 'parent', repo, id, parent FROM k_sym WHERE parent IS NOT NULL AND kind IN ('class', 'method')""")
def adjacent_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers, dependents and children of all nodes, and parents of classes and methods, from stored adjacency."""
    nav = code(spark, sf_dir).navigator.indexed()
    every = nav.node_ids()
    held = nav.get_parent(nav.nodes.filter("type in ('Class', 'Method')")).withColumnRenamed("parent", "neighbor")
    asked = {"caller": nav.get_callers(every), "child": nav.get_children(every).withColumnRenamed("child", "neighbor"), "dependent": nav.get_dependents(every), "parent": held}
    rows = [found.select(F.lit(role).alias("role"), REPO, "id", "neighbor") for role, found in asked.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query(f"""
WITH RECURSIVE {SQL_GRAPH}, e AS (SELECT src, dst FROM k_edges WHERE relation IN ('CONTAINS', 'CALLS', 'EXTENDS')),
r AS (SELECT id AS start, id, 0 AS depth FROM k_class WHERE k % 20 = 0 UNION SELECT start, dst, depth + 1 FROM r JOIN e ON src = r.id WHERE depth < 3)
SELECT start, id, min(depth) AS depth FROM r GROUP BY ALL""")
def class_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every twentieth class reaches in three steps, each for itself."""
    nav = code(spark, sf_dir).navigator_of("CONTAINS", "CALLS", "EXTENDS")
    starts = nav.search_by_type("Class").filter(F.substring_index("id", ".o", -1).cast("bigint") % 20 == 0)
    return nav.distances(starts, 3, ("CONTAINS", "CALLS", "EXTENDS")).select("start", "id", "depth")


@query(f"""
WITH {SQL_GRAPH}, l AS (
  SELECT repo, unnest(['digraph CodeKnowledgeGraph {{', '  graph [rankdir="LR", bgcolor="#ffffff", fontname="Arial"];',
    '  node [style="filled", fillcolor="#ffffff", fontname="Arial", penwidth="1.5"];', '  edge [fontname="Arial", fontsize="10", color="#64748b"];']) AS line FROM (SELECT DISTINCT repo FROM k_files)
  UNION ALL SELECT DISTINCT repo, '}}' FROM k_files
  UNION ALL SELECT repo, '  "' || src || '" -> "' || dst || '" [label="' || relation || '"];' FROM k_edges)
SELECT repo AS repository_id, line, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT repo, 'nodes', count(*) FROM k_nodes GROUP BY repo""")
def dot_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code graph's DOT text, written in order to part files and read back: its lines, those of nodes counted."""
    nav = code(spark, sf_dir).navigator
    path = f"{shared_dir(spark)}/dot-{uuid.uuid4().hex}"
    diagram.write_dot(nav.nodes, nav.edges, path)
    line = F.when(F.col("value").startswith('  "') & ~F.col("value").contains('" -> "'), "nodes").otherwise(F.col("value"))
    return spark.read.text(path).groupBy(REPO, line.alias("line")).agg(F.count("*").alias("n"))


_CALL_REACH = f"""{SQL_GRAPH},
e AS (SELECT src, dst FROM k_edges WHERE relation IN ('CONTAINS', 'CALLS') AND contains(src, '.o') AND NOT starts_with(src, 'module:')),
reach AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM reach JOIN e ON src = b),
comp AS (SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""


@query(f"WITH RECURSIVE {_CALL_REACH} SELECT id, component FROM comp WHERE component IN (SELECT component FROM comp GROUP BY component HAVING count(*) > 1)")
def call_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and methods that reach each other through calls and what they hold."""
    found = code(spark, sf_dir).navigator_of("CONTAINS", "CALLS").strongly_connected_components(("CONTAINS", "CALLS"))
    several = found.groupBy(REPO, "component").agg(F.count("*").alias("n")).filter("n > 1")
    return found.join(several, [REPO, "component"], "left_semi").select("id", "component")


@query(f"WITH RECURSIVE {_CALL_REACH} SELECT component, string_agg(id, ',' ORDER BY id) AS members FROM comp GROUP BY component HAVING count(*) > 1")
def call_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).navigator_of("CONTAINS", "CALLS").find_cycles(("CONTAINS", "CALLS")).select("component", F.array_join("members", ",").alias("members"))


@query(f"""
WITH RECURSIVE {_CALL_REACH}, x AS (SELECT e.src, e.dst, e.relation FROM k_edges e WHERE e.relation IN ('CONTAINS', 'CALLS')),
l AS (SELECT coalesce(a.component, src) AS src, coalesce(b.component, dst) AS dst FROM x LEFT JOIN comp a ON a.id = src LEFT JOIN comp b ON b.id = dst)
SELECT DISTINCT src, dst FROM l WHERE src <> dst""")
def call_condensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code graph with each group of nodes that call each other as one."""
    nav = code(spark, sf_dir).navigator_of("CONTAINS", "CALLS")
    # Only edges are asked for: no component's members are gathered and numbered.
    parts = stored(nav.strongly_connected_components(("CONTAINS", "CALLS")), "condensed")
    return traversal.between_components(nav.iterate_edges(("CONTAINS", "CALLS")), parts).select("src", "dst").distinct()


# -- architecture ------------------------------------------------------------------------------------

_UNITS = f"""{SQL_GRAPH},
k_file_module AS (SELECT repo, path, 'module:' || module AS unit FROM k_files),
k_unit AS (
  SELECT s.repo, s.id, m.unit FROM k_sym s JOIN k_file_module m ON m.path = s.file AND m.repo = s.repo
  UNION ALL SELECT repo, id, id FROM k_nodes WHERE type IN ('Repository', 'Directory')),
k_between AS (
  SELECT x.repo, x.unit AS src, y.unit AS dst, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations
  FROM k_rel e JOIN k_unit x ON x.repo = e.repo AND x.id = e.src JOIN k_unit y ON y.repo = e.repo AND y.id = e.dst
  WHERE relation <> 'EXPORTS' AND x.unit <> y.unit GROUP BY ALL)"""


@query(f"WITH {_UNITS} SELECT repo AS repository_id, id, unit FROM k_unit")
def arch_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The module that stands for each node."""
    return diagram.units(code(spark, sf_dir).navigator_of("CONTAINS", "DECLARES")).select(REPO, "id", "unit")


@query(f"WITH {_UNITS} SELECT repo AS repository_id, src, dst, relations FROM k_between")
def arch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole architecture; the node cap is above all."""
    _, edges = diagram.build_diagram(code(spark, sf_dir).file_navigator, max_nodes=1 << 30)
    return edges.select(REPO, "src", "dst", F.array_join("relations", ",").alias("relations"))


@query(f"""
WITH {_UNITS}, n AS (
  SELECT repo, unit, row_number() OVER (PARTITION BY repo ORDER BY unit) AS i FROM (
    SELECT repo, src AS unit FROM k_between UNION SELECT repo, dst FROM k_between UNION SELECT repo, unit FROM k_file_module))
SELECT b.repo AS repository_id, src, dst, relations FROM k_between b
WHERE EXISTS (SELECT 1 FROM n WHERE n.repo = b.repo AND unit = src AND i <= 80) AND EXISTS (SELECT 1 FROM n WHERE n.repo = b.repo AND unit = dst AND i <= 80)""")
def arch_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a diagram of each repository shows: its first 80 units and the edges between them."""
    _, edges = diagram.build_diagram(code(spark, sf_dir).file_navigator)
    return edges.select(REPO, "src", "dst", F.array_join("relations", ",").alias("relations"))


@query(f"""
WITH RECURSIVE {_UNITS}, start AS (SELECT 'file:' || bare || ext AS id FROM k_cust WHERE c_custkey = 2),
e AS (SELECT src, dst, relation FROM k_rel WHERE relation <> 'EXPORTS'), u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
r AS (SELECT id, 0 AS depth FROM start UNION SELECT b, depth + 1 FROM r JOIN u ON a = r.id WHERE depth < 2),
i AS (SELECT src, dst, relation FROM e WHERE src IN (SELECT id FROM r) AND dst IN (SELECT id FROM r))
SELECT x.unit AS src, y.unit AS dst, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations
FROM i JOIN k_unit x ON x.id = src JOIN k_unit y ON y.id = dst WHERE x.unit <> y.unit GROUP BY ALL""")
def arch_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What surrounds customer 2's file, two steps around."""
    own = code(spark, sf_dir)
    scope = own.files.filter(F.col("path").rlike("/c2[.](js|py)$")).first()["path"]
    _, edges = diagram.build_diagram(own.navigator_of("CONTAINS", "DECLARES", *diagram.ARCHITECTURE), f"file:{scope}", 2)
    return edges.select("src", "dst", F.array_join("relations", ",").alias("relations"))


# -- chunks ------------------------------------------------------------------------------------------

_CHUNKS = f"""{SQL_GRAPH},
k_src AS (
  SELECT repo, file, id, 'o' || k AS name, c.bare AS parent_id, split_part(c.bare, '/', 2) AS parent_symbol, 'class' AS kind, i * 1000 AS start_offset, 'public' AS visibility,
         'class o' || k || CASE WHEN large THEN repeat(chr(10), 251) ELSE '' END AS source FROM k_class c WHERE NOT large
  UNION ALL SELECT repo, file, mid, 'm' || n, id, 'o' || k, 'method', i * 1000 + 10 + n * 100, CASE WHEN flag = 'A' THEN 'private' ELSE 'public' END, 'm' || n || '()' FROM k_meth WHERE large),
k_chunk AS (
  SELECT *, 'chunk:' || left(sha256(repo || ':' || id || ':' || kind), 32) AS chunk_id,
         'Repository: ' || repo || chr(10) || 'File: ' || file || chr(10) || 'Parent: ' || parent_symbol || chr(10) || 'Symbol: ' || name || chr(10) || chr(10) || source AS content FROM k_src)"""


def _chunks(spark: SparkSession, sf_dir: str, linked: bool = True) -> DataFrame:
    """Chunks; the graph is needed for the neighbours that they list only."""
    own = code(spark, sf_dir)
    return chunks.build_chunks(own.symbols, own.records, own.navigator if linked else None)


@query(f"""
WITH {_CHUNKS} SELECT chunk_id AS id, kind AS chunk_type, id AS symbol_id, name AS symbol_name, parent_symbol, content, start_offset::INTEGER AS start_offset, visibility,
  sha256(source) AS content_hash FROM k_chunk""")
def chunks_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small classes, and the methods of large ones."""
    rows = _chunks(spark, sf_dir, linked=False)
    return rows.select("id", "chunk_type", "symbol_id", "symbol_name", "parent_symbol", "content", "start_offset", F.col("metadata.visibility").alias("visibility"), F.col("metadata.content_hash").alias("content_hash"))


@query(f"""
WITH {_CHUNKS} SELECT repo AS repository_id, id AS symbol_id, row_number() OVER (PARTITION BY repo ORDER BY start_offset, id) - 1 AS place FROM k_chunk""")
def chunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every chunk in its repository."""
    rows = _chunks(spark, sf_dir, linked=False).select("symbol_id", "start_offset", F.struct("metadata.repository_id").alias("metadata"))
    return chunks.ordered(rows).select(REPO, "symbol_id", "place")


def _listed(where: str, a: str = "src", b: str = "dst") -> str:
    return f"(SELECT string_agg(DISTINCT {b}, ',' ORDER BY {b}) FROM k_edges e WHERE {where} AND e.{a} = c.id)"


@query(f"""
WITH {_CHUNKS} SELECT chunk_id AS id,
  (SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM k_edges e WHERE relation = 'IMPORTS' AND e.src = 'file:' || c.file) AS imports,
  {_listed("relation = 'CALLS'")} AS calls, {_listed("relation = 'CALLS'", 'dst', 'src')} AS called_by, {_listed("relation = 'EXTENDS'")} AS inherits,
  {_listed("relation = 'IMPLEMENTS'")} AS implements, {_listed("relation = 'CONTAINS'")} AS children FROM k_chunk c""")
def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours that each chunk lists."""
    names = ("imports", "calls", "called_by", "inherits", "implements", "children")
    return _chunks(spark, sf_dir).select("id", *[F.array_join(f"metadata.{n}", ",").alias(n) for n in names])


def _stored_twice(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The path and schema of a store to which chunks were written twice, the second time the classes, changed."""
    embedded = rag.embed_chunks(_chunks(spark, sf_dir).drop("start_offset"), rag.hashing_embedder(8))
    path, schema = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", vector_store.schema_of(embedded)
    vector_store.write_upsert(spark, path, embedded)
    # The store has them by now: no other copy is kept.
    held = vector_store.read(spark, path, schema, 1).filter("chunk_type = 'class'").select(*embedded.columns)
    vector_store.write_upsert(spark, path, held.withColumn("content", F.concat("content", F.lit("!"))))
    return path, schema


@query(f"WITH {_CHUNKS} SELECT repo AS repository_id, count(*) AS n FROM k_chunk GROUP BY repo")
def chunks_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks embedded, written to a store twice, and counted as they are there."""
    path, schema = _stored_twice(spark, sf_dir)
    return vector_store.read(spark, path, schema).groupBy(REPO).agg(F.countDistinct("id").alias("n"))


@query(f"""
WITH {_CHUNKS} SELECT 2 AS version, repo AS repository_id, chunk_id AS id, sha256(content || CASE WHEN kind = 'class' THEN '!' ELSE '' END) AS content_sha256, 8 AS size FROM k_chunk
UNION ALL SELECT 1, repo, chunk_id, sha256(content), 8 FROM k_chunk""")
def chunk_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds after the second write, and what a reader of the first version still sees."""
    path, schema = _stored_twice(spark, sf_dir)
    rows = [vector_store.read(spark, path, schema, v).select(F.lit(v).alias("version"), REPO, "id", F.sha2("content", 256).alias("content_sha256"), F.size("embedding").alias("size")) for v in (1, 2)]
    return rows[0].union(rows[1])


_LETTERS = "etaoinsr"


def _letter_counts(texts: list[str]) -> np.ndarray:
    """An embedder whose vectors SQL can tell: how often a text holds each of eight letters."""
    return np.array([[t.count(c) for c in _LETTERS] for t in texts], dtype=np.float32).reshape(len(texts), len(_LETTERS))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an embedded chunk of its source's repository."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    name = F.concat(F.lit("doc"), F.col("doc_id"))
    meta = F.struct(F.col("source").alias("repository_id"), F.concat(name, F.lit(".txt")).alias("file_path"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"))
    rows = docs.select(name.alias("id"), name.alias("symbol_id"), F.lit("function").alias("symbol_type"), name.alias("symbol_name"), F.col("text").alias("content"), meta.alias("metadata"), F.lit(None).cast("array<float>").alias("embedding"))
    return rag.embed_chunks(rows, _letter_counts)


_SQL_LETTERS = "[" + ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in _LETTERS) + "]"


@query(f"SELECT 'doc' || doc_id AS id, array_to_string({_SQL_LETTERS}, ',') AS vector FROM documents WHERE text IS NOT NULL")
def chunks_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of every document, number by number."""
    return _told(spark, sf_dir).select("id", F.array_join(F.transform("embedding", lambda x: x.cast("bigint").cast("string")), ",").alias("vector"))


# -- retrieval ---------------------------------------------------------------------------------------


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, (1 + list_cosine_similarity(v.e, q.e)) / 2 AS score FROM v, v q WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, round(score, 5) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS place FROM s) WHERE place <= 5""")
def vector_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors to every twentieth one."""
    vectors = table(spark, sf_dir, "embeddings")
    found = rag.search_many(vectors, vectors.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "place")


_QUESTION = "where are nations stored"


@query(f"""
WITH v AS (SELECT 'doc' || doc_id AS id, text, {_SQL_LETTERS}::DOUBLE[] AS e FROM documents WHERE text IS NOT NULL AND source = (SELECT min(source) FROM documents)),
q AS (SELECT {_SQL_LETTERS}::DOUBLE[] AS e FROM (SELECT '{_QUESTION}' AS text)),
s AS (SELECT id, text, round((1 + list_cosine_similarity(v.e, q.e)) / 2, 5) AS score FROM v, q WHERE list_sum(v.e) > 0 ORDER BY (1 + list_cosine_similarity(v.e, q.e)) / 2 DESC, id LIMIT 5)
SELECT '{_QUESTION}' AS question, row_number() OVER (ORDER BY score DESC, id) - 1 AS place, id AS chunk_id, score, id || '.txt' AS file_path, len(string_split(text, chr(10))) AS end_line,
  'seen ' || (SELECT count(*) FROM s) AS answer FROM s""")
def question_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question put to one source's documents, from the search over all of them to the parsed reply, with what it rests on."""
    first = table(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    reply = lambda prompt: json.dumps({"answer": f"seen {prompt.count('CHUNK_ID: ')}"})
    told = rag.answer(_told(spark, sf_dir), _QUESTION, first or "none", _letter_counts, reply)
    rows = told.select("question", F.col("parsed.answer").alias("answer"), F.posexplode("chunks").alias("place", "c"))
    return rows.select("question", F.col("place").cast("bigint").alias("place"), F.col("c.id").alias("chunk_id"), F.round("c.score", 5).alias("score"), F.col("c.file_path").alias("file_path"), F.col("c.end_line").cast("bigint").alias("end_line"), "answer")


def _index(spark: SparkSession, sf_dir: str, group: str | None = None) -> vector_index.VectorIndex:
    return vector_index.build(table(spark, sf_dir, "embeddings"), f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", "vec_id", "embedding", group)


@query(ORACLE_SQL["vector_search_all"])
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the index, every list probed."""
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0")
    found = vector_index.search(_index(spark, sf_dir), asked, 5, "vec_id", "embedding", share=1.0)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "place")


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, (1 + list_cosine_similarity(v.e, q.e)) / 2 AS score FROM v JOIN v q USING (label) WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, round(score, 5) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS place FROM s) WHERE place <= 5""")
def vector_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query within its own label, as a question is asked within a repository; every list of the label probed."""
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0")
    found = vector_index.search(_index(spark, sf_dir, "label"), asked, 5, "vec_id", "embedding", "label", share=1.0)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "place")


@query("SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every twentieth vector finds nine tenths of its five nearest, when no more lists are probed than the fit asks for."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0")
    found = vector_index.search(_index(spark, sf_dir), asked, 5, "vec_id", "embedding")
    exact = rag.search_many(vectors, asked, "vec_id", "embedding", 5)
    return vector_index.recall(found, exact, "vec_id").select("n_queries", (F.col("recall") >= 0.9).alias("enough"))


@query(r"""
SELECT doc_id, text AS answer, round(n_chars / 100000.0, 6) AS confidence, 'chunk:' || doc_id AS chunk_id, source || '.txt' AS file_path, 'doc' || doc_id AS symbol_name, 1 AS start_line, n_chars::INTEGER AS end_line, 0 AS n_followup
FROM documents WHERE text IS NOT NULL""")
def answers_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in JSON with their sources, read back."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    source = F.struct(
        F.concat(F.lit("chunk:"), "doc_id").alias("chunkId"), F.concat("source", F.lit(".txt")).alias("filePath"), F.concat(F.lit("doc"), "doc_id").alias("symbolName"), F.lit(1).alias("startLine"), F.col("n_chars").alias("endLine")
    )
    reply = F.to_json(F.struct(F.col("text").alias("answer"), F.round(F.col("n_chars") / 100000, 6).alias("confidence"), F.array(source).alias("sources"), F.array().cast("array<string>").alias("followup_questions")))
    parsed = rag.parse_answers(docs.select("doc_id", reply.alias("reply")))
    first = F.col("parsed.sources")[0]
    return parsed.select(
        "doc_id", "parsed.answer", "parsed.confidence", first["chunkId"].alias("chunk_id"), first["filePath"].alias("file_path"), first["symbolName"].alias("symbol_name"),
        first["startLine"].alias("start_line"), first["endLine"].alias("end_line"), F.size("parsed.followup_questions").alias("n_followup"),
    )


# -- search by trigrams ------------------------------------------------------------------------------


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth part's name as a query: as it is, padded, or (every 200th) abbreviated so that no name holds its trigrams; and a blank one."""
    key, name = F.col("p_partkey"), F.col("p_name")
    short = F.concat(F.substring(name, 1, 2), F.substring(name, -2, 2), F.when(key % 400 == 0, "zz").otherwise(""))
    asked = F.when(key % 200 == 0, short).when(key % 40 == 0, F.concat(F.lit("  "), F.upper(name), F.lit("\t "))).when(key == 20, " ").otherwise(name)
    return table(spark, sf_dir, "part").filter(key % 20 == 0).select(F.lit("T").alias(REPO), key.alias("query_id"), asked.alias("query"))


@query("""
WITH n AS (SELECT DISTINCT p_name AS name FROM part),
a AS (
  SELECT p_partkey AS query_id, lower(CASE WHEN p_partkey % 200 = 0 THEN left(p_name, 2) || right(p_name, 2) || CASE WHEN p_partkey % 400 = 0 THEN 'zz' ELSE '' END ELSE p_name END) AS q
  FROM part WHERE p_partkey % 20 = 0 AND p_partkey <> 20),
q AS (SELECT DISTINCT q, list_transform(range(1, length(q) - 1), lambda i: substr(q, i, 3)) AS grams FROM a),
p AS (SELECT q, name, len(list_filter(grams, lambda g: NOT contains(name, g))) = 0 AS pooled FROM q, n),
s AS (
  SELECT q, name, pooled, list_reduce(list_prepend({'c': '', 'at': 0, 'n': 0, 'ok': true}, list_transform(range(1, length(q) + 1), lambda i: {'c': substr(q, i, 1), 'at': 0, 'n': 0, 'ok': true})),
      lambda s, x: {'c': '', 'at': (s['at'] + strpos(substr(name, s['at'] + 1), x['c']))::INTEGER, 'n': (s['n'] + 10 - least(strpos(substr(name, s['at'] + 1), x['c']) - 1, 9))::INTEGER,
                    'ok': s['ok'] AND strpos(substr(name, s['at'] + 1), x['c']) > 0}) AS walk
  FROM p WHERE pooled OR q NOT IN (SELECT q FROM p WHERE pooled)),
t AS (
  SELECT q, name, CASE WHEN name = q THEN 1000 WHEN starts_with(name, q) THEN 800 - length(name) WHEN contains(name, q) THEN 600 - length(name) WHEN walk['ok'] THEN walk['n'] ELSE 0 END AS score FROM s),
r AS (
  SELECT q, p_partkey, name, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, name, p_partkey) AS place
  FROM t JOIN part ON p_name = name WHERE score > 0)
SELECT query_id, 'part:' || p_partkey AS id, name, score, place FROM a JOIN r USING (q) WHERE place <= 20""")
def fuzzy_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many fuzzy queries answered from posting lists."""
    parts = table(spark, sf_dir, "part").select(F.lit("T").alias(REPO), F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    index = gram_index.build(parts, f"{shared_dir(spark)}/grams-{uuid.uuid4().hex}")
    return gram_index.search_many(index, _asked(spark, sf_dir), 20, binary=True).drop(REPO)


# -- jobs --------------------------------------------------------------------------------------------


_FOLLOWS = " ".join(f"WHEN '{a}' THEN status IN ({', '.join(repr(b) for b in sorted(after))})" for a, after in status.FOLLOWS.items())


@query(f"""
WITH RECURSIVE e AS (
  SELECT user_id, CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'CLONING' WHEN 'click' THEN 'PARSING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END AS status,
         CASE WHEN event_id % 3 = 0 THEN floor(value * 3)::INTEGER END AS progress, ts FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, status) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e),
r AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 'NOT_STARTED' AS status, 0 AS progress, TIMESTAMP '1970-01-01' AS moment, 0::BIGINT AS counted, n FROM o
  UNION ALL
  SELECT user_id, i, CASE WHEN ok THEN status ELSE was END, CASE WHEN NOT ok THEN had WHEN progress IS NOT NULL THEN progress
           ELSE CASE status WHEN 'QUEUED' THEN 0 WHEN 'CLONING' THEN 5 WHEN 'PARSING' THEN 45 ELSE 100 END END, CASE WHEN ok THEN ts ELSE moment END, counted + ok::BIGINT, n
  FROM (SELECT o.user_id, o.i, o.n, o.status, o.progress, o.ts, r.status AS was, r.progress AS had, r.moment, r.counted, coalesce(o.progress BETWEEN 0 AND 100, true) AND o.ts > r.moment AND ok0 AS ok
        FROM (SELECT o.*, r.status AS was0, CASE r.status {_FOLLOWS.replace("status IN", "o.status IN")} END AS ok0 FROM o JOIN r ON r.user_id = o.user_id AND o.i = r.i + 1) o JOIN r ON r.user_id = o.user_id AND o.i = r.i + 1))
SELECT user_id::VARCHAR AS repository_id, status, progress, counted, n - counted AS ignored FROM r WHERE i = n""")
def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports on runs, played in three parts through the stream of status machines: what holds in the end."""
    kinds = {"signup": "QUEUED", "view": "CLONING", "click": "PARSING", "purchase": "COMPLETED", "error": "FAILED"}
    name = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").cast("string").alias("repository_id"), name.alias("status"), F.when(F.col("event_id") % 3 == 0, F.floor(F.col("value") * 3).cast("int")).alias("progress"), F.col("ts").cast("timestamp").alias("at"))
    where = f"{shared_dir(spark)}/status-{uuid.uuid4().hex}"
    cuts = events.agg(F.percentile_approx("ts", [0.33, 0.67], 1000)).first()[0]
    parts = [F.col("at") < cuts[0], (F.col("at") >= cuts[0]) & (F.col("at") < cuts[1]), F.col("at") >= cuts[1]]
    for part in parts:
        rows.filter(part).write.mode("append").parquet(f"{where}/events")
        status.run(spark, f"{where}/events", f"{where}/told", f"{where}/state", "3650 days", timedelta(days=3650))
    return status.latest(spark.read.parquet(f"{where}/told")).drop("at")


@query("""
SELECT 'handled' AS outcome, count(*) AS n FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders)
UNION ALL SELECT 'poisoned', count(*) FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)
UNION ALL SELECT 'not a job', count(*) FROM nation""")
def jobs_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders published as jobs, with a message that isn't one for each nation, and what becomes of them in the stream."""
    import uuid

    from loomgraph.session import shared_dir
    from loomgraph.streaming import jobs

    top = f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders")
    poison = orders.agg(F.min("o_orderkey")).first()[0]
    jobs.publish(spark, top, orders.select(F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderkey").alias("repository_id"), F.lit("1").alias("installation_id"), F.lit("url").alias("clone_url")))
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")).write.mode("append").text(f"{top}/repo-analysis")

    def handle(batch: DataFrame) -> None:
        if not batch.filter(F.col("repository_id") == poison).isEmpty():
            raise RuntimeError("poisoned")
        batch.write.mode("append").parquet(f"{top}/handled")

    jobs.consume(spark, top, f"{top}/seen", f"{top}/dead", handle).awaitTermination()
    handled = spark.read.parquet(f"{top}/handled").select(F.lit("handled").alias("outcome"))
    dead = spark.read.parquet(f"{top}/dead").select(F.col("error").alias("outcome"))
    return handled.unionByName(dead).groupBy("outcome").agg(F.count("*").alias("n"))


# -- catalog -----------------------------------------------------------------------------------------


@query("""
SELECT p_partkey AS github_repository_id, p_name AS name, p_brand || '/' || p_name AS full_name, p_brand AS owner, 'https://github.com/' || p_brand || '.git' AS clone_url,
  CASE WHEN p_size > 25 THEN 'private' ELSE 'public' END AS visibility, 'main' AS default_branch, CASE WHEN p_size % 2 = 0 THEN p_type END AS language, p_size AS size, 0 AS n_topics FROM part""")
def repository_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an API would list repositories, as catalog rows."""
    api = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("/"), "p_name").alias("full_name"), F.struct(F.col("p_brand").alias("login")).alias("owner"),
        F.concat(F.lit("https://github.com/"), "p_brand", F.lit(".git")).alias("clone_url"), F.lit(None).cast("string").alias("html_url"), (F.col("p_size") > 25).alias("private"),
        F.lit(None).cast("string").alias("default_branch"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("language"), F.lit(None).cast("array<string>").alias("topics"), F.col("p_size").alias("size"),
    )
    rows = catalog.map_repository(api)
    return rows.select("github_repository_id", "name", "full_name", "owner", "clone_url", "visibility", "default_branch", "language", "size", F.size("topics").alias("n_topics"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as repositories of their customers, a third of them failed."""
    failed = F.col("o_orderkey") % 3 == 0
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("github_repository_id"), F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"), F.lit(100).alias("progress"), F.when(failed, "boom").alias("last_error")
    )


@query("""
SELECT o_custkey AS owner, o_orderkey AS github_repository_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'QUEUED' WHEN o_orderkey % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 100 END AS progress, CASE WHEN o_orderkey % 6 = 3 THEN 'boom' END AS last_error FROM orders""")
def retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after a retry of every second repository: what failed is queued, its error cleared."""
    known = _catalog(spark, sf_dir)
    again = catalog.retry(known, known.filter("github_repository_id % 2 = 0").select(*catalog.KEYS))
    return catalog.merge(known, again, catalog.KEYS, assigned=("status", "progress", "last_error"))


@query("""SELECT o_orderkey AS github_repository_id, CASE WHEN o_orderkey % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)""")
def status_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repositories of the last owner."""
    known = _catalog(spark, sf_dir)
    owner = known.agg(F.max("owner")).first()[0]
    return catalog.status_of(known, owner).select("github_repository_id", "status")


@query("""
SELECT event_type, CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN 25 WHEN 'purchase' THEN 100 END AS progress, count(*) AS n FROM events GROUP BY ALL""")
def worker_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as states that a worker reports."""
    state = F.when(F.col("event_type") == "view", "CLONING").when(F.col("event_type") == "click", "SCANNING").when(F.col("event_type") == "purchase", "COMPLETED")
    rows = table(spark, sf_dir, "events").select("event_type", catalog.progress_of(state).alias("progress"))
    return rows.groupBy("event_type", "progress").agg(F.count("*").alias("n"))


@query("""
WITH u AS (SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
c AS (SELECT c_custkey AS installation_id FROM customer)
SELECT coalesce(installation_id, user_id) AS installation_id, event_type AS state FROM c FULL JOIN u ON user_id = installation_id""")
def installations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as installations, upserted with the latest of each user's events."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("installation_id"), F.lit(None).cast("string").alias("state"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("installation_id"), F.col("event_type").alias("state"), "ts", "event_id")
    return catalog.upsert_installations(known, events, ["ts", "event_id"])
