"""Graph queries over (nodes, edges).

Every method returns a DataFrame and takes one id, several, or a DataFrame (repository_id, id), so a
question about one node and about all nodes are the same plan.  Ids are unique within a repository,
and every join carries ``repository_id``.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import stored

from . import search, traversal
from .adjacency import Adjacency, store
from .graph import CALLS, CONTAINS, DECLARES, EXPORTS, EXTENDS, IMPLEMENTS, IMPORTS, READS, STRUCTURE, USES, WRITES

DEPENDENCIES = (IMPORTS, CALLS, EXTENDS, IMPLEMENTS, USES, READS, WRITES)
Ids = str | Iterable[str] | DataFrame
REPO = "repository_id"


class Navigator:
    """The 39 questions that can be asked of a knowledge graph."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, adjacent: dict[str, Adjacency] | None = None):
        self.nodes, self.edges, self.adjacent = nodes, edges, adjacent

    def indexed(self, buckets: int | None = None) -> Navigator:
        """The same questions over edges stored by source and by target, so that asking doesn't shuffle edges."""
        return Navigator(self.nodes, self.edges, {by: store(self.edges, by, buckets) for by in ("src", "dst")})

    # -- lookups -------------------------------------------------------------------------------

    def repository(self, repository_id: str) -> Navigator:
        """The same questions about one repository; prunes partitions of tables written by repository."""
        if self.adjacent is not None:
            raise ValueError("take the repository first, then index it")
        return Navigator(self.nodes.filter(F.col(REPO) == repository_id), self.edges.filter(F.col(REPO) == repository_id))

    def ids(self, of: Ids) -> DataFrame:
        if isinstance(of, DataFrame):
            return of.select(REPO, "id").distinct()
        wanted = [of] if isinstance(of, str) else list(of)
        return self.nodes.filter(F.col("id").isin(wanted)).select(REPO, "id")

    def get_node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def get_nodes(self, ids: Ids) -> DataFrame:
        """Nodes of the ids that exist."""
        return self.nodes.join(self.ids(ids), [REPO, "id"], "left_semi")

    def node_ids(self) -> DataFrame:
        return self.nodes.select(REPO, "id")

    def iterate_edges(self, relations: Iterable[str] | None = None) -> DataFrame:
        return self.edges if relations is None else self.edges.filter(F.col("relation").isin(list(relations)))

    def _met(self, by: str, ids: Ids, relations: Iterable[str] | None) -> list[DataFrame]:
        if self.adjacent is not None:
            return self.adjacent[by].met(self.ids(ids), relations)
        return [self.iterate_edges(relations).join(self.ids(ids).withColumnRenamed("id", by), [REPO, by], "left_semi")]

    def edges_from(self, ids: Ids, relations: Iterable[str] | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, self._met("src", ids, relations))

    def edges_to(self, ids: Ids, relations: Iterable[str] | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, self._met("dst", ids, relations))

    def neighbors(self, ids: Ids, relations: Iterable[str] | None = None, direction: str = "outgoing") -> DataFrame:
        """Distinct (repository_id, id, neighbor)."""
        parts = []
        for by, other, when in (("src", "dst", ("outgoing", "both")), ("dst", "src", ("incoming", "both"))):
            if direction in when:
                parts += [met.select(REPO, F.col(by).alias("id"), F.col(other).alias("neighbor")).distinct() for met in self._met(by, ids, relations)]
        found = reduce(DataFrame.unionByName, parts)
        # Parts of one direction have no id in common.
        return found.distinct() if direction == "both" else found

    def has_edge(self, pairs: DataFrame, relations: Iterable[str] | None = None) -> DataFrame:
        """Those of the pairs (repository_id, src, dst) that an edge joins in this direction."""
        return pairs.join(self.iterate_edges(relations), [REPO, "src", "dst"], "left_semi")

    def get_repository(self) -> DataFrame:
        return self.search_by_type("Repository")

    def get_directories(self) -> DataFrame:
        return self.search_by_type("Directory")

    def get_files(self) -> DataFrame:
        return self.search_by_type("File")

    def get_modules(self) -> DataFrame:
        return self.search_by_type("Module")

    def get_symbol(self, symbol_id: str) -> DataFrame:
        return self.get_node(symbol_id)

    def get_symbol_by_qualified_name(self, name: str) -> DataFrame:
        """The last node of that qualified name."""
        rows = self.nodes.filter(F.col("qualified_name") == name)
        return rows.groupBy(REPO).agg(F.max_by("id", "ord").alias("id")).join(self.nodes, [REPO, "id"])

    # -- structure -----------------------------------------------------------------------------

    def get_children(self, ids: Ids) -> DataFrame:
        return self.neighbors(ids, STRUCTURE).withColumnRenamed("neighbor", "child")

    def parents(self) -> DataFrame:
        """(repository_id, id, parent): the first parent of every node that has one."""
        if self.adjacent is not None and self.adjacent["dst"].heavy is None:
            held = self.adjacent["dst"].light.filter(F.col("relation").isin(list(STRUCTURE)))
        else:
            # Few edges share a node: summed up where they are read, a task would sort all that it reads of a file.
            held = self.iterate_edges(STRUCTURE).repartition(REPO, "dst")
        return held.groupBy(REPO, F.col("dst").alias("id")).agg(F.min_by("src", "ord").alias("parent"))

    def get_parent(self, ids: Ids) -> DataFrame:
        return self.parents().join(self.ids(ids), [REPO, "id"], "left_semi")

    def containing(self, node_type: str, ids: Ids | None = None) -> DataFrame:
        """(repository_id, id, container): the nearest node of that type at or above each node."""
        # Dealt by id first, for the same reason as edges in ``parents``.
        wanted = self.nodes.select(REPO, "id") if ids is None else self.ids(ids.repartition(REPO, "id") if isinstance(ids, DataFrame) else ids)
        return traversal.nearest_above(wanted, self.parents(), self.nodes.filter(F.col("type") == node_type).select(REPO, "id"))

    def get_containing_file(self, ids: Ids | None = None) -> DataFrame:
        return self.containing("File", ids)

    def get_containing_module(self, ids: Ids | None = None) -> DataFrame:
        return self.containing("Module", ids)

    # -- search --------------------------------------------------------------------------------

    def search_by_name(self, text: str, exact: bool = False, limit: int = 50) -> DataFrame:
        return search.by_name(self.nodes, text, exact, limit)

    def search_by_type(self, node_type: str) -> DataFrame:
        return self.nodes.filter(F.col("type") == node_type)

    def search_by_relation(self, relation: str) -> DataFrame:
        return self.edges.filter(F.col("relation") == relation)

    def search_by_path(self, text: str, limit: int = 50) -> DataFrame:
        return search.by_path(self.nodes, text, limit)

    def fuzzy_search(self, query: str, limit: int = 20) -> DataFrame:
        return search.fuzzy(self.nodes, query, limit)

    # -- dependencies --------------------------------------------------------------------------

    def get_dependencies(self, ids: Ids) -> DataFrame:
        return self.neighbors(ids, DEPENDENCIES)

    def get_dependents(self, ids: Ids) -> DataFrame:
        return self.neighbors(ids, DEPENDENCIES, "incoming")

    def get_imports(self, ids: Ids) -> DataFrame:
        return self.neighbors(ids, (IMPORTS,))

    def get_exports(self, ids: Ids) -> DataFrame:
        return self.neighbors(ids, (EXPORTS,))

    def get_calls(self, ids: Ids) -> DataFrame:
        return self.neighbors(ids, (CALLS,))

    def get_callers(self, ids: Ids) -> DataFrame:
        return self.neighbors(ids, (CALLS,), "incoming")

    def get_inheritance_tree(self, ids: Ids) -> DataFrame:
        """(repository_id, id, ancestor, depth): the first EXTENDS edge followed until it ends or returns."""
        first = self.iterate_edges((EXTENDS,)).groupBy(REPO, F.col("src").alias("id")).agg(F.min_by("dst", "ord").alias("base"))
        return traversal.follow(self.ids(ids), first)

    def get_implemented_interfaces(self, ids: Ids) -> DataFrame:
        return self.neighbors(ids, (IMPLEMENTS,))

    def get_related_symbols(self, ids: Ids) -> DataFrame:
        return self.neighbors(ids, None, "both")

    def get_subgraph(self, ids: Ids, depth: int | None = 1, relations: Iterable[str] | None = None, direction: str = "both") -> tuple[DataFrame, DataFrame]:
        """Nodes within ``depth`` steps of the ids, and the edges among them."""
        reached = self.bfs(ids, depth, relations, direction).select(REPO, "id").distinct()
        within = self.iterate_edges(relations)
        for end in ("src", "dst"):
            within = within.join(reached.withColumnRenamed("id", end), [REPO, end], "left_semi")
        return self.nodes.join(reached, [REPO, "id"], "left_semi"), within

    def get_neighbourhood(self, ids: Ids, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        return self.get_subgraph(ids, depth)

    def get_documentation_context(self, ids: Ids) -> DataFrame:
        """One row per node: parent, file, module, and sorted ids of its neighbours by role."""
        base = self.ids(ids)
        # Files and modules are looked for above the ids only, not above all nodes.
        parents = stored(self.parents(), "context-parents")
        held = traversal.lineage(base, parents, base.limit(0))
        there = base.unionByName(held.select(REPO, F.col("parent").alias("id"))).distinct()
        of_type = lambda kind: self.nodes.filter(F.col("type") == kind).select(REPO, "id").join(there, [REPO, "id"], "left_semi")
        one = {"parent": parents.join(base, [REPO, "id"], "left_semi")}
        one |= {kind.lower(): traversal.nearest_above(base, held, of_type(kind)).withColumnRenamed("container", kind.lower()) for kind in ("File", "Module")}
        many = {
            "children": self.get_children(base).withColumnRenamed("child", "neighbor"),
            "dependencies": self.get_dependencies(base),
            "dependents": self.get_dependents(base),
            "calls": self.get_calls(base),
            "callers": self.get_callers(base),
        }
        out = base
        for rows in one.values():
            out = out.join(rows, [REPO, "id"], "left")
        for name, rows in many.items():
            out = out.join(rows.groupBy(REPO, "id").agg(F.sort_array(F.collect_set("neighbor")).alias(name)), [REPO, "id"], "left")
            out = out.withColumn(name, F.coalesce(name, F.expr("cast(array() as array<string>)")))
        return out

    def get_public_api(self, ids: Ids) -> DataFrame:
        """Exported nodes at or under the ids."""
        below = self.bfs(ids, None, STRUCTURE).select(REPO, "id").distinct()
        return self.nodes.filter("exported").join(below, [REPO, "id"], "left_semi")

    def get_entry_points(self, types: Iterable[str] = ("Function", "Method"), exported_only: bool = True) -> DataFrame:
        """Exported functions and methods that nothing calls."""
        called = self.iterate_edges((CALLS,)).select(REPO, F.col("dst").alias("id"))
        rows = self.nodes.filter(F.col("type").isin(list(types)))
        return (rows.filter("exported") if exported_only else rows).join(called, [REPO, "id"], "left_anti")

    def _modules_of_files(self, files: DataFrame) -> DataFrame:
        """Modules whose parent is not among ``files`` (repository_id, id)."""
        modules = self.get_modules().join(self.parents(), [REPO, "id"], "left")
        return modules.join(files.withColumnRenamed("id", "parent"), [REPO, "parent"], "left_anti").drop("parent")

    def get_leaf_components(self) -> DataFrame:
        """Modules whose file imports nothing."""
        return self._modules_of_files(self.iterate_edges((IMPORTS,)).select(REPO, F.col("src").alias("id")))

    def get_root_components(self) -> DataFrame:
        """Modules whose file nothing imports."""
        return self._modules_of_files(self.iterate_edges((IMPORTS,)).select(REPO, F.col("dst").alias("id")))

    def get_external_dependencies(self) -> DataFrame:
        return self.search_by_type("ExternalDependency")

    def get_internal_dependencies(self) -> DataFrame:
        """Files that some file imports."""
        imported = self.iterate_edges((IMPORTS,)).select(REPO, F.col("dst").alias("id"))
        return self.get_files().join(imported, [REPO, "id"], "left_semi")

    # -- traversal -----------------------------------------------------------------------------

    def bfs(self, ids: Ids, depth: int | None = None, relations: Iterable[str] | None = None, direction: str = "outgoing") -> DataFrame:
        start = ids.select(REPO, "id").distinct() if isinstance(ids, DataFrame) else self.ids(ids)
        return traversal.bfs(start, self.iterate_edges(relations), depth, direction)

    def distances(self, ids: Ids, depth: int, relations: Iterable[str] | None = None, direction: str = "outgoing") -> DataFrame:
        """What each id reaches by itself, where ``bfs`` merges the starts."""
        return traversal.distances(self.ids(ids), self.iterate_edges(relations), depth, direction)

    def dfs(self, ids: Ids, depth: int | None = None, relations: Iterable[str] | None = None, direction: str = "outgoing") -> DataFrame:
        return traversal.dfs(self.ids(ids), self.iterate_edges(relations), depth, direction)

    def topological_order(self, relations: Iterable[str] | None = None) -> DataFrame:
        """Every node with its ``place`` in Kahn's order and its level."""
        return traversal.topological_order(self.nodes, self.edges, relations)

    def strongly_connected_components(self, relations: Iterable[str] | None = None) -> DataFrame:
        return traversal.strong_components(self.nodes, self.iterate_edges(relations))

    def find_connected_components(self, relations: Iterable[str] | None = None) -> DataFrame:
        return traversal.weak_components(self.nodes, self.iterate_edges(relations))

    def find_cycles(self, relations: Iterable[str] | None = None) -> DataFrame:
        return traversal.cycles(self.nodes, self.iterate_edges(relations))

    def collapse_scc(self, relations: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        return traversal.condensation(self.nodes, self.iterate_edges(relations))


__all__ = ["CONTAINS", "DECLARES", "DEPENDENCIES", "Navigator"]
