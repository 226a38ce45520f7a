"""Building the knowledge graph: nodes and edges from symbols and relations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.paths import prefixes

CONTAINS, IMPORTS, EXPORTS, CALLS, EXTENDS, IMPLEMENTS, DECLARES, USES, READS, WRITES = (
    "CONTAINS", "IMPORTS", "EXPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "DECLARES", "USES", "READS", "WRITES",
)
STRUCTURE = (CONTAINS, DECLARES)
# Node types by symbol kind.
NODE_TYPES = {
    "file": "File", "module": "Module", "class": "Class", "interface": "Interface", "enum": "Enum", "function": "Function",
    "method": "Method", "variable": "Variable", "constant": "Variable", "namespace": "Namespace", "type-alias": "TypeAlias",
}
_LATER = 1 << 40


def node_type(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NODE_TYPES.items() for x in pair])
    return F.coalesce(table[kind], F.lit("Symbol"))


def first_nodes(nodes: DataFrame) -> DataFrame:
    """The first definition of each id."""
    columns = [c for c in nodes.columns if c not in ("repository_id", "id")]
    first = nodes.groupBy("repository_id", "id").agg(F.min_by(F.struct(*columns), "ord").alias("first"))
    return first.select("repository_id", "id", *[F.col(f"first.{c}").alias(c) for c in columns])


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist, one for each (src, relation, dst, metadata): the first."""
    # Dealt by source, they are summed up and meet their source where they lie; few are equal, so summing up before saves nothing.
    first = edges.repartition("repository_id", "src").groupBy("repository_id", "src", "dst", "relation", "metadata_json").agg(F.min("ord").alias("ord"))
    ids = nodes.select("repository_id", "id")
    known = first.join(ids.withColumnRenamed("id", "src"), ["repository_id", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["repository_id", "dst"], "left_semi")
    return known.select("repository_id", "src", "dst", "relation", "metadata_json", "ord")


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    return symbols.select(
        "repository_id", "id", node_type(F.col("kind")).alias("type"), "name", "qualified_name", "file_id", "exported", "path", "language", "ord"
    )


def folder_nodes(files: DataFrame) -> DataFrame:
    """One row per folder above each file (repository_id, path, ord), not yet distinct."""
    rows = files.select("repository_id", F.explode(prefixes(F.col("path"))).alias("path"), (F.col("ord") + 2 * _LATER).alias("ord"))
    return rows.select(
        "repository_id",
        F.concat(F.lit("dir:"), "path").alias("id"),
        F.lit("Directory").alias("type"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("path").alias("qualified_name"),
        F.lit(None).cast("string").alias("file_id"),
        F.lit(False).alias("exported"),
        "path",
        F.lit(None).cast("string").alias("language"),
        "ord",
    )


def containment_edges(files: DataFrame) -> DataFrame:
    """Repository to first folder, folder to folder, and last folder (or repository) to file."""
    top = F.concat(F.lit("repository:"), "repository_id")
    folders = F.transform(prefixes(F.col("path")), lambda p: F.concat(F.lit("dir:"), p))
    chain = F.concat(F.array(top), folders, F.array(F.concat(F.lit("file:"), "path")))
    rows = files.select("repository_id", "ord", chain.alias("chain"))
    rows = rows.select("repository_id", "ord", "chain", F.explode(F.sequence(F.lit(1), F.size("chain") - 1)).alias("i"))
    return rows.select(
        "repository_id",
        F.element_at("chain", F.col("i")).alias("src"),
        F.element_at("chain", F.col("i") + 1).alias("dst"),
        F.lit(CONTAINS).alias("relation"),
        F.lit("{}").alias("metadata_json"),
        (F.col("ord") * 256 + F.least("i", F.lit(255))).alias("ord"),
    )


def parent_edges(symbols: DataFrame) -> DataFrame:
    """Parent to symbol: DECLARES for variables and constants, else CONTAINS."""
    return symbols.filter(F.col("parent").isNotNull()).select(
        "repository_id",
        F.col("parent").alias("src"),
        F.col("id").alias("dst"),
        F.when(F.col("kind").isin("variable", "constant"), DECLARES).otherwise(CONTAINS).alias("relation"),
        F.lit("{}").alias("metadata_json"),
        (F.col("ord") + _LATER * 256).alias("ord"),
    )


def relation_edges(relations: DataFrame, after: int) -> DataFrame:
    return relations.select("repository_id", F.col("source").alias("src"), F.col("target").alias("dst"), "relation", "metadata_json", (F.col("ord") + after).alias("ord"))


def graph_nodes(symbols: DataFrame) -> DataFrame:
    """Repositories, symbols and folders; needs no relations."""
    files = symbols.filter("kind = 'file'").select("repository_id", "path", "ord")
    repositories = symbols.select("repository_id").distinct().select(
        "repository_id",
        F.concat(F.lit("repository:"), "repository_id").alias("id"),
        F.lit("Repository").alias("type"),
        F.col("repository_id").alias("name"),
        F.col("repository_id").alias("qualified_name"),
        F.lit(None).cast("string").alias("file_id"),
        F.lit(False).alias("exported"),
        F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("string").alias("language"),
        F.lit(-1).cast("bigint").alias("ord"),
    )
    return first_nodes(repositories.unionByName(symbol_nodes(symbols)).unionByName(folder_nodes(files)))


def graph_edges(symbols: DataFrame, relations: DataFrame, nodes: DataFrame, usages: DataFrame | None = None, only: Iterable[str] | None = None) -> DataFrame:
    """Edges between ``nodes``; of the relations in ``only``, what makes no other is not run."""
    files = symbols.filter("kind = 'file'").select("repository_id", "path", "ord")
    edges = containment_edges(files).unionByName(parent_edges(symbols)).unionByName(relation_edges(relations, _LATER * 512))
    if usages is not None:
        edges = edges.unionByName(relation_edges(usages, 1 << 61))
    return valid_edges(edges if only is None else edges.filter(F.col("relation").isin(list(only))), nodes)


def build_graph(symbols: DataFrame, relations: DataFrame, usages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); ``usages`` are further relations, such as USES, READS and WRITES."""
    nodes = graph_nodes(symbols)
    return nodes, graph_edges(symbols, relations, nodes, usages)
