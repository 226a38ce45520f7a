"""From source files to a knowledge graph and its chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from loomgraph.operators import chunks, graph, resolve, symbols
from loomgraph.operators.navigator import Navigator
from loomgraph.operators.parse import parse
from loomgraph.session import stored
from loomgraph.sources.files import parseable


@dataclass(frozen=True)
class Knowledge:
    files: DataFrame
    records: DataFrame
    symbols: DataFrame
    relations: DataFrame
    references: DataFrame
    navigator: Navigator

    def chunks(self, characters: int = chunks.LARGE_CHARACTERS, lines: int = chunks.LARGE_LINES) -> DataFrame:
        return chunks.build_chunks(self.symbols, self.records, self.navigator, characters, lines)


def build_knowledge(sources: DataFrame, usages: DataFrame | None = None, strict: bool = False, resolve_index: bool = False) -> Knowledge:
    """Parses, extracts, resolves and builds the graph of all repositories in ``sources``.

    Each stage is written once, since many queries read it; none is read as a whole by one task.
    """
    files = parseable(sources).select("repository_id", "path", "language", "ord")
    records = stored(parse(sources), "records")
    found = stored(symbols.extract_symbols(files, records, strict), "symbols")
    relations, references = resolve.resolve(files, records, found, resolve_index)
    relations = stored(relations, "relations")
    nodes, edges = graph.build_graph(found, relations, usages)
    nodes = stored(nodes, "nodes")
    return Knowledge(files, records, found, relations, references, Navigator(nodes, stored(edges, "edges")))
