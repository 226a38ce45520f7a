"""Name, path and fuzzy search over nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import collapsed, fuzzy_score


def by_name(nodes: DataFrame, text: str, exact: bool = False, limit: int = 50) -> DataFrame:
    """Case-insensitive equality or part, in the order of ``ord``."""
    name = F.lower("name")
    return nodes.filter(name == text.lower() if exact else name.contains(text.lower())).orderBy("ord").limit(limit)


def by_path(nodes: DataFrame, text: str, limit: int = 50) -> DataFrame:
    return nodes.filter(F.lower("path").contains(text.lower())).orderBy("ord").limit(limit)


def fuzzy(nodes: DataFrame, query: str, limit: int = 20, binary: bool = False) -> DataFrame:
    """Nodes by fuzzy score, best first, ties by name.

    The query is trimmed; a blank one finds nothing.  Candidates hold every trigram of the query, blanks collapsed
    (a query of fewer than three characters is its own trigram, which only an equally short name has); if none does, all
    nodes are candidates.  ``binary`` orders names by code points instead of by collation.  ``gram_index`` answers many
    queries at once from stored lists.
    """
    q = query.lower().strip()
    if not q:
        return nodes.withColumn("score", F.lit(0)).limit(0)
    flat, held = " ".join(q.split()), collapsed(F.col("name"))
    pooled = F.lit(True)
    for gram in sorted({flat[i : i + 3] for i in range(len(flat) - 2)}):
        pooled &= held.contains(gram)
    if len(flat) < 3:
        pooled &= held == flat
    scored = nodes.withColumn("score", fuzzy_score(F.col("name"), q)).withColumn("pooled", F.coalesce(pooled, F.lit(False))).filter("score > 0 or pooled")
    name = F.col("name") if binary else F.collate("name", "UNICODE")
    order = [F.desc("score"), name, "ord"]
    # The pool comes first, so its first row among the few that are left tells whether there is one.
    top = scored.orderBy(F.desc("pooled"), *order).limit(limit).withColumn("pool", F.max("pooled").over(Window.partitionBy()))
    return top.filter("score > 0 and pooled = pool").drop("pooled", "pool").orderBy(*order)
