"""Posting lists of trigrams over names, and fuzzy search of many queries at once through them.

The index holds each distinct name of a repository once: ``grams`` says which names hold a trigram and ``counts`` how
many do; ``ids`` gives the nodes of a name with their places in its order, so a name that a third of all nodes bear is
one entry of a list.  Names are lower-cased and their blanks collapsed before trigrams are taken; a name of fewer than
three characters is its own trigram.

A query is lower-cased and trimmed; a blank one finds nothing.  Its candidates hold all of its trigrams: they come from
the list of its rarest trigram and are held against the others.  A query without candidates, one that misspells or
abbreviates, is scored against all names, in blocks of ``BLOCK`` queries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.text import collapsed, fuzzy_score, trigrams, trimmed
from loomgraph.session import Scratch

from .ranks import ranked

REPO = "repository_id"
#: Queries without candidates that are held against a name in one row.
BLOCK = 64


@dataclass
class GramIndex:
    grams: DataFrame  # repository_id, gram, name
    counts: DataFrame  # repository_id, gram, n
    ids: DataFrame  # repository_id, name, id, ord, spot


def build(nodes: DataFrame, path: str) -> GramIndex:
    """Writes the index of ``nodes`` (repository_id, id, name, ord) to ``path``, sorted so that readers skip what they don't ask for."""
    spark = nodes.sparkSession
    scratch = Scratch(spark)
    ids = ranked(nodes.filter("name is not null").select(REPO, "id", "name", "ord"), [REPO, "name"], ["ord", "id"], "spot", scratch).drop("spot_total")
    ids.write.parquet(f"{path}/ids")
    scratch.keep()
    names = spark.read.schema(ids.schema).parquet(f"{path}/ids").filter("spot = 0").select(REPO, "name")
    names.select(REPO, F.explode(trigrams(collapsed(F.col("name")))).alias("gram"), "name").repartitionByRange(REPO, "gram", "name").sortWithinPartitions(REPO, "gram").write.parquet(f"{path}/grams")
    spark.read.schema("repository_id string, gram string, name string").parquet(f"{path}/grams").groupBy(REPO, "gram").agg(F.count("*").alias("n")).write.parquet(f"{path}/counts")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> GramIndex:
    schemas = {"grams": "repository_id string, gram string, name string", "counts": "repository_id string, gram string, n bigint", "ids": "repository_id string, id string, name string, ord bigint, spot bigint"}
    return GramIndex(*(spark.read.schema(kind).parquet(f"{path}/{part}") for part, kind in schemas.items()))


def _pooled(index: GramIndex, asked: DataFrame) -> DataFrame:
    """(repository_id, q, name): the names that hold all trigrams of a query."""
    grams = asked.select(REPO, "q", F.explode(trigrams(collapsed(F.col("q")))).alias("gram"))
    weighed = grams.join(index.counts, [REPO, "gram"], "left")
    rare = weighed.groupBy(REPO, "q").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.collect_list("gram").alias("all"), F.count_if(F.col("n").isNull()).alias("missing"))
    listed = rare.filter("missing = 0").drop("missing").join(index.grams, [REPO, "gram"])
    held = collapsed(F.col("name"))
    return listed.filter(F.forall("all", lambda g: (g == F.col("gram")) | F.contains(held, g))).select(REPO, "q", "name")


def _against_all(index: GramIndex, asked: DataFrame, scratch: Scratch) -> DataFrame:
    """(repository_id, q, name) of queries without candidates and every name of their repository, block by block."""
    blocks = ranked(asked, [REPO], ["q"], "at", scratch)
    blocks = blocks.groupBy(REPO, F.floor(F.col("at") / BLOCK).alias("block")).agg(F.collect_list("q").alias("qs"), F.max("at_total").alias("total"))
    wanted = blocks.groupBy(REPO).agg(F.max("block").alias("last"))
    names = index.ids.filter("spot = 0").select(REPO, "name").join(wanted, REPO).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")))
    return names.join(blocks, [REPO, "block"]).select(REPO, F.explode("qs").alias("q"), "name")


def search_many(index: GramIndex, queries: DataFrame, limit: int = 20, binary: bool = False) -> DataFrame:
    """(repository_id, query_id, id, name, score, place): at most ``limit`` nodes for each of ``queries`` (repository_id, query_id, query).

    Best first; ties by name (by code points if ``binary``, else by collation), then in the nodes' order.  Queries that
    read alike are answered once.
    """
    scratch = Scratch(queries.sparkSession)
    named = scratch.store(queries.select(REPO, "query_id", trimmed(F.lower("query")).alias("q")).filter("q <> ''"), "gram-queries")
    asked = named.select(REPO, "q").distinct()
    pooled = scratch.store(_pooled(index, asked), "gram-pool")
    alone = scratch.store(asked.join(pooled.select(REPO, "q").distinct(), [REPO, "q"], "left_anti"), "gram-alone")
    pairs = pooled if alone.isEmpty() else pooled.unionByName(_against_all(index, alone, scratch))
    name: Column = F.col("name") if binary else F.collate("name", "UNICODE")
    scored = pairs.withColumn("score", fuzzy_score(F.col("name"), F.col("q"))).filter("score > 0")
    of_query = Window.partitionBy(REPO, "q")
    best = scored.withColumn("place", F.row_number().over(of_query.orderBy(F.desc("score"), name, "name"))).filter(F.col("place") <= limit).drop("place")
    found = best.join(index.ids.filter(F.col("spot") < limit), [REPO, "name"])
    found = found.withColumn("place", F.row_number().over(of_query.orderBy(F.desc("score"), name, "name", "ord", "id"))).filter(F.col("place") <= limit)
    return named.join(found, [REPO, "q"]).select(REPO, "query_id", "id", "name", "score", "place")
