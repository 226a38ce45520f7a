"""An inverted file over vectors: coarse centroids, lists stored apart, queries that probe the nearest lists.

Centroids are fitted on at most ``FIT_VECTORS`` vectors (those with the smallest key hashes) by spherical k-means on the
driver; every vector is then assigned to its nearest centroid and written, partitioned by list.  A query probes lists,
nearest centroid first, until they hold ``candidates`` vectors of its group, and the candidates are ranked by their
exact cosine.  How many are needed for a recall is measured when the centroids are fitted: the fitted sample's own
nearest neighbours tell the share of vectors that must be looked at.  Probing every list gives the exact result.

A list is dealt into parts of about ``PART`` vectors and its queries into blocks, so neither a hot list nor a hot group
fills a task.  What is broadcast is the centroids: ``MAX_LISTS`` at most.  Null and zero vectors are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rag import nearest_of_block

FIT_VECTORS = 20_000
MAX_LISTS = 4096
#: Vectors of a part of a list, and queries of a block, that meet in a task.
PART, BLOCK = 8192, 1024
#: Rows that are held against all centroids at once.
ROWS = 256
#: Sample vectors that are taken as queries to measure how far a probe has to go, and neighbours of each.
TRIALS, NEAR = 256, 5


@dataclass
class VectorIndex:
    """``lists``: group, list, part, key, vector; ``sizes``: group, list, n, parts; ``share`` of the vectors to look at."""

    lists: DataFrame
    sizes: DataFrame
    centroids: np.ndarray
    share: float


def _unit(rows: list) -> np.ndarray:
    a = np.array(rows, dtype=float)
    size = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(size > 0, size, 1)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, ROWS):
        yield batch.slice(i, ROWS)


def centroids_of(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: unit centroids; one that loses all its vectors takes the vector worst served."""
    found = sample[np.random.default_rng(7).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = sample @ found.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(found)) == 0)
        sums[empty] = sample[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        found = _unit(list(sums))
    return found


def share_for(sample: np.ndarray, centroids: np.ndarray, recall: float) -> float:
    """The share of vectors that a query must look at to meet ``recall`` of its nearest ones, by the sample's own."""
    own = (sample @ centroids.T).argmax(axis=1)
    counts = np.bincount(own, minlength=len(centroids))
    needed: list[float] = []
    for i in range(min(TRIALS, len(sample))):
        near = sample @ sample[i]
        near[i] = -np.inf
        order = np.argsort(-(centroids @ sample[i]), kind="stable")
        before = np.empty(len(centroids))
        before[order] = (np.cumsum(counts[order]) - counts[order]) / len(sample)
        needed += before[own[np.argsort(-near, kind="stable")[: min(NEAR, len(sample) - 1)]]].tolist()
    if not needed:
        return 1.0
    # A list is probed if those before it hold less than the share.
    return min(1.0, float(np.quantile(needed, recall, method="higher")) + 1e-9)


def build(vectors: DataFrame, path: str, key: str = "id", column: str = "embedding", group: str | Column | None = None, recall: float = 0.95, lists: int | None = None) -> VectorIndex:
    """Fits, assigns and writes an index to ``path``; ``group`` (a repository, say) confines queries to its own vectors."""
    spark = vectors.sparkSession
    group = F.lit("") if group is None else (F.col(group) if isinstance(group, str) else group).cast("string")
    rows = vectors.select(F.coalesce(group, F.lit("")).alias("group"), F.col(key).alias("key"), F.col(column).cast("array<double>").alias("vector"))
    rows = rows.filter(F.exists("vector", lambda x: x != 0))
    n = rows.count()
    sample = _unit([r["vector"] for r in rows.orderBy(F.xxhash64("key"), "key").select("vector").limit(FIT_VECTORS).collect()] or [[1.0]])
    wanted = min(MAX_LISTS, len(sample), lists or max(1, round(math.sqrt(n))))
    centroids = centroids_of(sample, wanted)
    share = share_for(sample, centroids, recall)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # A few rows at a time: all of a batch against all centroids would grow with the lists.
                near = [(_unit(part.column("vector").to_pylist()) @ centroids.T).argmax(axis=1) for part in _parts(batch)]
                yield batch.append_column("list", pa.array(np.concatenate(near), pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows.mapInArrow(assign, f"{kinds}, list bigint").write.parquet(f"{path}/assigned")
    assigned = spark.read.schema(f"{kinds}, list bigint").parquet(f"{path}/assigned")
    sizes = assigned.groupBy("group", "list").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART))
    sizes.write.parquet(f"{path}/sizes")
    sizes = spark.read.schema(sizes.schema).parquet(f"{path}/sizes")
    dealt = assigned.join(sizes.select("group", "list", "parts"), ["group", "list"]).withColumn("part", F.pmod(F.xxhash64("key"), "parts")).drop("parts")
    dealt.repartition("list", "part").sortWithinPartitions("list", "group").write.partitionBy("list").parquet(f"{path}/lists")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/assigned")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    kind = rows.schema["key"].dataType.simpleString()
    spark.createDataFrame([(i, c.tolist(), share, kind) for i, c in enumerate(centroids)], "list bigint, centroid array<double>, share double, key_type string").coalesce(1).write.parquet(f"{path}/centroids")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    # An index of nothing has no files to take a schema from.
    lists = spark.read.schema(f"`group` string, key {rows[0]['key_type']}, vector array<double>, part bigint, list bigint").parquet(f"{path}/lists")
    return VectorIndex(lists, spark.read.schema("`group` string, list bigint, n bigint, parts bigint").parquet(f"{path}/sizes"), np.array([r["centroid"] for r in rows]), rows[0]["share"])


def _probes(index: VectorIndex, queries: DataFrame, least: int, share: float) -> DataFrame:
    """(group, list, query_id, vector, rank): the lists that each query probes."""
    centroids = index.centroids
    held = index.sizes.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("list", "n"))).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                yield from probed(part)

    def probed(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The lists that each query of ``part`` probes; its id and vector aren't copied for each of them."""
        own, ends, found = part.column("held"), part.column("held").offsets.to_numpy(), []
        all_lists, all_n = (own.values.field(c).to_numpy(zero_copy_only=False) for c in ("list", "n"))
        for i, vector in enumerate(part.column("vector").to_pylist()):
            lists, n = all_lists[ends[i] : ends[i + 1]], all_n[ends[i] : ends[i + 1]]
            order = np.argsort(-(centroids[lists] @ _unit([vector])[0]), kind="stable")
            before = np.cumsum(n[order]) - n[order]
            found.append(lists[order[before < max(least, math.ceil(share * n.sum()))]])
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("query_id", "group", "vector")), pa.array(found, pa.list_(pa.int64()))], names=["query_id", "group", "vector", "lists"])

    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.join(held, "group").mapInArrow(run, f"query_id {kind}, `group` string, vector array<double>, lists array<bigint>")
    return asked.select("query_id", "group", "vector", F.posexplode("lists").alias("rank", "list")).select("query_id", "group", "vector", "list", "rank")


def search(index: VectorIndex, queries: DataFrame, limit: int = 5, key: str = "id", column: str = "embedding", group: str | Column | None = None, candidates: int | None = None, share: float | None = None) -> DataFrame:
    """(query_id, key, score, place): the nearest vectors of its group to each query, as ``rag.search_many`` scores them.

    A query looks at ``candidates`` vectors at least (20 times the limit, 100 or more by default) and at ``share`` of its
    group (by default what the fit found); a share of 1 probes every list.
    """
    group = F.lit("") if group is None else (F.col(group) if isinstance(group, str) else group).cast("string")
    asked = queries.select(F.col(key).alias("query_id"), F.coalesce(group, F.lit("")).alias("group"), F.col(column).cast("array<double>").alias("vector")).filter(F.exists("vector", lambda x: x != 0))
    probes = _probes(index, asked, max(20 * limit, 100) if candidates is None else candidates, index.share if share is None else share)
    # At most MAX_LISTS numbers; folders of other lists aren't read.
    met = [r["list"] for r in probes.select("list").distinct().collect()]
    kind = index.lists.schema["key"].dataType.simpleString()
    # A list that many ask meets its queries block by block.
    asking = probes.groupBy("group", "list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(index.sizes, ["group", "list"])
    asking = asking.select("group", "list", "parts", "blocks")

    def dealt(rows: DataFrame, own: str, mine: Column, other: str, others: str) -> DataFrame:
        rows = rows.join(asking, ["group", "list"]).withColumn(own, mine)
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1).cast("array<bigint>")))

    left = dealt(index.lists.filter(F.col("list").isin(met)), "part", F.col("part"), "block", "blocks").select("group", "list", "part", "block", "key", "vector")
    right = dealt(probes, "block", F.pmod(F.xxhash64("query_id"), "blocks"), "part", "parts").select("group", "list", "part", "block", F.col("query_id").alias("key"), "vector")
    by = ["group", "list", "part", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(nearest_of_block(key, limit), f"query_id {kind}, {key} {kind}, score double")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return ranked.filter(F.col("place") <= limit)


def recall(found: DataFrame, exact: DataFrame, key: str = "id") -> DataFrame:
    """One row: n_queries, and the share of the exact results that were found."""
    hits = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return hits.agg(F.countDistinct("query_id").alias("n_queries"), (F.count("hit") / F.count("*")).alias("recall"))
