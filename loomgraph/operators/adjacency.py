"""Edges stored twice, by source and by target, bucketed and sorted, so that look-ups and rounds join them where they lie.

A look-up shuffles the ids that are asked for to the buckets, never the edges.  Ids that hold a thousandth of all edges
or more (a thousand at most) would fill a bucket: their edges lie in a table of their own that isn't bucketed, read in
as many tasks as it has blocks, and are met by a broadcast of those ids that are asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import shared_dir

REPO = "repository_id"
#: An id with fewer edges than this is never heavy.
HEAVY = 100_000


@dataclass
class Adjacency:
    by: str  # src or dst
    light: DataFrame
    heavy: DataFrame | None
    heavy_ids: DataFrame | None

    def met(self, ids: DataFrame, relations: Iterable[str] | None = None) -> list[DataFrame]:
        """The edges of ``ids`` (repository_id, id): those of light ids, and of heavy ones if there are any; no id is in both."""
        wanted = ids.withColumnRenamed("id", self.by)
        keep = (lambda df: df) if relations is None else (lambda df: df.filter(F.col("relation").isin(list(relations))))
        parts = [keep(self.light).join(wanted.hint("merge"), [REPO, self.by], "left_semi")]
        if self.heavy is not None:
            few = F.broadcast(self.heavy_ids.join(wanted, [REPO, self.by], "left_semi"))
            parts.append(keep(self.heavy).join(few, [REPO, self.by], "left_semi"))
        return parts


def store(edges: DataFrame, by: str, buckets: int | None = None, heavy: int = HEAVY) -> Adjacency:
    """Writes ``edges`` by ``src`` or ``dst`` to the shared folder, as tables of this session's catalogue."""
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"edges_by_{by}_{uuid.uuid4().hex}"
    where = f"{shared_dir(spark)}/{name}"
    counted = edges.groupBy(REPO, by).agg(F.count("*").alias("n"))
    least = max(heavy, (edges.count() + 999) // 1000)
    # Ids with a thousandth of all edges: a thousand at most.
    hot = counted.filter(F.col("n") >= least).select(REPO, by)
    hot.write.parquet(f"{where}/heavy-ids")
    hot = spark.read.schema(hot.schema).parquet(f"{where}/heavy-ids")
    some = not hot.isEmpty()
    light = edges.join(F.broadcast(hot), [REPO, by], "left_anti") if some else edges
    # As many tasks as buckets, each writing its own.
    light = light.repartition(buckets, REPO, by)
    light.write.format("parquet").option("path", f"{where}/light").bucketBy(buckets, REPO, by).sortBy(REPO, by).saveAsTable(name)
    if some:
        edges.join(F.broadcast(hot), [REPO, by], "left_semi").write.parquet(f"{where}/heavy")
    return Adjacency(by, spark.table(name), spark.read.schema(edges.schema).parquet(f"{where}/heavy") if some else None, hot if some else None)
