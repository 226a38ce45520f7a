"""Places of rows in an order, without sorting a group in one task.

Rows are range-partitioned by (group, order), numbered within each partition, and a group's numbers go on from one
partition to the next by prefix sums over their counts: one row a group and partition, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import Scratch


def ranked(rows: DataFrame, group: list[str], order: list[str | Column], name: str = "place", scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with ``name``, their place from 0 within ``group``, gapless; and ``name`` + ``_total``, the rows of the group.

    Rows that tie get the places in any order, each its own.  A null group is a group.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    keys = [*group, *order]
    numbered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if group or order else rows.sortWithinPartitions(*keys)
    numbered = scratch.store(numbered.withColumn("_seq", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_seq", 33)), "ranked")
    counts = numbered.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_from"))
    own = Window.partitionBy(*group) if group else Window.partitionBy()
    counts = counts.select(
        *[F.col(g).alias(f"_of_{g}") for g in group], F.col("_part").alias("_of_part"), "_from", (F.sum("_n").over(own.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(own).alias(f"{name}_total")
    )
    match = F.col("_part") == F.col("_of_part")
    for g in group:
        match &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    placed = numbered.join(counts, match).withColumn(name, F.col("_before") + F.col("_seq") - F.col("_from"))
    return placed.select(*rows.columns, name, f"{name}_total")
