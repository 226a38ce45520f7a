"""Contiguous shards of nearly equal bytes, by a global prefix sum.  DataFrame functions only.

Documents are put in order of doc_id (ties: checksum, then a row tag).  Spark range-partitions the
narrow rows (id, size, checksum), the total of each partition gives that partition's offset, and a
running sum inside each partition completes the global prefix sum: no stage sees all rows in one
task, and the only single-task step sums one row per partition.  Cuts lie at equal byte targets: a
document goes to the shard in which the middle of its byte span falls, so a shard misses its target
by at most half a document at either end.

Defined cases: a null text has size 1 and checksum 0; null ids come first; repeated rows each get
their own slot; an empty table gives no rows; texts longer than a shard's target leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 8


def assign_shards(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``documents``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tag"),
    )
    # The tag ends the sort key, so a doc_id that holds a third of all rows still splits.
    ranged = narrow.repartitionByRange("doc_id", "text_crc32", "tag").withColumn("block", F.spark_partition_id())
    rows = stored(ranged, "shard-rows")

    totals = rows.groupBy("block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "block",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_offset"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row_offset"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("block").orderBy("doc_id", "text_crc32", "tag")
    running = rows.select(
        "*",
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("byte_start"),
        (F.row_number().over(inside) - 1).alias("row_start"),
    )
    # One row per range partition: bounded by the partition count, whatever the table's size.
    placed = running.join(F.broadcast(offsets), "block").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("row_offset") + F.col("row_start")).alias("place"),
        F.expr(f"cast(((2 * cast(byte_offset + byte_start as decimal(25,0)) + size) * {shards}) div (2 * cast(all_bytes as decimal(25,0))) as int)").alias("shard"),
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    # One row per shard.
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first_place")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
