"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import Scratch, small_batches, stored

WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any file system it knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    pure = F.octet_length(text) == F.length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words_of(text: Column) -> Column:
    """The words ``[0-9a-z and all non-ASCII]+`` of a text, in order; null or empty gives none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_CLASS)
    return F.filter(parts, lambda w: w != "")


def give_back() -> None:
    """Returns the memory that this process has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function whose worker keeps nothing when its task ends: workers live on from stage to stage."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that tell rows of different (doc_id, text) apart; null differs from empty ids."""
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n")), F.lit("\n"), F.coalesce(text, F.lit(""))))


def row_hash(df: DataFrame) -> Column:
    """64 bits of all columns of a row, the same wherever the row lies."""
    return F.xxhash64(*[F.map_entries(f.name) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in df.schema])


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_weighed(rows: DataFrame, table: DataFrame, key: str | list[str], weight: str) -> DataFrame:
    """``rows`` joined with ``table`` on ``key`` (columns without nulls), unique in the table; ``weight`` is how many rows have it.

    Keys of a thousandth of all rows or more, a thousand keys at most, are broadcast; the others are shuffled.
    """
    least = (table.agg(F.sum(weight)).first()[0] or 0) / 1000
    hot, rest = F.broadcast(table.filter(F.col(weight) >= least)), table.filter(F.col(weight) < least)
    few = rows.join(hot, key)
    many = rows.join(hot.select(key), key, "left_anti").join(rest.hint("merge"), key)
    return few.unionByName(many)


__all__ = ["Scratch", "ascii_lower", "give_back", "join_weighed", "lean", "row_hash", "row_key", "small_batches", "stored", "table", "unused", "words_of"]
