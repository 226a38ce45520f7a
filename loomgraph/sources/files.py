"""Scanning a repository's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.paths import extension, ignored, language, normalized
from loomgraph.operators.ranks import ranked

MAX_BYTES = 1024 * 1024
_COLUMNS = ("absolute_path", "extension", "language", "size", "last_modified", "ord", "content")
# Languages that have a parser.
PARSED = ("javascript", "react", "typescript", "react-ts", "python", "java", "go", "rust")


def scan(spark: SparkSession, root: str, repository_id: str, with_content: bool = True) -> DataFrame:
    """Files below ``root`` with metadata and, unless too large or binary, their text.

    Ignored paths go before contents are read: without ``content`` in the result Spark lists files only.
    """
    top = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+(?=/)|^[a-z0-9]+:(?=/)", ""), r"^/+", "/")
    bare = "/" + top.split(":", 1)[-1].strip("/")
    relative = F.substring(path, F.lit(len(bare) + 2), F.length(path))
    rows = raw.withColumn("relative", normalized(relative)).filter(~ignored(F.col("relative")))
    return file_table(rows, repository_id, with_content)


def file_table(rows: DataFrame, repository_id: str, with_content: bool = True) -> DataFrame:
    """Rows (relative, path, length, modificationTime, content) as the ``sources`` table, in path order."""
    columns = [
        F.lit(repository_id).alias("repository_id"),
        F.col("relative").alias("path"),
        F.col("path").alias("absolute_path"),
        extension(F.col("relative")).alias("extension"),
        language(F.col("relative")).alias("language"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
    ]
    if with_content:
        columns.append(text_of(F.col("content"), F.col("length")).alias("content"))
    # Places come from paths alone; contents don't take part in the sort.
    places = in_path_order(rows.select(columns[0], columns[1]))
    return rows.select(*columns).join(places, ["repository_id", "path"]).select("repository_id", "path", *[c for c in _COLUMNS if with_content or c != "content"])


def text_of(content: Column, length: Column) -> Column:
    """UTF-8 text; null if longer than 1 MiB or binary (a zero byte among the first 8000)."""
    head = F.hex(F.substring(content, 1, 8000))
    binary = F.length(F.regexp_extract(head, "^(?:[0-9A-F]{2})*?00", 0)) > 0
    return F.when((length <= MAX_BYTES) & ~binary, F.decode(content, "UTF-8"))


def parseable(sources: DataFrame) -> DataFrame:
    """Files in a language that has a parser, with some content."""
    return sources.filter(F.col("language").isin(list(PARSED)) & (F.length("content") > 0))


def in_path_order(files: DataFrame) -> DataFrame:
    """Numbers files by path within each repository."""
    return ranked(files, ["repository_id"], ["path"], "ord").withColumn("ord", F.col("ord").cast("bigint")).drop("ord_total")
