"""A data source that lists repositories' folders in parallel and never opens an ignored one.

``spark.read.format("repository_files").load(root)`` gives (source, relative, path, length, modificationTime, content).
The driver lists the folders of the first ``levels`` levels only; each is a partition that its task walks by itself.
Folders of the ignored names are left out where they are met, before they are listed; ignored endings before files are
opened; contents beyond ``sources.files.MAX_BYTES`` aren't read.  With ``repositories`` the first level of folders are
repositories, which ``source`` names; without it ``source`` is empty.

Paths are opened by the file systems of Arrow (local and mounted folders, HDFS, object stores), in the tasks as in the
driver; where only Spark's readers reach a store, ``sources.files.scan`` reads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.functions.paths import IGNORED_ENDINGS, IGNORED_FOLDERS

from .files import MAX_BYTES

NAME = "repository_files"
SCHEMA = "source string, relative string, path string, length bigint, modificationTime timestamp, content binary"
#: Files, and bytes of contents, of one batch at most, but for the last file.
FILES, BYTES = 1000, 8 << 20


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if root.startswith("file:/") and not root.startswith("file:///"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root.rstrip("/") or "/") if "://" in root else (fs.LocalFileSystem(), root.rstrip("/") or "/")


def entries(files: fs.FileSystem, folder: str) -> tuple[list[fs.FileInfo], list[str]]:
    """The files and the folders to walk on of one folder, by name."""
    found = sorted(files.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path)
    kept = [f for f in found if f.type == fs.FileType.File and not f.base_name.endswith(IGNORED_ENDINGS)]
    return kept, [f.path for f in found if f.type == fs.FileType.Directory and f.base_name not in IGNORED_FOLDERS]


def walk(files: fs.FileSystem, folder: str, deep: bool = True) -> Iterator[fs.FileInfo]:
    """The files below a folder (``deep``) or in it."""
    ahead = [folder]
    while ahead:
        own, folders = entries(files, ahead.pop())
        yield from own
        if deep:
            ahead += reversed(folders)


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.levels = int(options.get("levels", "2"))
        self.named = str(options.get("repositories", "false")).lower() == "true"
        self.content = str(options.get("content", "true")).lower() == "true"

    def partitions(self) -> list[Folder]:
        """Folders of the last level listed are walked whole; of those above only the files in them are left."""
        files, top = opened(self.root)
        parts, level = [], [top]
        for _ in range(self.levels):
            parts += [Folder(path, False) for path in level]
            level = [x for path in level for x in entries(files, path)[1]]
        return parts + [Folder(path, True) for path in level]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files, top = opened(self.root)
        rows: list[tuple] = []
        held = 0
        for info in walk(files, partition.path, partition.deep):
            relative = info.path[len(top.rstrip("/")) + 1 :]
            source = ""
            if self.named:
                source, _, relative = relative.partition("/")
                if not relative:
                    continue  # a file beside the repositories
            content = None
            if self.content and info.size <= MAX_BYTES:
                with files.open_input_file(info.path) as handle:
                    content = handle.read()
            rows.append((source, relative, info.path, info.size, info.mtime, content))
            held += len(content or b"")
            if len(rows) >= FILES or held >= BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary()]
    names = ["source", "relative", "path", "length", "modificationTime", "content"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class RepositoryFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        return Reader(self.options)


def scan_folders(spark: SparkSession, root: str, repositories: bool = False, levels: int = 2, content: bool = True) -> DataFrame:
    """The files below ``root``, as ``file_table`` takes them."""
    spark.dataSource.register(RepositoryFiles)
    return spark.read.format(NAME).option("repositories", str(repositories)).option("levels", levels).option("content", str(content)).load(root)


def lay_out(rows: DataFrame, root: str) -> int:
    """Writes (source, path, content) to files below ``root``, each task its own; gives how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = opened(root)
        for batch in batches:
            for source, path, content in zip(*(batch.column(c).to_pylist() for c in ("source", "path", "content")), strict=True):
                folder, _, name = f"{top}/{source}/{path}".rpartition("/")
                files.create_dir(folder, recursive=True)
                # A task that is run again replaces what it wrote.
                with files.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return sum(r["n"] for r in rows.select("source", "path", "content").mapInArrow(run, "n bigint").collect())
