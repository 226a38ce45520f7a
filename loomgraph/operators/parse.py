"""Parsing source files into ``ast_records``, one row per import, export, declaration or call."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from loomgraph.functions.outline import outline
from loomgraph.schemas import AST_RECORDS
from loomgraph.session import small_batches
from loomgraph.sources.files import parseable

_COLUMNS = [part.strip().split(" ")[0] for part in AST_RECORDS.replace("array<struct<imported:string,local:string>>", "x").replace("array<struct<name:string,type:string>>", "x").split(",")]


def _rows(frames: Iterator[pd.DataFrame], include_source: bool) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for file in frame.itertuples(index=False):
            text = file.content
            lines = [m.start() for m in re.finditer("\n", text)]
            # Places of the characters that take two UTF-16 units.
            wide = [] if text.isascii() else [m.start() for m in re.finditer("[\U00010000-\U0010FFFF]", text)]
            for i, r in enumerate(outline(file.language, text)):
                start, end = r["start"], r["end"]
                row = dict.fromkeys(_COLUMNS) | {k: v for k, v in r.items() if k in _COLUMNS}
                row |= {
                    "repository_id": file.repository_id, "file_id": file.path, "path": file.path, "language": file.language,
                    "start_line": bisect_left(lines, start) + 1, "end_line": bisect_left(lines, end) + 1, "start_offset": start, "end_offset": end,
                    "start_utf16": start + bisect_left(wide, start), "end_utf16": end + bisect_left(wide, end),
                    "source": text[start:end] if include_source else None, "ord": file.ord * 1_000_000 + i,
                }
                rows.append(row)
            if len(rows) >= 20_000:
                yield pd.DataFrame(rows, columns=_COLUMNS)
                rows = []
        yield pd.DataFrame(rows, columns=_COLUMNS)


def parse(sources: DataFrame, include_source: bool = True) -> DataFrame:
    """``ast_records`` of all files that have a parser and some text."""
    small_batches(sources.sparkSession, 100)
    files = parseable(sources).select("repository_id", "path", "language", "ord", "content")
    return files.mapInPandas(lambda frames: _rows(frames, include_source), AST_RECORDS)
