"""Symbols: a file and a module per source file, and the declarations with their scopes and ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.paths import normalized, without_extension
from loomgraph.schemas import SYMBOLS
from loomgraph.session import together

# Declaration categories in the order in which equal spans are taken, with their kinds.
DEFINITIONS = {
    "classes": "class", "interfaces": "interface", "enums": "enum", "namespaces": "namespace", "typeAliases": "type-alias",
    "functions": "function", "methods": "method", "variables": "variable",
}
OWNERS = frozenset(("class", "interface", "enum", "function", "method"))
_FIELDS = [part.strip().split(" ")[0] for part in SYMBOLS.replace("array<struct<name:string,type:string>>", "x").split(",")]


def file_symbols(files: DataFrame, strict: bool = False) -> DataFrame:
    """File and module symbols.  Files of one name and different endings get modules told apart by ending;
    ``strict`` raises instead."""
    path = normalized(F.col("path"))
    rows = files.select("repository_id", path.alias("path"), "language", "ord").withColumn("bare", without_extension(F.col("path")))
    first = rows.groupBy("repository_id", "bare").agg(F.min("path").alias("first_path"))
    rows = rows.join(first, ["repository_id", "bare"])
    clash = F.col("path") != F.col("first_path")
    if strict:
        rows = rows.filter(F.when(clash, F.raise_error(F.concat(F.lit("duplicate symbol id module:"), "bare"))).otherwise(True).cast("boolean"))
    module = F.when(clash, F.col("path")).otherwise(F.col("bare"))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    none = F.lit(None)

    def symbol(kind: str, identity, label, qualified, parent, step: int):
        return F.struct(
            F.col("repository_id"), identity.alias("id"), label.alias("name"), F.lit(kind).alias("kind"), qualified.alias("qualified_name"), parent.cast("string").alias("parent"), F.col("path").alias("file_id"),
            F.lit(False).alias("exported"), *[none.cast("int").alias(c) for c in ("start_line", "end_line", "start_offset", "end_offset")], F.col("path"), F.col("language"),
            none.cast("array<string>").alias("modifiers"), none.cast("array<struct<name:string,type:string>>").alias("parameters"), none.cast("string").alias("return_type"), (F.col("ord") * 1_000_000 + step).alias("ord"),
        )

    file_id = F.concat(F.lit("file:"), "path")
    both = F.array(symbol("file", file_id, name(F.col("path")), F.col("path"), none, 0), symbol("module", F.concat(F.lit("module:"), module), name(F.col("bare")), module, file_id, 1))
    return rows.select(F.inline(both))


#: What a file's module, its exports and its declarations are told by, in the order in which they are read.
_MODULE, _EXPORT, _DECLARED = 0, 1, 2
_READ = (
    "repository_id", "file_id", "path", "language", "category", "name", "kind", "modifiers", "parameters", "return_type", "start_line", "end_line", "start_offset", "end_offset", "module_id", "module_name", "file_ord",
    "exported", "step",
)


def _nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols of the declarations of many files, each file's in order: parents by a sweep over spans, ids by their parents' names.

    A file's module comes first, then the names that it exports; declarations of files without a module make no symbols.
    """
    schema, file, module, file_ord, stack, used, named, i = None, None, None, 0, [], set(), set(), 0
    for batch in batches:
        columns = {c: batch.column(c) for c in _READ}
        out: dict[str, list] = {c: [] for c in ("id", "kind", "parent", "ord", "exported")}
        met: list[int] = []
        keys = ("repository_id", "file_id", "category", "name", "kind", "start_offset", "end_offset", "module_id", "module_name", "file_ord", "exported", "step")
        for row, (repo, file_id, category, own, own_kind, start, end, module_id, module_name, place, exported, step) in enumerate(zip(*(columns[c].to_pylist() for c in keys), strict=True)):
            if (repo, file_id) != file:
                file, module, stack, used, named, i = (repo, file_id), None, [], set(), set(), 0
            if step == _MODULE:
                # A scope: id, qualified name, kind, start, end.
                module, file_ord = (module_id, module_name, "module", -1, 1 << 60), place
                stack = [module]
            elif step == _EXPORT:
                named.add(own)
            if step != _DECLARED or module is None:
                continue
            while len(stack) > 1 and not (stack[-1][3] <= start and stack[-1][4] >= end):
                stack.pop()
            kind = DEFINITIONS[category]
            parent = next((s for s in reversed(stack) if s[2] in ("class", "interface")), module) if kind == "method" else stack[-1]
            name = f"{parent[1]}.{own}"
            name = f"{name}#{start}" if name in used else name
            used.add(name)
            met.append(row)
            out["id"].append(name)
            out["kind"].append("constant" if kind == "variable" and own_kind == "const" else kind)
            out["parent"].append(parent[0])
            out["ord"].append(file_ord + 2 + i)
            out["exported"].append(bool(exported) or own in named)
            if kind in OWNERS:
                stack.append((name, name, kind, start, end))
            i += 1
        made = {"id": pa.array(out["id"], pa.string()), "kind": pa.array(out["kind"], pa.string()), "parent": pa.array(out["parent"], pa.string()), "ord": pa.array(out["ord"], pa.int64()), "exported": pa.array(out["exported"], pa.bool_())}
        made["qualified_name"] = made["id"]
        rows = pa.array(met, pa.int64())
        arrays = [made[c] if c in made else columns[c].take(rows) for c in _FIELDS]
        schema = schema or pa.schema([pa.field(c, a.type) for c, a in zip(_FIELDS, arrays, strict=True)])
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def declarations(records: DataFrame) -> DataFrame:
    """Those ``ast_records`` that make symbols."""
    return records.filter(F.col("category").isin(list(DEFINITIONS)) & (F.col("name") != "") & (F.col("name") != "anonymous"))


def declared(records: DataFrame) -> DataFrame:
    """``declarations`` with whether they are exported, by themselves or by an export of their name."""
    by_name = records.filter("category = 'exports' and name is not null").select("repository_id", "file_id", "name").distinct().withColumn("named_export", F.lit(True))
    found = declarations(records).join(by_name, ["repository_id", "file_id", "name"], "left")
    return found.withColumn("exported", F.coalesce("exported", F.lit(False)) | F.coalesce("named_export", F.lit(False))).drop("named_export")


def extract_symbols(files: DataFrame, records: DataFrame, strict: bool = False) -> DataFrame:
    """All symbols of ``files`` with their ``ast_records``."""
    tops = file_symbols(files, strict)
    none = {"modifiers": "array<string>", "parameters": "array<struct<name:string,type:string>>"}
    found = declarations(records).withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in none.items()})
    step = lambda rows, number: rows.withColumn("step", F.lit(number))
    modules = tops.filter("kind = 'module'").select("repository_id", "file_id", F.col("id").alias("module_id"), F.col("qualified_name").alias("module_name"), (F.col("ord") - 1).alias("file_ord"))
    names = records.filter("category = 'exports' and name is not null").select("repository_id", "file_id", "name").distinct()
    # Modules, exported names and declarations are dealt once, together: joined, all declarations would be dealt for each of them.
    rows = step(found, _DECLARED).unionByName(step(modules, _MODULE), allowMissingColumns=True).unionByName(step(names, _EXPORT), allowMissingColumns=True)
    rank = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(DEFINITIONS) for x in (c, i)]), F.col("category"))
    # A file, 1 MiB at most, is read in one task; a task reads many.
    rows = together(rows.select(*_READ, "ord"), "repository_id", "file_id").sortWithinPartitions("repository_id", "file_id", "step", "start_offset", F.desc("end_offset"), rank, "ord")
    return tops.unionByName(rows.select(*_READ).mapInArrow(_nest, SYMBOLS))


def check_unique(symbols: DataFrame) -> DataFrame:
    """Symbols, or an error when run if an id occurs twice."""
    counted = symbols.groupBy("repository_id", "id").agg(F.count("*").alias("n"))
    twice = counted.filter("n > 1").select("repository_id", "id", F.lit(True).alias("twice"))
    marked = symbols.join(twice, ["repository_id", "id"], "left")
    return marked.filter(F.when(F.col("twice"), F.raise_error(F.concat(F.lit("duplicate symbol id "), "id"))).otherwise(True).cast("boolean")).drop("twice")


def find_by_name(symbols: DataFrame, name: str, file_id: str | None = None, exported_only: bool = False) -> DataFrame:
    rows = symbols.filter(F.col("name") == name)
    rows = rows if file_id is None else rows.filter(F.col("file_id") == file_id)
    return (rows.filter("exported") if exported_only else rows).orderBy("ord")
