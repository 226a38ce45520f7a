"""Resolving imports, exports, calls and inheritance to symbols, as joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.paths import folder, joined, normalized, without_extension
from loomgraph.session import stored, together

from .graph import CALLS, EXPORTS, EXTENDS, IMPLEMENTS, IMPORTS
from .symbols import DEFINITIONS, OWNERS, declarations, declared

REPO = "repository_id"
# Endings tried on a module's path, in this order.
ENDINGS = (".js", ".mjs", ".cjs", ".ts", ".tsx", ".py", ".java", ".go", ".rs")
_FILE = [REPO, "file_id"]
#: More than a thousand times the places of the references of one step in one file, 1 MiB long at most.
_WITHIN = 1 << 32


def file_index(files: DataFrame, resolve_index: bool = False) -> DataFrame:
    """(repository_id, key, target_file): paths, bare paths and ``<bare path>/index``; the last file wins.

    ``resolve_index`` adds the folder of index files, so that ``./dir`` finds ``dir/index.js``.
    """
    bare = without_extension(F.col("path"))
    keys = [F.col("path"), bare, F.concat(bare, F.lit("/index"))]
    if resolve_index:
        keys.append(F.when(bare.endswith("/index"), F.regexp_replace(bare, "/index$", "")))
    rows = files.select(REPO, "path", "ord", F.explode(F.array(*keys)).alias("key")).filter("key is not null")
    return rows.groupBy(REPO, "key").agg(F.max_by("path", "ord").alias("target_file"))


def resolve_modules(imports: DataFrame, files: DataFrame, resolve_index: bool = False) -> DataFrame:
    """Import records with ``target_file``: relative modules only; the path as it is, then with each ending."""
    base = F.when(F.col("module").startswith("."), joined(folder(F.col("path")), F.col("module")))
    tried = F.array(F.col("base"), *[F.concat("base", F.lit(e)) for e in ENDINGS])
    keyed = imports.withColumn("base", base)
    probes = keyed.filter("base is not null").select(REPO, "file_id", F.col("ord").alias("import_ord"), F.posexplode(tried).alias("rank", "key"))
    hits = probes.join(file_index(files, resolve_index), [REPO, "key"]).groupBy(REPO, "file_id", "import_ord").agg(F.min_by("target_file", "rank").alias("target_file"))
    return keyed.drop("base").join(hits.withColumnRenamed("import_ord", "ord"), [REPO, "file_id", "ord"], "left")


def _first(symbols: DataFrame, *keys: str) -> DataFrame:
    """The first definition (neither file nor module) for each key: (keys, target)."""
    rows = symbols.filter("kind not in ('file', 'module')")
    return rows.groupBy(*keys).agg(F.min_by("id", "ord").alias("target"))


def default_exports(records: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repository_id, file_id, target): each file's first default export, if it names a local definition."""
    first = records.filter("category = 'exports' and kind = 'default'").groupBy(*_FILE).agg(F.min_by("name", "ord").alias("name"))
    return first.join(_first(symbols, REPO, "file_id", "name"), [REPO, "file_id", "name"]).select(REPO, "file_id", "target")


def resolve_bindings(imports: DataFrame, records: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repository_id, file_id, local, imported, target_file, target, ord) of every binding; later ones override."""
    rows = imports.select(REPO, "file_id", "target_file", F.col("ord"), F.posexplode("bindings").alias("i", "b"))
    rows = rows.select(REPO, "file_id", "target_file", (F.col("ord") * 1000 + F.col("i")).alias("ord"), F.col("b.imported").alias("imported"), F.col("b.local").alias("local"))
    modules = symbols.filter("kind = 'module'").select(REPO, F.col("file_id").alias("target_file"), F.col("id").alias("module_target"))
    defaults = default_exports(records, symbols).select(REPO, F.col("file_id").alias("target_file"), F.col("target").alias("default_target"))
    named = _first(symbols.filter("exported"), REPO, "file_id", "name").select(REPO, F.col("file_id").alias("target_file"), F.col("name").alias("imported"), F.col("target").alias("named_target"))
    joined_rows = rows.join(modules, [REPO, "target_file"], "left").join(defaults, [REPO, "target_file"], "left").join(named, [REPO, "target_file", "imported"], "left")
    target = F.when(F.col("imported") == "*", F.col("module_target")).when(F.col("imported") == "default", F.col("default_target")).otherwise(F.col("named_target"))
    return joined_rows.select(REPO, "file_id", "local", "imported", "target_file", target.alias("target"), "ord")


def resolve_names(wanted: DataFrame, bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``target`` to rows (repository_id, file_id, wanted): what a dotted name refers to.

    A root bound to a file of the repository is that binding's target, or the target's member named
    last; it never falls back.  Other roots are definitions of the file, else exported ones anywhere.
    """
    root, member = F.substring_index("wanted", ".", 1), F.substring_index("wanted", ".", -1)
    # Many references of a file share a name, and most share few: a name is looked up once a file.
    rows = wanted.select(*_FILE, "wanted").distinct().withColumns({"root": root, "member": member})
    last = bindings.groupBy(REPO, "file_id", F.col("local").alias("root")).agg(F.max_by(F.struct("target_file", "target"), "ord").alias("bound"))
    last = last.filter("bound.target_file is not null").select(REPO, "file_id", "root", F.col("bound.target").alias("bound_target"), F.lit(True).alias("bound"))
    members = symbols.filter("parent is not null").groupBy(REPO, F.col("parent").alias("bound_target"), F.col("name").alias("member")).agg(F.min_by("id", "ord").alias("member_target"))
    local = _first(symbols, REPO, "file_id", "name").select(REPO, "file_id", F.col("name").alias("root"), F.col("target").alias("local_target"))
    anywhere = _first(symbols.filter("exported"), REPO, "name").select(REPO, F.col("name").alias("root"), F.col("target").alias("global_target"))
    full = rows.join(last, [REPO, "file_id", "root"], "left").join(members, [REPO, "bound_target", "member"], "left").join(local, [REPO, "file_id", "root"], "left").join(anywhere, [REPO, "root"], "left")
    target = F.when(F.col("bound"), F.when(F.col("member") != F.col("root"), F.coalesce("member_target", "bound_target")).otherwise(F.col("bound_target"))).otherwise(F.coalesce("local_target", "global_target"))
    found = full.select(*_FILE, "wanted", target.alias("target")).filter("target is not null")
    return wanted.join(found, [*_FILE, "wanted"], "left").select(*wanted.columns, "target")


_EVENTS = [REPO, "file_id", "start_offset", "end_offset", "scope_id"]


def _innermost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads scopes and places of many files in order of their starts and gives each place the innermost open scope.

    ``open_scopes`` are those of the file that started and haven't ended, the last one on top.  Scopes of a file nest,
    so the one on top is the answer; where they don't, the search goes on below.  Further columns of a place stay with it.
    """
    file, open_scopes = None, []
    for batch in batches:
        met: list[int] = []
        found: list[str] = []
        for row, (repo, file_id, start, end, scope_id) in enumerate(zip(*(batch.column(c).to_pylist() for c in _EVENTS), strict=True)):
            if (repo, file_id) != file:
                file, open_scopes = (repo, file_id), []
            while open_scopes and open_scopes[-1][0] < start:
                open_scopes.pop()
            if scope_id is None:
                scope = next((s for e, s in reversed(open_scopes) if e >= end), None)
                if scope is not None:
                    met.append(row)
                    found.append(scope)
            else:
                open_scopes.append((end, scope_id))
        rows = pa.array(met, pa.int64())
        kept = [c for c in batch.schema.names if c != "scope_id"]
        columns = [*(batch.column(c).take(rows) for c in kept), pa.array(found, batch.schema.field("scope_id").type)]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, "scope"])


def containing_scopes(places: DataFrame, symbols: DataFrame, *keep: str) -> DataFrame:
    """(repository_id, file_id, start_offset, end_offset, scope): the innermost scope around a place.

    Of scopes that start together the outermost wins.  Scopes and places of a file are sorted once, by where they start,
    and read in one sweep; a task reads many files.  With columns to ``keep`` every row of ``places`` that lies in a scope
    comes back with them, so that it needn't be joined to its scope again.
    """
    by = [*_FILE, "start_offset", "end_offset"]
    scopes = symbols.filter(F.col("kind").isin(list(OWNERS))).select(*by, F.col("id").alias("scope_id"), F.col("ord").alias("scope_ord"))
    met = places.filter("start_offset is not null and end_offset is not null").select(*by, *keep)
    met = (met if keep else met.distinct()).withColumns({"scope_id": F.lit(None).cast("string"), "scope_ord": F.lit(0).cast("bigint")})
    # Of scopes that start together the last one read is on top: the longest, and of equal ones the first.
    order = [*_FILE, "start_offset", F.col("scope_id").isNull(), "end_offset", F.desc("scope_ord")]
    rows = together(met.unionByName(scopes.filter("start_offset is not null"), allowMissingColumns=True), *_FILE).sortWithinPartitions(*order).select(*_EVENTS, *keep)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_innermost, ", ".join(f"{c} {kinds[c]}" for c in (*by, *keep)) + ", scope string")


def within_scopes(places: DataFrame, records: DataFrame) -> DataFrame:
    """Those of ``places`` that ``containing_scopes`` finds a scope for, which one isn't told: of the scopes that start no later than
    a place, some one ends no earlier.  Scopes are read from the declarations, so no symbol is made."""
    owners = [category for category, kind in DEFINITIONS.items() if kind in OWNERS]
    more = [c for c in places.columns if c not in (*_FILE, "start_offset", "end_offset")]
    nothing = [F.lit(None).cast(places.schema[c].dataType).alias(c) for c in more]
    scopes = declarations(records).filter(F.col("category").isin(owners)).select(*_FILE, "start_offset", F.col("end_offset").alias("reach"), F.lit(False).alias("is_place"), F.lit(None).cast("int").alias("end_offset"), *nothing)
    met = places.filter("start_offset is not null and end_offset is not null").select(*_FILE, "start_offset", F.lit(None).cast("int").alias("reach"), F.lit(True).alias("is_place"), "end_offset", *more)
    # Rows are sorted by a number first: repositories are few, so texts that begin with them are slow to tell apart.
    before = Window.partitionBy("file_key", *_FILE).orderBy("start_offset", "is_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = scopes.filter("start_offset is not null").unionByName(met).withColumn("file_key", F.xxhash64(*_FILE)).withColumn("reach", F.max("reach").over(before))
    return rows.filter("is_place and reach >= end_offset").select(*places.columns)


def _heritage(classes: DataFrame, split_implements: bool) -> tuple[DataFrame, DataFrame]:
    """Class records with ``wanted``, the name of what they extend; and with each name of what they implement, at ``i``."""
    listed = F.filter(F.flatten(F.transform("implements", lambda x: F.split(x, ","))), lambda x: x != "") if split_implements else F.col("implements")
    kept = [c for c in classes.columns if c not in ("extends", "implements", "name")]
    return classes.filter("extends is not null").select(*kept, F.col("extends").alias("wanted")), classes.select(*kept, F.posexplode(listed).alias("i", "wanted"))


#: What ``between_files`` reads of ``ast_records``.
BETWEEN = (REPO, "file_id", "path", "category", "name", "kind", "module", "bindings", "extends", "implements", "exported", "callee", "start_offset", "end_offset", "ord")


def between_files(files: DataFrame, records: DataFrame, outer: DataFrame | None = None, resolve_index: bool = False, split_implements: bool = False) -> DataFrame:
    """The relations of ``resolve`` between different files, each pair of files once a relation, with the files as their ends.

    Whatever a name is found to mean in a file lies in that file, so a declaration is as good as its file here: no symbol is made,
    and a name is looked up once a file.  ``outer`` are the records that may be exported or be meant by a name, where that
    is known to be fewer; calls, and the scopes that they must lie in, are read from all ``records``.
    """
    outer = records if outer is None else outer
    at = files.select(REPO, normalized(F.col("path")).alias("file_id"), F.col("ord").alias("file_ord"))
    names = declared(outer).groupBy(*_FILE, "name").agg(F.max("exported").alias("exported")).withColumn("kind", F.lit("declaration"))
    modules = at.select(*_FILE, F.lit(None).cast("string").alias("name"), F.lit(False).alias("exported"), F.lit("module").alias("kind"))
    symbols = stored(names.unionByName(modules).join(at, _FILE), "file-names")
    symbols = symbols.select(REPO, F.col("file_id").alias("id"), "name", "kind", F.lit(None).cast("string").alias("parent"), "file_id", "exported", F.col("file_ord").alias("ord"))
    imports = stored(resolve_modules(outer.filter("category = 'imports'").select(*_FILE, "path", "module", "bindings", "ord"), files, resolve_index), "file-imports")
    bindings = stored(resolve_bindings(imports, outer, symbols), "file-bindings")
    calls = within_scopes(records.filter("category = 'calls'").select(*_FILE, F.col("callee").alias("wanted"), "start_offset", "end_offset"), records)
    bases, kinds = _heritage(declarations(outer).filter("category = 'classes'").select(*_FILE, "name", "extends", "implements"), split_implements)
    wanted = [rows.select(*_FILE, "wanted").distinct().withColumn("relation", F.lit(name)) for rows, name in ((calls, CALLS), (bases, EXTENDS), (kinds, IMPLEMENTS))]
    wanted = wanted[0].unionByName(wanted[1]).unionByName(wanted[2]).withColumn("root", F.substring_index("wanted", ".", 1))
    # What a file declares and binds to no other file is meant there; of the rest only exported names are looked for.
    bound = bindings.filter("target_file is not null").select(*_FILE, F.col("local").alias("root"))
    meant = symbols.filter("kind = 'declaration'").select(*_FILE, F.col("name").alias("root")).join(bound, [*_FILE, "root"], "left_anti")
    rest = stored(wanted.join(meant, [*_FILE, "root"], "left_anti").drop("root"), "file-wanted")
    met = resolve_names(rest, bindings, symbols.filter("exported")).select(*_FILE, "target", "relation")
    met = met.unionByName(imports.select(*_FILE, F.col("target_file").alias("target"), F.lit(IMPORTS).alias("relation"))).filter("target <> file_id").distinct()
    file_id = lambda column: F.concat(F.lit("file:"), column)
    return met.join(at, _FILE).select(REPO, file_id("file_id").alias("source"), file_id("target").alias("target"), "relation", F.lit("{}").alias("metadata_json"), F.col("file_ord").alias("ord"))


def resolve(files: DataFrame, records: DataFrame, symbols: DataFrame, resolve_index: bool = False, split_implements: bool = False) -> tuple[DataFrame, DataFrame]:
    """(relations, references): the relations found, and every reference with its target and whether it has one."""
    imports = resolve_modules(records.filter("category = 'imports'"), files, resolve_index)
    bindings = resolve_bindings(imports, records, symbols)
    file_id = F.concat(F.lit("file:"), "file_id")
    places = files.select(REPO, F.col("path").alias("file_id"), F.col("ord").alias("file_ord")).join(records.groupBy(*_FILE).agg(F.min("ord").alias("first")), _FILE)

    def relation(rows: DataFrame, source, target, name: str, metadata, step: int, turn=None) -> DataFrame:
        """Ordered by file, then step (imports, exports, calls, heritage), then place in the file, then ``turn``."""
        found = rows.filter(source.isNotNull() & target.isNotNull()).join(places, _FILE)
        place = (F.col("file_ord") * 4 + step) * _WITHIN + (F.col("ord") - F.col("first")) * 1000 + (F.lit(0) if turn is None else turn)
        return found.select(REPO, source.alias("source"), target.alias("target"), F.lit(name).alias("relation"), metadata.alias("metadata_json"), place.alias("ord"))

    meta = lambda key, column: F.to_json(F.struct(F.col(column).alias(key)))
    nothing = F.lit("{}")
    exports = records.filter("category = 'exports'").join(_first(symbols, REPO, "file_id", "name"), [REPO, "file_id", "name"], "left")
    calls = records.filter("category = 'calls'").select(*_FILE, F.col("callee").alias("wanted"), "start_offset", "end_offset", "ord")
    calls = resolve_names(calls, bindings, symbols)
    within = containing_scopes(calls.filter("target is not null"), symbols, "wanted", "target", "ord")
    classes = records.filter("category = 'classes'").select(*_FILE, "name", "extends", "implements", "ord")
    own = _first(symbols.filter("kind = 'class'"), REPO, "file_id", "name").withColumnRenamed("target", "class_id")
    classes = classes.join(own, [REPO, "file_id", "name"], "left")
    bases, kinds = (resolve_names(rows, bindings, symbols) for rows in _heritage(classes, split_implements))
    relations = (
        relation(imports, file_id, F.concat(F.lit("file:"), "target_file"), IMPORTS, meta("module", "module"), 0)
        .unionByName(relation(exports, file_id, F.col("target"), EXPORTS, meta("kind", "kind"), 1))
        .unionByName(relation(within, F.col("scope"), F.col("target"), CALLS, meta("callee", "wanted"), 2))
        .unionByName(relation(bases, F.col("class_id"), F.col("target"), EXTENDS, nothing, 3))
        .unionByName(relation(kinds, F.col("class_id"), F.col("target"), IMPLEMENTS, nothing, 3, F.col("i") + 1))
    )

    def reference(rows: DataFrame, kind: str, name, target) -> DataFrame:
        return rows.select(REPO, "file_id", F.lit(kind).alias("reference"), name.alias("name"), target.alias("target"), target.isNotNull().alias("resolved"))

    references = (
        reference(imports, "import", F.col("module"), F.concat(F.lit("file:"), "target_file"))
        .unionByName(reference(bindings, "binding", F.col("imported"), F.col("target")))
        .unionByName(reference(exports, "export", F.col("name"), F.col("target")))
        .unionByName(reference(calls, "call", F.col("wanted"), F.col("target")))
        .unionByName(reference(bases, "extends", F.col("wanted"), F.col("target")))
        .unionByName(reference(kinds, "implements", F.col("wanted"), F.col("target")))
    )
    return relations, references


__all__ = ["between_files", "containing_scopes", "default_exports", "file_index", "resolve", "resolve_bindings", "resolve_modules", "resolve_names", "within_scopes"]
