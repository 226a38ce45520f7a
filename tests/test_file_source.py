"""The folder source: what it lists, what it never opens, and what it reads."""

from pyarrow import fs

from loomgraph.sources import file_source
from loomgraph.sources.files import MAX_BYTES, file_table, scan

FILES = {
    "one/src/a.js": b"let a;", "one/src/deep/er/b.py": b"b = 1", "one/node_modules/c.js": b"no", "one/src/dist/d.js": b"no", "one/logo.png": b"no", "one/top.md": b"# top", "two/x.go": b"", "two/.git/y.go": b"no", "beside.txt": b"no",
    "two/big.js": b"x" * (MAX_BYTES + 1), "two/edge.js": b"x" * MAX_BYTES, "two/bin.js": b"a\0b",
}
KEPT = {("one", "src/a.js"), ("one", "src/deep/er/b.py"), ("one", "top.md"), ("two", "x.go"), ("two", "big.js"), ("two", "edge.js"), ("two", "bin.js")}


def laid_out(top):
    for name, content in FILES.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(top)


class Watched:
    """A file system that remembers which folders were listed."""

    def __init__(self):
        self.files, self.listed = fs.LocalFileSystem(), []

    def get_file_info(self, selector):
        self.listed.append(selector.base_dir)
        return self.files.get_file_info(selector)


def test_ignored_folders_are_never_listed(tmp_path):
    watched, root = Watched(), laid_out(tmp_path)
    found = {f.path.removeprefix(root + "/") for f in file_source.walk(watched, root)}
    assert found == {f"{a}/{b}" for a, b in KEPT} | {"beside.txt"}
    assert not [p for p in watched.listed if "node_modules" in p or "dist" in p or ".git" in p] and len(watched.listed) == 6


def test_partitions_cover_every_folder_once(tmp_path):
    root = laid_out(tmp_path)
    for levels in (0, 1, 2, 5):
        reader = file_source.Reader({"path": root, "levels": str(levels), "repositories": "true"})
        rows = [r for part in reader.partitions() for batch in reader.read(part) for r in zip(*(batch.column(c).to_pylist() for c in ("source", "relative", "content")), strict=True)]
        assert len(rows) == len(KEPT) and {r[:2] for r in rows} == KEPT
        assert all(content == (FILES[f"{a}/{b}"] if len(FILES[f"{a}/{b}"]) <= MAX_BYTES else None) for a, b, content in rows)
    assert len(file_source.Reader({"path": root, "levels": "1"}).partitions()) == 3


def test_scan_of_folders_equals_spark_scan(spark, tmp_path):
    root = laid_out(tmp_path)
    by_folder = file_table(file_source.scan_folders(spark, f"{root}/two"), "two").drop("last_modified", "absolute_path")
    by_spark = scan(spark, f"{root}/two", "two").drop("last_modified", "absolute_path")
    # Spark's own reader leaves out files without content.
    assert {r["path"] for r in by_folder.filter("size = 0").collect()} == {"x.go"} and by_folder.count() == 4
    kept = by_folder.filter("size > 0").drop("ord").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted(map(tuple, by_spark.drop("ord").collect()), key=repr)
    both = file_source.scan_folders(spark, f"file:{root}", repositories=True, content=False).collect()
    assert {(r["source"], r["relative"]) for r in both} == KEPT and {r["content"] for r in both} == {None}
    assert file_source.scan_folders(spark, str(tmp_path / "one/src/deep/er"), levels=0).count() == 1


def test_layout_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r", f"d{i % 3}/f{i}.py", bytearray(f"text {i}".encode())) for i in range(40)], "source string, path string, content binary").repartition(4)
    assert file_source.lay_out(rows, str(tmp_path / "out")) == 40
    back = file_source.scan_folders(spark, str(tmp_path / "out"), repositories=True).selectExpr("source", "relative", "content")
    assert sorted(map(repr, back.collect())) == sorted(repr(r).replace("path=", "relative=") for r in rows.collect())
