"""Paths, retrieval, the chunk store, the catalog and the job stream."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import paths, text
from loomgraph.operators import catalog, rag, resolve
from loomgraph.schemas import CHUNKS, JOBS
from loomgraph.sources import vector_store, versions
from loomgraph.streaming import jobs


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_path_functions(spark):
    got = lambda c, p: one(spark, c(F.col("p")), p=p)
    assert got(paths.normalized, ".\\a\\b.js") == "a/b.js" and got(paths.without_extension, "a/.env") == "a/.env" and got(paths.without_extension, "a.b/c.d.ts") == "a.b/c.d"
    assert [got(paths.language, p) for p in ("a.tsx", "a.JS", "b/c.yml", "x", ".py")] == ["react-ts", "unknown", "yaml", "unknown", "unknown"]
    assert got(paths.prefixes, "a/b/c.js") == ["a", "a/b"] and got(paths.prefixes, "c.js") == []
    assert [got(paths.ignored, p) for p in ("dist/a.js", "a/.git/x", "x.lock", "distant/a.js", "build")] == [True, True, True, False, False]
    for base, rel, want in [("a/b", "../c", "a/c"), ("", "./x", "x"), ("a", "../../x", "../x"), ("a", "./b//c/.", "a/b/c"), ("a", "./b/", None)]:
        assert one(spark, paths.joined(F.col("b"), F.col("r")), b=base, r=rel) == want
    assert got(paths.web_clone_url, "https://api.github.com/repos/o/r/") == "https://github.com/o/r.git" and got(paths.web_clone_url, "https://x/y") == "https://x/y"
    assert got(text.utf16_length, "a😀") == 3 and got(text.trigrams, "ab") == ["ab"] and got(text.trigrams, "") == [] and got(text.trigrams, "abcabc") == ["abc", "bca", "cab"]


def test_module_resolution(spark):
    files = spark.createDataFrame([("r", p, i) for i, p in enumerate(["src/foo.js", "src/dir/index.js", "src/x.ts", "src/y.jsx"])], "repository_id string, path string, ord bigint")
    asked = ["./foo", "./foo/index", "./dir", "./x.js", "./y", "../src/foo.js", "lodash", "./none"]
    imports = spark.createDataFrame([("r", "src/main.js", "src/main.js", m, i) for i, m in enumerate(asked)], "repository_id string, file_id string, path string, module string, ord bigint")
    got = {r["module"]: r["target_file"] for r in resolve.resolve_modules(imports, files).collect()}
    assert got == {"./foo": "src/foo.js", "./foo/index": "src/foo.js", "./dir": None, "./x.js": None, "./y": "src/y.jsx", "../src/foo.js": "src/foo.js", "lodash": None, "./none": None}
    assert {r["module"]: r["target_file"] for r in resolve.resolve_modules(imports, files, resolve_index=True).collect()}["./dir"] == "src/dir/index.js"


def test_limits_and_checks(spark):
    assert [rag.safe_limit(x) for x in (None, 0, "x", float("nan"), -3, 7, "9", 99)] == [5, 5, 5, 5, 1, 7, 9, 20]
    with pytest.raises(ValueError):
        rag.retrieve(None, "  ", "r", rag.hashing_embedder())
    with pytest.raises(ValueError):
        rag.retrieve(None, "q", "", rag.hashing_embedder())


def chunk_rows(spark, texts, repository="r"):
    base = spark.createDataFrame([(f"chunk:{i}", t) for i, t in enumerate(texts)], "id string, content string")
    meta = F.from_json(F.to_json(F.struct(F.lit(repository).alias("repository_id"), F.lit("a.js").alias("file_path"))), CHUNKS.split("metadata ")[1].split(", embedding array")[0].removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", "))
    return base.select("id", F.lit("function").alias("chunk_type"), F.col("id").alias("symbol_id"), F.lit("function").alias("symbol_type"), F.col("id").alias("symbol_name"), F.lit(None).cast("string").alias("parent_symbol"), "content", meta.alias("metadata"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(1).alias("embedding_version"))


def test_store_and_answer(spark, tmp_path):
    embedder = rag.hashing_embedder()
    texts = ["open the door", "close the window", "paint a wall"]
    path = str(tmp_path / "store")
    first = rag.embed_chunks(chunk_rows(spark, texts), embedder)
    assert vector_store.write_upsert(spark, path, first) == {"stored": 3, "matched": 0, "modified": 0, "upserted": 3}
    assert vector_store.write_upsert(spark, path, first)["modified"] == 0
    changed = rag.embed_chunks(chunk_rows(spark, ["open the gate"]), embedder)
    assert vector_store.write_upsert(spark, path, changed) == {"stored": 1, "matched": 1, "modified": 1, "upserted": 0}
    other = rag.embed_chunks(chunk_rows(spark, ["open the gate"], "other"), embedder)
    vector_store.write_upsert(spark, path, other)
    schema = vector_store.schema_of(first)
    assert vector_store.read(spark, path, schema).count() == 4
    assert vector_store.write_upsert(spark, path, first.limit(0))["stored"] == 0
    with pytest.raises(ValueError):
        vector_store.write_upsert(spark, path, chunk_rows(spark, ["x"]))
    table = vector_store.read(spark, path, schema)
    hits = [r["content"] for r in rag.retrieve(table, "close the window", "r", embedder, 2).collect()]
    assert hits[0] == "close the window" and len(hits) == 2
    seen = []
    reply = '{"answer": "yes", "confidence": 0.5, "sources": [{"chunkId": "chunk:1", "filePath": "a.js", "symbolName": "f", "startLine": 1, "endLine": 2}], "followup_questions": []}'
    memory = spark.createDataFrame([("user", "hi", 0), ("assistant", None, 1)], "role string, content string, ord int")
    row = rag.answer(table, "close the window", "r", embedder, lambda p: seen.append(p) or reply, 2, memory).first()
    assert row["parsed"]["answer"] == "yes" and row["parsed"]["sources"][0]["chunkId"] == "chunk:1" and row["parsed"]["sources"][0]["endLine"] == 2
    assert [c["content"] for c in row["chunks"]] == hits and row["chunks"][0]["score"] > row["chunks"][1]["score"] and row["chunks"][0]["file_path"] == "a.js"
    plan = rag.retrieve(table, "close the window", "r", embedder, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repository_id" in plan
    twice = first.unionByName(first.withColumn("content", F.lit("zzz")))
    assert vector_store.write_upsert(spark, path, twice)["stored"] == 3 and vector_store.read(spark, path, schema).filter("repository_id = 'r' and content = 'zzz'").count() == 3
    assert "USER: hi" in seen[0] and "LINES: ?-?" in seen[0] and seen[0].index("CHUNK_ID: chunk:1") < seen[0].index("\n\n---\n\n")
    assert "No matching" in rag.build_prompt("q", None) and "\nNone\n" in rag.build_prompt("q", None) and rag.build_prompt("q", "c", instructions="own").startswith("own\n")


def test_versions_are_atomic(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "table"), "repository_id string, id string, content string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    seen = lambda v=None: {tuple(r) for r in versions.read(spark, path, schema, v).select("repository_id", "id", "content").collect()}
    assert seen() == set()
    first = rows(("a", "1", "x"), ("b", "2", "y"))
    assert versions.write(spark, path, schema, lambda old: first, first) == 1
    reader = versions.read(spark, path, schema)
    assert versions.write(spark, path, schema, lambda old: old.withColumn("content", F.lit("z")), first.filter("repository_id = 'a'")) == 2
    assert seen() == {("a", "1", "z"), ("b", "2", "y")} and seen(1) == {("a", "1", "x"), ("b", "2", "y")}
    assert {tuple(r) for r in reader.collect()} == seen(1)

    # A write that dies before its commit leaves what is there readable.
    def die(*args):
        raise RuntimeError("lost")

    commit = versions._commit
    monkeypatch.setattr(versions, "_commit", die)
    with pytest.raises(RuntimeError):
        versions.write(spark, path, schema, lambda old: rows(("a", "1", "half")), first)
    assert seen() == {("a", "1", "z"), ("b", "2", "y")} and versions.versions(spark, path) == [1, 2]

    # Another writer commits first: the change is made again on what that one wrote.
    def late(spark_, where, number, name):
        if versions._commit is late:
            monkeypatch.setattr(versions, "_commit", commit)
            versions.write(spark, path, schema, lambda old: old.withColumn("content", F.concat("content", F.lit("1"))), first)
        return commit(spark_, where, number, name)

    monkeypatch.setattr(versions, "_commit", late)
    assert versions.write(spark, path, schema, lambda old: old.withColumn("content", F.concat("content", F.lit("2"))), first) == 4
    assert seen() == {("a", "1", "z12"), ("b", "2", "y12")}
    with pytest.raises(versions.Conflict):
        commit(spark, path, 4, "x")
    # A repository without rows goes; old versions and lost writes are swept up.
    assert versions.write(spark, path, schema, lambda old: old.limit(0), first.filter("repository_id = 'b'")) == 5
    assert versions.vacuum(spark, path) == 6 - len({r["write"] for r in versions._manifest(spark, path, 5).collect()}) + 1
    assert seen() == {("a", "1", "z12")} and versions.versions(spark, path) == [5]


def test_catalog_rules(spark):
    old = spark.createDataFrame([(1, "QUEUED", 0), (2, "FAILED", 100)], "github_repository_id int, status string, progress int")
    new = spark.createDataFrame([(1, "PARSING", None), (2, "BROKEN", 5), (3, "CLONING", 101)], old.schema)
    got = {tuple(r) for r in catalog.update_status(old, new).collect()}
    assert got == {(1, "PARSING", 0), (2, "FAILED", 100)}
    again = catalog.retry(old, spark.createDataFrame([(1,), (2,)], "github_repository_id int")).collect()
    assert [(r["github_repository_id"], r["status"]) for r in again] == [(2, "QUEUED")]
    failed = spark.createDataFrame([("a", 1, "FAILED", 100, "boom"), ("b", 1, "FAILED", 100, "boom"), ("a", 2, "COMPLETED", 100, None)], "owner string, github_repository_id int, status string, progress int, last_error string")
    queued = catalog.retry(failed, failed.filter("owner = 'a'"))
    after = {tuple(r) for r in catalog.merge(failed, queued, catalog.KEYS, ("status", "progress", "last_error")).collect()}
    assert after == {("a", 1, "QUEUED", 0, None), ("b", 1, "FAILED", 100, "boom"), ("a", 2, "COMPLETED", 100, None)}
    steps = spark.createDataFrame([("a", 1, "CLONING", 5, 1), ("a", 1, "PARSING", 45, 3), ("a", 1, "SCANNING", 25, 2), ("a", 1, "BROKEN", 1, 9)], "owner string, github_repository_id int, status string, progress int, at int")
    moved = catalog.update_status(failed.withColumn("at", F.lit(0)), steps.withColumn("last_error", F.lit(None).cast("string")), ["at"])
    assert [(r["status"], r["progress"]) for r in moved.filter("owner = 'a' and github_repository_id = 1").collect()] == [("PARSING", 45)] and moved.count() == 3
    wanted = spark.createDataFrame([("a", 1, "i", "u1"), ("b", 2, "i", "u3"), ("b", 2, "i", "u2"), ("c", 1, "i", "u4")], "owner string, github_repository_id int, installation_id string, clone_url string")
    accepted, made, rejected = catalog.import_repositories(failed, wanted)
    assert sorted((r["user_id"], r["repository_id"], r["clone_url"]) for r in made.collect()) == [("b", 2, "u2"), ("c", 1, "u4")] and accepted.count() == 2
    assert [(r["owner"], r["github_repository_id"]) for r in rejected.collect()] == [("a", 1)]
    installs = spark.createDataFrame([("u", 1, True, 5, "a"), ("u", 2, True, 6, "b"), ("u", 3, False, 9, "c")], "user_id string, installation_id int, installed boolean, updated_at int, x string")
    assert catalog.latest_installation(installs).first()["installation_id"] == 2
    api = spark.createDataFrame([(7, "n", "o/n", None, None, True, None)], "id int, name string, full_name string, default_branch string, topics array<string>, private boolean, size int")
    row = catalog.map_repository(api).first()
    assert row["default_branch"] == "main" and row["topics"] == [] and row["visibility"] == "private" and row["size"] == 0
    assert one(spark, catalog.progress_of(F.col("s")), s="INDEXING") == 65


def test_job_stream(spark, tmp_path):
    queue, check, dead = str(tmp_path / "q"), str(tmp_path / "c"), str(tmp_path / "d")
    rows = spark.createDataFrame([("u", 1, "i", "url"), ("u", 2, "i", "url"), ("u", 13, "i", "url")], JOBS)
    jobs.publish(spark, queue, rows)
    spark.createDataFrame([("not json",)], "value string").write.mode("append").text(f"{queue}/repo-analysis")
    with pytest.raises(ValueError):
        jobs.publish(spark, queue, rows, "elsewhere")
    done = []

    def handle(frame):
        ids = [r["repository_id"] for r in frame.collect()]
        if 13 in ids:
            raise RuntimeError("poisoned")
        done.extend(ids)

    for _ in range(2):  # the second run finds everything acknowledged
        jobs.consume(spark, queue, check, dead, handle).awaitTermination()
    assert sorted(done) == [1, 2]
    assert sorted(r["error"] for r in spark.read.parquet(dead).collect()) == ["not a job", "poisoned"]


def test_a_handler_that_is_down_keeps_its_jobs(spark, tmp_path, monkeypatch):
    queue, check, dead = str(tmp_path / "q"), str(tmp_path / "c"), str(tmp_path / "d")
    jobs.publish(spark, queue, spark.createDataFrame([("u", i, "i", "url") for i in range(40)], JOBS))
    monkeypatch.setattr(jobs, "MAX_CALLS", 9)
    calls, done = [], []

    def down(frame):
        calls.append(1)
        raise RuntimeError("down")

    with pytest.raises(Exception, match="over and over"):
        jobs.consume(spark, queue, check, dead, down).awaitTermination()
    assert len(calls) == 9
    jobs.consume(spark, queue, check, dead, lambda f: done.extend(r["repository_id"] for r in f.collect())).awaitTermination()
    assert sorted(done) == list(range(40))


def test_jobs_handled_one_by_one_in_the_tasks(spark, tmp_path):
    queue, check, dead, out = (str(tmp_path / n) for n in "qcdo")
    jobs.publish(spark, queue, spark.createDataFrame([("u", i, "i", "url") for i in range(40)], JOBS).repartition(3))
    spark.createDataFrame([("not json",)], "value string").write.mode("append").text(f"{queue}/repo-analysis")

    def handle(job):
        import os

        os.makedirs(out, exist_ok=True)
        with open(f"{out}/{job['repository_id']}", "a") as file:
            file.write("x")
        if job["repository_id"] % 10 == 3:
            raise RuntimeError("poisoned")

    def down(job):
        raise RuntimeError("down")

    with pytest.raises(Exception, match="40 of 40 jobs failed"):
        jobs.consume_each(spark, queue, check, dead, down).awaitTermination()
    for _ in range(2):
        jobs.consume_each(spark, queue, check, dead, handle).awaitTermination()
    tries = {int(f.name): len(f.read_text()) for f in (tmp_path / "o").iterdir()}
    assert tries == {i: 3 if i % 10 == 3 else 1 for i in range(40)}
    assert sorted(r["error"] for r in spark.read.parquet(dead).collect()) == ["not a job", *["poisoned"] * 4]
