"""The pipeline against a brute-force version of its stages, and the registered queries."""

import collections
import re
import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from test_operators import brute_classes, brute_toxicity, words


def test_run_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            marks[r["doc_id"]] = max(marks.get(r["doc_id"], 0), r["toxic"])
    marks = {i: y for i, y in marks.items() if i in rows}
    half = {r["doc_id"]: r["half"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half")).collect()}
    toxic = {i for i, score in brute_toxicity(list(rows.items()), marks, half).items() if score >= 0.7}
    left = {i: t for i, t in rows.items() if i not in toxic}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i] or ""), i)
    left = {i: left[i] for i in first.values()}
    classes = brute_classes(list(left.items()))
    left = {i: t for i, t in left.items() if classes[i] == i}
    windows = set()
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[a : a + min(10, len(w))]) for a in range(len(w) - min(10, len(w)) + 1)} if w else set()
    sizes = {len(x) for x in windows}

    def clean(text):
        w = words(text)
        return not any(tuple(w[a : a + n]) in windows for n in sizes for a in range(len(w) - n + 1))

    want = {i for i, t in left.items() if clean(t)}
    got = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)
    assert all(r["parity"] and r["roundtrip"] for r in got)


def test_stages_on_odd_rows(spark, data):
    """Nulls, empty and repeated rows, clashing columns and empty tables, stage by stage."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = " ".join(f"word{i * i % 613}" for i in range(80))
    rows = [(None, None), (1, None), (2, ""), (3, text), (3, text), (4, text.replace(" ", "  ")), (5, text + " tail"), (None, text.upper()), (6, "short one")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint"), "kept": F.lit("x"), "digest": F.lit(1)})
    stages = dict(corpus_pipeline.STAGES)
    left = {name: stages[name](spark, odd, data) for name, _ in corpus_pipeline.STAGES[:-1]}
    assert all(frame.columns == odd.columns for frame in left.values())
    kept = {name: collections.Counter((r["doc_id"], r["text"] or "") for r in frame.collect()) for name, frame in left.items()}
    assert kept["toxicity"] == kept["decontamination"] == collections.Counter((i, t or "") for i, t in rows)
    assert kept["exact_dedup"] == collections.Counter([(1, ""), (3, text), (5, text + " tail"), (None, text.upper()), (6, "short one")])
    assert kept["near_dedup"] == collections.Counter([(None, ""), (1, ""), (2, ""), (3, text), (6, "short one")])
    encoded = stages["sentencepiece"](spark, odd, data).collect()
    assert len(encoded) == len(rows) and all(r["parity"] and r["roundtrip"] for r in encoded)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0
