"""The byte network against plain loops, its gradients, and held-out labels."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import quality

DOCS = "doc_id bigint, text string, score double, held_out string"


def plain(net, text):
    """The score of one text, place by place."""
    hidden = []
    if text:
        data = np.frombuffer(text, np.uint8)
        blocks = -(-(len(data) + quality.AHEAD) // quality.BLOCK)
        padded = np.concatenate([data, np.zeros(blocks * quality.BLOCK - len(data), np.uint8)])
        top = []
        for b in range(blocks):
            at = [b * quality.BLOCK + i * quality.STRIDE for i in range(quality.PLACES)]
            reads = [net.embed[padded[i : i + quality.WIDTH]].reshape(-1) for i in at if i + quality.WIDTH <= len(padded)]
            top.append((np.array(reads) @ net.filters).max(axis=0))
        chunks = [np.maximum(a, b) for a, b in zip(top, top[1:], strict=False)] or top
        hidden = [np.maximum(np.maximum(c + net.bias, 0) @ net.hidden + net.shift, 0) for c in chunks]
    logit = net.intercept[0] + (np.mean(hidden, axis=0) @ net.out if hidden else 0)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def test_scores_equal_plain_loops(monkeypatch):
    monkeypatch.setattr(quality, "AT_ONCE", 3)
    net, draw = quality.rounded(quality.fresh()), np.random.default_rng(0)
    net.intercept[:] = 0.3
    texts = [draw.integers(1, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 7, 250, 252, 253, 256, 511, 512, 513, 5_000, 0, 3)]
    assert np.allclose(quality.scores(net, texts), [plain(net, t) for t in texts], atol=2e-6)
    assert np.array_equal(quality.scores(net, texts), np.concatenate([quality.scores(net, [t]) for t in texts]))
    assert len(quality.scores(net, [])) == 0


def test_gradients():
    net, draw = quality.fresh(), np.random.default_rng(1)
    chunks = draw.integers(0, 256, (5, quality.CHUNK + quality.AHEAD), dtype=np.uint8)
    owner, wanted = np.array([0, 0, 1, 2, 2]), np.array([1, 0, 1], np.float32)
    for i, part in enumerate(net.parts()):
        setattr(net, list(net.__dataclass_fields__)[i], part.astype(np.float64))
    net.intercept = net.intercept + 0.1

    def loss():
        patches = quality._patches(net.embed[chunks], 2 * quality.PLACES)
        seen = np.maximum((patches @ net.filters).max(axis=1) + net.bias, 0)
        hidden = np.maximum(seen @ net.hidden + net.shift, 0)
        mean = np.stack([hidden[owner == i].mean(axis=0) for i in range(3)])
        p = 1 / (1 + np.exp(-(mean @ net.out + net.intercept[0])))
        return -np.mean(wanted * np.log(p) + (1 - wanted) * np.log(1 - p))

    grads = quality._gradients(net, chunks, owner, wanted)
    for part, grad in zip(net.parts(), grads, strict=True):
        flat = part.reshape(-1)
        for j in np.argsort(-np.abs(grad.reshape(-1)))[:4]:
            kept = flat[j]
            flat[j] = kept + 1e-5
            up = loss()
            flat[j] = kept - 1e-5
            down = loss()
            flat[j] = kept
            assert (up - down) / 2e-5 == pytest.approx(grad.reshape(-1)[j], rel=0.02, abs=1e-6)


def test_quality(spark):
    good = "The quick brown fox jumps over the lazy dog, and so on. "
    bad = "x9## $$ q7%% || zz** "
    rows = [(i, (good if i % 3 else bad) * (1 + i % 40)) for i in range(400)]
    odd = [(1000, None), (1001, ""), (1002, good * 20_000), (1003, bad * 50_000), (1004, good * 30), (1004, good * 30), (None, bad * 30)]
    docs = spark.createDataFrame([(i, t, 0.0, "h") for i, t in rows + odd], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(7, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    got = quality.score(docs, labels)
    found = [(r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in got.collect()]
    assert len(found) == 407 and got.columns == ["doc_id", "held_out", "score", "predicted"]
    held = {i: p for i, h, _, p in found if h and i < 400}
    assert set(held) == {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([p == (i % 3 > 0) for i, p in held.items()]) > 0.98
    by_id = {i: s for i, _, s, _ in found}
    assert by_id[1000] == by_id[1001] and by_id[1002] > 0.5 > by_id[1003] and by_id[None] < 0.5
    again = quality.score(docs.repartition(1), labels)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got.collect()))
    # Labels of held-out rows, and repeated ids, change nothing.
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(repr, quality.score(docs, other).collect())) == sorted(map(repr, got.collect()))
    assert quality.score(docs.limit(0), labels).count() == 0
    for label, value in ((1, 1), (0, 0)):
        assert {r["predicted"] for r in quality.score(docs, labels.filter(F.col("quality") == label).filter("doc_id != 7")).collect()} == {value}
    assert {r["predicted"] for r in quality.score(docs, labels.limit(0)).collect()} == {0}


def test_held_out_accuracy(spark, data):
    """On the given tables, with the third that is never learned from."""
    path = data.replace("sf0.001", "sf0.01")
    documents, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = quality.score(documents, labels).filter("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    assert len(rows) > 100 and np.mean([r["quality"] == r["predicted"] for r in rows]) > 0.95
