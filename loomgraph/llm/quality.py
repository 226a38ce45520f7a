"""Quality by a byte-level convolutional network, in numpy.

Network.  Every byte has a learned vector; learned filters of ``WIDTH`` bytes are laid over the text at every
``STRIDE``-th byte.  A chunk is two neighbouring blocks of ``BLOCK`` bytes, the next chunk starts one block later,
so chunks overlap by half and cover the whole document.  Each filter's greatest response in a chunk goes through a
hidden layer; the mean of the hidden values over all chunks gives one logit, the logistic function one probability.
What a document needs is its block maxima, so memory grows with a text by a fraction of its size and no text is cut.

Fitting.  From the ``FIT_ROWS`` labelled ids with the smallest hashes, never those whose crc32(doc_id) mod 3 is 1
(held out), ``FIT_CHUNKS`` chunks spread evenly over the whole text are taken, one row an id; the driver fits on at most
``FIT_ROWS * FIT_CHUNKS * CHUNK`` bytes, whatever the input is.  Adam, fixed seed and order: one sample gives one network.

Defined cases: null and empty texts have no chunk and get the score of the intercept alone; a text shorter than a
chunk is one chunk, filled up with zero bytes; a null doc_id is never held out and never learned from; several labels
of one id count as 1 if any does, several texts of one labelled id give the least by bytes to the fit; without labels
of both kinds the score is constant (1 with label 1 only, else 0); repeated rows each get their score; an empty table gives no rows;
extra columns are ignored.  Byte vectors and filters are rounded so that 32-bit sums are exact, what follows is in 64
bits and scores have six digits: they don't depend on how rows were dealt to batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches
from .words import pieces

WIDTH, STRIDE, BLOCK = 8, 4, 256
CHUNK = 2 * BLOCK
#: Places of a filter in a block, and the bytes that the last of them reads of what follows.
PLACES, AHEAD = BLOCK // STRIDE, WIDTH - STRIDE
EMBED, FILTERS, HIDDEN = 6, 24, 12
FIT_ROWS = 3_000
FIT_CHUNKS = 6
STEPS, STEP, RATE = 400, 64, 4e-3
CUT = 0.5
#: Blocks that are convolved at once: 256 KB of text.
AT_ONCE = 1024


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    hidden: np.ndarray  # (FILTERS, HIDDEN)
    shift: np.ndarray  # (HIDDEN,)
    out: np.ndarray  # (HIDDEN,)
    intercept: np.ndarray  # (1,)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.shift, self.out, self.intercept]


def rounded(net: Network) -> Network:
    """The network with byte vectors of 8 bits and filters of 10, whose ``WIDTH * EMBED`` products sum exactly in 32-bit floats."""
    net.embed = np.round(np.clip(net.embed, -4, 4) * 64).astype(np.float32) / 64
    net.filters = np.round(np.clip(net.filters, -2, 2) * 512).astype(np.float32) / 512
    net.bias, net.hidden, net.shift, net.out, net.intercept = (p.astype(np.float64) for p in net.parts()[2:])
    return net


def fresh(seed: int = 7) -> Network:
    draw = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    embed = draw.standard_normal((256, EMBED)).astype(np.float32) * np.float32(0.5)
    zero = [np.zeros(n, np.float32) for n in (FILTERS, HIDDEN, 1)]
    return Network(embed, normal(WIDTH * EMBED, FILTERS), zero[0], normal(FILTERS, HIDDEN), zero[1], normal(HIDDEN), zero[2])


def constant(label: int) -> Network:
    """A network that ignores its text."""
    net = fresh()
    net.out[:] = 0
    net.intercept[:] = 30.0 if label else -30.0
    return rounded(net)


def _patches(vectors: np.ndarray, places: int) -> np.ndarray:
    """(n, places, WIDTH * EMBED): what each place of a filter reads of rows of byte vectors."""
    n, step = vectors.shape[0], vectors.strides
    shape = (n, places, WIDTH * EMBED)
    return np.lib.stride_tricks.as_strided(vectors, shape, (step[0], STRIDE * step[1], step[2]), writeable=False)


def block_maxima(net: Network, padded: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(blocks, FILTERS): the greatest response in each block of ``padded``, whose length is a multiple of ``BLOCK``.

    ``ends`` are the last blocks of documents.  The last place of such a block reads padding and what follows: it
    doesn't count.
    """
    blocks = len(padded) // BLOCK
    out = np.empty((blocks, FILTERS), np.float32)
    last = np.zeros(blocks, bool)
    last[ends] = True
    data = np.concatenate([padded, np.zeros(AHEAD, np.uint8)])
    for a in range(0, blocks, AT_ONCE):
        b = min(blocks, a + AT_ONCE)
        vectors = net.embed[data[a * BLOCK : b * BLOCK + AHEAD]]
        found = (_patches(vectors[None], (b - a) * PLACES)[0] @ net.filters).reshape(b - a, PLACES, FILTERS)
        found[last[a:b], -1] = -np.inf
        out[a:b] = found.max(axis=1)
    return out


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """One probability a text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    # At least AHEAD bytes of padding, so that the last place of a document reads no text.
    blocks = np.where(sizes > 0, (sizes + AHEAD + BLOCK - 1) // BLOCK, 0)
    first = np.concatenate([[0], np.cumsum(blocks)])
    padded = np.zeros(int(first[-1]) * BLOCK, np.uint8)
    for text, at in zip(texts, first.tolist(), strict=False):
        padded[at * BLOCK : at * BLOCK + len(text)] = np.frombuffer(text, np.uint8)
    logits = np.full(len(texts), float(net.intercept[0]))
    has = np.flatnonzero(blocks)
    if len(has):
        top = block_maxima(net, padded, first[1:][has] - 1)
        # Chunk i is blocks i and i + 1 of one document; a document of one block is one chunk.
        chunk = top.copy()
        inner = np.ones(len(top), bool)
        inner[first[1:][has] - 1] = False
        pairs = np.flatnonzero(inner)
        chunk[pairs] = np.maximum(top[pairs], top[pairs + 1])
        keep = inner.copy()
        keep[first[:-1][has]] = True  # the first block always starts a chunk
        owner = np.repeat(np.arange(len(texts)), blocks)[keep]
        hidden = np.maximum(np.maximum(chunk[keep].astype(np.float64) + net.bias, 0) @ net.hidden + net.shift, 0)
        logit = hidden @ net.out
        logits += np.bincount(owner, logit, len(texts)) / np.maximum(1, np.bincount(owner, minlength=len(texts)))
    return np.round(1 / (1 + np.exp(-np.clip(logits, -30, 30))), 6)


def _gradients(net: Network, chunks: np.ndarray, owner: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy of some documents: ``chunks`` (n, CHUNK + AHEAD) bytes, ``owner`` their documents."""
    n = len(chunks)
    patches = _patches(net.embed[chunks], 2 * PLACES)
    found = patches.reshape(n * 2 * PLACES, -1) @ net.filters
    where = found.reshape(n, 2 * PLACES, FILTERS).argmax(axis=1)
    rows, columns = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
    top = found.reshape(n, 2 * PLACES, FILTERS)[rows, where, columns] + net.bias
    seen = np.maximum(top, 0)
    inner = seen @ net.hidden + net.shift
    hidden = np.maximum(inner, 0)
    share = (1 / np.bincount(owner, minlength=len(wanted)).astype(np.float32))[owner]
    mean = np.zeros((len(wanted), HIDDEN), np.float32)
    np.add.at(mean, owner, hidden * share[:, None])
    p = 1 / (1 + np.exp(-np.clip(mean @ net.out + net.intercept[0], -30, 30)))
    d = ((p - wanted) / len(wanted)).astype(np.float32)
    d_inner = d[owner][:, None] * share[:, None] * net.out[None, :] * (inner > 0)
    d_top = (d_inner @ net.hidden.T) * (top > 0)
    best = patches[rows, where]  # (n, FILTERS, WIDTH * EMBED)
    d_filters = np.einsum("nf,nfk->kf", d_top, best)
    d_bytes = (d_top[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
    at = (where * STRIDE)[:, :, None] + np.arange(WIDTH)
    which = chunks[np.arange(n)[:, None, None], at].reshape(-1)
    d_embed = np.stack([np.bincount(which, d_bytes[:, j], 256) for j in range(EMBED)], axis=1).astype(np.float32)
    return [d_embed, d_filters, d_top.sum(axis=0), seen.T @ d_inner, d_inner.sum(axis=0), mean.T @ d, d.sum(keepdims=True)]


def train(documents: list[tuple[list[bytes], int]], seed: int = 7) -> Network:
    """A network fitted on (chunks, label) of some documents, by Adam."""
    documents = [d for d in documents if d[0]]
    labels = {label for _, label in documents}
    if len(labels) < 2:
        return constant(int(labels == {1}))
    net, draw = fresh(seed), np.random.default_rng(seed)
    one = [np.zeros_like(p) for p in net.parts()]
    two = [np.zeros_like(p) for p in net.parts()]
    # Half the mass of each kind in the intercept; learned from there.
    share = np.mean([label for _, label in documents])
    net.intercept[:] = np.log(share / (1 - share))
    order: list[int] = []
    for t in range(1, STEPS + 1):
        if len(order) < min(STEP, len(documents)):
            order += draw.permutation(len(documents)).tolist()
        some, order = [documents[i] for i in order[:STEP]], order[STEP:]
        data = b"".join(c.ljust(CHUNK + AHEAD, b"\0") for chunks, _ in some for c in chunks)
        owner = np.repeat(np.arange(len(some)), [len(chunks) for chunks, _ in some])
        grads = _gradients(net, np.frombuffer(data, np.uint8).reshape(-1, CHUNK + AHEAD), owner, np.array([label for _, label in some], np.float32))
        rate = RATE * min(1.0, 2.0 * (1 - t / (STEPS + 1)))
        for part, grad, m, v in zip(net.parts(), grads, one, two, strict=True):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            part -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return rounded(net)


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Network:
    """A network from at most ``fit_rows`` labelled ids outside the held-out third, ``FIT_CHUNKS`` chunks each."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    sample = known.orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)
    # At most ``fit_rows`` pairs, so they can be broadcast.
    texts = documents.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b")).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    size = F.octet_length("b")
    n = F.least(F.lit(FIT_CHUNKS), F.greatest(F.lit(1), F.ceil(size / BLOCK) - 1)).cast("int")
    start = lambda i: F.floor(i * F.greatest(F.lit(0), size - CHUNK) / F.greatest(F.lit(1), n - 1)).cast("int")
    chunks = F.when(size > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("b"), start(i) + 1, F.lit(CHUNK + AHEAD)))).otherwise(F.array().cast("array<binary>"))
    # One row an id, so repeated ids can't add to what the driver gets.
    rows = texts.select("doc_id", "quality", chunks.alias("chunks")).groupBy("doc_id").agg(F.min(F.struct("chunks", "quality")).alias("r")).orderBy("doc_id").collect()
    return train([([bytes(c) for c in r["r"]["chunks"]], r["r"]["quality"]) for r in rows])


def score(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``."""
    small_batches(documents.sparkSession)
    net = fit(documents, labels, fit_rows)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            value = scores(net, batch.column("text").cast(pa.large_binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(value)], names=["doc_id", "held_out", "score"])

    rows = documents.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(scored), f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))
