"""Cross-entropy difference scores from matched n-gram models (Moore and Lewis, 2010).

The target model is counted on the documents labelled as good, the background model on all
documents.  Both are word bigram models over every word of the corpus, V in number:
P(word | previous) = (n(previous, word) + S p(word)) / (n(previous) + S), where
p(word) = (n(word) + 1) / (N + V) and S is ``SMOOTH``; it sums to one over the V words.  No count is
left out and none is shared, so what is gathered grows with the corpus.  Background counts are scaled
to the target's number of tokens, so the same smoothing weighs alike in both.  A document is scored by the
counts of all others: its own are taken off both models, so a target document doesn't vouch for itself.

A document's losses are the mean negative log probabilities (nats) of its tokens under each model;
``score`` is target loss minus background loss, the mean of the per-token differences: low scores
read like the target.

Counting.  Documents are dealt into chunks of about ``CHUNK`` bytes of text by the hash of their id, and
with them the ids of the target.  A chunk counts its own words, contexts and bigrams, each told by 62 bits
of a hash, and cuts the sorted keys into ranges, as many as there are chunks.  Whoever adds up a range gets
one block from each chunk (so the commonest bigram stands in a block once, however often it is written) and
answers each chunk with the totals of the keys it asked for, in their order.  The chunk then scores its
texts.  Nothing but the number of bytes reaches the driver, and nothing is broadcast.

Defined cases: words as in ``words`` (a null or empty text has none, its losses and score are null);
several labels of one document make it a target if any does; without target tokens both models
smooth to the same uniform shape for the target; repeated rows count as often as they stand (rows of
one id share a chunk, rows without an id are dealt by their text); an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .words import Words, mix, pieces

#: Bytes of text that one task counts and scores together.
CHUNK = 12_000_000
#: Weight, in tokens, of the words' own distribution after each word.
SMOOTH = 50.0


_WORD, _CONTEXT, _PAIR = (np.uint64(x) for x in range(3))
_START = np.uint64(0x5851F42D4C957F2D)


def _key(hashes: np.ndarray, kind: np.uint64) -> np.ndarray:
    """Keys whose two lowest bits tell words, contexts and bigrams apart."""
    return mix(hashes ^ mix(np.array([kind + np.uint64(77)]))) & ~np.uint64(3) | kind


def _pack(counts: np.ndarray) -> bytes:
    width = np.min_scalar_type(int(counts.max())) if len(counts) else np.dtype(np.uint8)
    return _squeezed(counts.astype(width).tobytes())


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, byte plane by byte plane: the upper planes compress to nothing."""
    return _squeezed(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _squeezed(raw: bytes) -> bytes:
    """Length and zstd: most counts are 0 or 1."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _loose(packed: bytes) -> pa.Buffer:
    return pa.decompress(memoryview(packed)[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd")


def _unpack_keys(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(_loose(packed), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0)
    raw = _loose(packed)
    return np.frombuffer(raw, dtype=f"u{raw.size // n}").astype(np.float64)


class Grams:
    """The words, contexts and bigrams of a chunk: sorted keys, and of each token the places of its three."""

    def __init__(self, texts: pa.Table):
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in pieces(iter(texts.combine_chunks().to_batches()), "text"):
            words = Words(part.column("text"))
            hashes.append(words.hash)
            counts.append(words.count)
        self.count = np.concatenate(counts)
        found, now = np.unique(np.concatenate(hashes), return_inverse=True)
        del hashes
        # Number len(found) stands for the start of a text.
        before = np.empty_like(now)
        before[1:] = now[:-1]
        before[(np.cumsum(self.count) - self.count)[self.count > 0]] = len(found)
        pairs, pair = np.unique(before * (len(found) + 1) + now, return_inverse=True)
        known = np.append(found, _START)
        with np.errstate(over="ignore"):
            both = mix(known[pairs // (len(found) + 1)]) * np.uint64(0x9E3779B97F4A7C15) + known[pairs % (len(found) + 1)]
            keys = np.concatenate([_key(found, _WORD), _key(known, _CONTEXT), _key(both, _PAIR)])
        order = np.argsort(keys)
        self.keys = keys[order]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.word, self.context, self.pair = place[now], place[len(found) + before], place[2 * len(found) + 1 + pair]

    def totals(self, weights: np.ndarray | None = None) -> np.ndarray:
        """How often each key occurs among the tokens, or among those of weight 1."""
        return sum(np.bincount(x, weights=weights, minlength=len(self.keys)) for x in (self.word, self.context, self.pair)).astype(np.int64)

    def own(self, places: np.ndarray) -> np.ndarray:
        """Of each token, how often its text has what stands at its place (of words, contexts or bigrams)."""
        owner = np.repeat(np.arange(len(self.count)), self.count)
        _, inverse, counts = np.unique(owner * len(self.keys) + places, return_inverse=True, return_counts=True)
        return counts[inverse]

    def cuts(self, ranges: int) -> np.ndarray:
        """Where each of the equal ranges of keys begins, and the end."""
        firsts = np.array([(i << 64) // ranges for i in range(ranges)], dtype=np.uint64)
        return np.append(np.searchsorted(self.keys, firsts), len(self.keys))


def _count_chunk(ranges: int):
    def count(key: tuple, texts: pa.Table, good: pa.Table) -> pa.Table:
        grams = Grams(texts)
        chosen = pc.is_in(texts.column("doc_id"), value_set=good.column("doc_id").combine_chunks()).to_numpy()
        n, of_good, cuts = grams.totals(), grams.totals(np.repeat(chosen, grams.count).astype(float)), grams.cuts(ranges)
        slices = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table(
            {
                "range": pa.array(range(ranges), pa.int64()),
                "chunk": pa.array([key[0].as_py()] * ranges, pa.int64()),
                "keys": pa.array([_pack_keys(grams.keys[x]) for x in slices], pa.binary()),
                "n": pa.array([_pack(n[x]) for x in slices], pa.binary()),
                "good": pa.array([_pack(of_good[x]) for x in slices], pa.binary()),
            }
        )

    return count


def _add_range(blocks: pa.Table) -> pa.Table:
    """Answers each chunk with the totals of its keys, and with those of all words of the range."""
    asked = [_unpack_keys(x) for x in blocks.column("keys").to_pylist()]
    found, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    out = {}
    for name in ("n", "good"):
        given = np.concatenate([_unpack(x, len(k)) for x, k in zip(blocks.column(name).to_pylist(), asked, strict=True)])
        out[name] = np.bincount(inverse, weights=given, minlength=len(found)).astype(np.int64)
    words = found & np.uint64(3) == _WORD
    ends = np.cumsum([0, *[len(x) for x in asked]])
    answers = {name: pa.array([_pack(total[inverse[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for name, total in out.items()}
    sums = {"words": int(words.sum()), "tokens": int(out["n"][words].sum()), "good_tokens": int(out["good"][words].sum())}
    return pa.table({"chunk": blocks.column("chunk"), "range": blocks.column("range"), **answers, **{k: pa.array([v] * len(asked), pa.int64()) for k, v in sums.items()}})


def _score_chunk(ranges: int):
    def losses(texts: pa.Table, answers: pa.Table) -> pa.Table:
        good = answers.filter(pc.field("range") == -1)
        grams, answers = Grams(texts), answers.filter(pc.field("range") >= 0).sort_by("range")
        cuts = grams.cuts(ranges)
        vocabulary, tokens, good_tokens = (sum(answers.column(x).to_pylist()) for x in ("words", "tokens", "good_tokens"))
        owner = np.repeat(np.arange(len(grams.count)), grams.count)
        chosen = pc.is_in(texts.column("doc_id"), value_set=good.column("doc_id").combine_chunks()).to_numpy()
        total = {name: np.concatenate([_unpack(x, b - a) for x, a, b in zip(answers.column(name).to_pylist(), cuts[:-1], cuts[1:], strict=True)]) for name in ("good", "n")}
        sums = {name: np.zeros(len(grams.count)) for name in total}
        own = {kind: grams.own(place) for kind, place in (("word", grams.word), ("context", grams.context), ("pair", grams.pair))}
        for name, scale, size in (("good", 1.0, good_tokens), ("n", good_tokens / max(1, tokens), tokens)):
            # What the text itself was counted for goes: always from the background, from the target if it is one.
            share = chosen.astype(float) if name == "good" else np.ones(len(chosen))
            weight = share[owner]
            word, context, pair = ((total[name][place] - weight * own[kind]) * scale for kind, place in (("word", grams.word), ("context", grams.context), ("pair", grams.pair)))
            prior = (word + 1) / ((size - share * grams.count)[owner] * scale + vocabulary)
            sums[name] = np.bincount(owner, weights=np.log((pair + SMOOTH * prior) / (context + SMOOTH)), minlength=len(grams.count))
        with np.errstate(invalid="ignore", divide="ignore"):
            out = [-sums[name] / grams.count for name in ("good", "n")]
        mask = grams.count == 0
        return pa.table([texts.column("doc_id"), pa.array(grams.count.astype(np.int64)), *[pa.array(x, mask=mask) for x in out]], names=["doc_id", "n_tokens", "target_loss", "background_loss"])

    return losses


def _scored(documents: DataFrame, labels: DataFrame, chunk: int) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = size // chunk + 1
    dealt = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(chunks)).alias("chunk")
    texts = documents.select("doc_id", "text", dealt).groupBy("chunk")
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").try_cast(kind).alias("doc_id"), F.lit("").alias("text"))
    good = good.select("doc_id", dealt).distinct()
    blocks = texts.cogroup(good.groupBy("chunk")).applyInArrow(_count_chunk(chunks), "range bigint, chunk bigint, keys binary, n binary, good binary")
    answers = blocks.groupBy("range").applyInArrow(_add_range, "chunk bigint, range bigint, n binary, good binary, words bigint, tokens bigint, good_tokens bigint")
    # The target's ids go along with the answers, under range -1.
    answers = answers.unionByName(good.select("chunk", F.lit(-1).cast("bigint").alias("range"), "doc_id"), allowMissingColumns=True)
    return texts.cogroup(answers.groupBy("chunk")).applyInArrow(_score_chunk(chunks), f"doc_id {kind}, n_tokens bigint, target_loss double, background_loss double")


def score(documents: DataFrame, labels: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every row of ``documents``.

    ``labels`` has doc_id and quality; quality 1 marks the target's documents.
    """
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _scored(rows, labels, chunk).withColumn("score", F.col("target_loss") - F.col("background_loss"))
