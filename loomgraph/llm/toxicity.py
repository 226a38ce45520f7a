"""Toxicity by Levenshtein automata over a lexicon trie, with a context window for quotations.

Lexicon.  Words and word beginnings (4 to 8 characters) that toxic labelled documents hold far more
often than clean ones, with their log odds as weights.  They are learned from a bounded sample of the
labelled rows: the ``FIT_ROWS`` with the smallest id hashes, and never rows whose crc32(doc_id) mod 3
is 1, which are held out.  Every term that is frequent and telling enough in that sample is kept.

Matching.  Each distinct word is looked up as it is, by its beginnings, and, if it or a word made by
leaving out one of its letters is a lexicon word or one made so of it (true of all words one edit
apart), by walking the trie with the bit-parallel Levenshtein automaton of the word at distance 1.
All lexicon words of ``SPELT`` characters or more are in the trie; words of any length count as they stand.  A misspelling counts only if the sample's clean
documents don't use that word.

Context.  A match is quoted if, within ``CONTEXT`` characters on its line, quotation marks open before
and close after it, or its line starts with ``>``.  Quoted matches are a feature of their own.

Score.  Five features (strongest plain match, sum of the three strongest different ones, number of
matches, strongest quoted match, strongest misspelling) go into a logistic regression, fitted on
features computed with the other half's lexicon.  Scores depend on the text alone.

Defined cases: null and empty texts score like texts without a match; a null doc_id is never held
out and never learned from; several labels of one document count as toxic if any is; no labels, or
labels of one kind only, give an empty lexicon and a constant score (0 without toxic rows); repeated
rows each get their score; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, small_batches
from .words import Words, pieces

FIT_ROWS = 20_000
MIN_DOCS = 3
MIN_WEIGHT = 3.0
CONTEXT = 60
#: Words whose weights a task remembers.
SEEN = 200_000
PREFIXES = range(4, 9)
#: Characters of the shortest words whose misspellings count: one edit makes almost any word of a shorter one.
SPELT = 3
CUT = 0.7
FEATURES = 5
#: Bytes of text whose different words are looked up together.
PIECE = 500_000


class Trie:
    """Lexicon words as nested dicts; the empty key holds the word that ends at a node."""

    def __init__(self, words: Iterator[str]):
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word

    def within_one(self, word: str) -> list[str]:
        """Lexicon words at Levenshtein distance 1 or less.

        Bit i of a state says that i characters of ``word`` are read; ``exact`` without an edit and
        ``edited`` with at most one.  Trie and automaton advance together, so dead states prune subtrees.
        """
        reads: dict[str, int] = {}
        for i, c in enumerate(word):
            reads[c] = reads.get(c, 0) | 2 << i
        end, full = 1 << len(word), (2 << len(word)) - 1
        found, stack = [], [(self.root, 1, 3)]
        while stack:
            node, exact, edited = stack.pop()
            if "" in node and (exact | edited) & end:
                found.append(node[""])
            for c, child in node.items():
                if c:
                    m = reads.get(c, 0)
                    next_exact = exact << 1 & m
                    next_edited = (edited << 1 & m | exact | exact << 1 | next_exact << 1 | next_exact) & full
                    if next_edited:
                        stack.append((child, next_exact, next_edited))
        return found


def _shortened(word: str) -> Iterator[str]:
    """The word, and what is left of it without one letter."""
    yield word
    for i in range(len(word)):
        yield word[:i] + word[i + 1 :]


class Lexicon:
    """Weights of words and beginnings; misspellings through the trie."""

    def __init__(self, words: dict[str, float], starts: dict[str, float], fuzzy: list[str], ordinary: frozenset[str] = frozenset()):
        self.words, self.starts, self.ordinary = words, starts, ordinary
        self.trie = Trie(iter(fuzzy))
        self.keys = {x for w in fuzzy for x in _shortened(w)}
        self.longest = max(map(len, fuzzy), default=0)
        self.seen: dict[int, tuple[float, float]] = {}

    def near(self, word: str) -> list[str]:
        if len(word) <= self.longest + 1 and any(x in self.keys for x in _shortened(word)):
            return self.trie.within_one(word)
        return []

    def match(self, word: str) -> tuple[float, float]:
        """Weight of a word as it stands, and of it as a misspelling."""
        plain = self.words.get(word, 0.0)
        for n in PREFIXES:
            if n > len(word):
                break
            plain = max(plain, self.starts.get(word[:n], 0.0))
        if plain or word in self.ordinary:
            return plain, 0.0
        return 0.0, max((self.words[x] for x in self.near(word)), default=0.0)


_OPENS, _CLOSES = "\"“„«‹‘`", "\"”“»›’`"


def _quoted(text: str, start: int, end: int) -> bool:
    line = text.rfind("\n", 0, start) + 1
    stop = text.find("\n", end)
    if text.startswith(">", line):
        return True
    before = text[max(line, start - CONTEXT) : start]
    after = text[end : min(len(text) if stop < 0 else stop, end + CONTEXT)]
    for opens, closes in zip(_OPENS, _CLOSES, strict=True):
        opened = before.count(opens) % 2 == 1 if opens == closes else before.rfind(opens) > before.rfind(closes)
        if opened and closes in after:
            return True
    return False


def features(words: Words, lexicon: Lexicon) -> np.ndarray:
    """One row of ``FEATURES`` numbers per text."""
    out = np.zeros((len(words.count), FEATURES))
    if not len(words.hash):
        return out
    found, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    plain, edited = np.zeros(len(first)), np.zeros(len(first))
    seen = lexicon.seen
    for at, (h, k) in enumerate(zip(found.tolist(), first.tolist(), strict=True)):
        weights = seen.get(h)
        if weights is None:
            if len(seen) >= SEEN:
                seen.clear()
            weights = seen[h] = lexicon.match(words.word(k))
        if weights != (0.0, 0.0):
            plain[at], edited[at] = weights
    hit = np.flatnonzero((plain + edited)[inverse])
    if not len(hit):
        return out
    owner = np.searchsorted(words.first, hit, side="right") - 1
    for i in np.unique(owner):
        raw = words.raw[words.text_start[i] : words.text_start[i + 1]].tobytes()
        text = raw.decode("utf-8", "replace")
        narrow = len(text) == len(raw)
        best: dict[int, float] = {}
        quoted = misspelt = 0.0
        count = 0
        for k in hit[owner == i]:
            a, b = (words.start[k] - words.text_start[i], words.end[k] - words.text_start[i])
            if not narrow:
                a = len(raw[:a].decode("utf-8", "replace"))
                b = a + len(words.word(k))
            which = int(inverse[k])
            weight = plain[which] or edited[which]
            if _quoted(text, a, b):
                quoted = max(quoted, weight)
                continue
            count += 1
            if plain[which]:
                best[which] = weight
            else:
                misspelt = max(misspelt, weight)
        top = sorted(best.values(), reverse=True)
        out[i] = (top[0] if top else 0.0, sum(top[:3]), np.log1p(count), quoted, misspelt)
    return out


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts of each half hold a term."""
    for batch in pieces(batches, "text", PIECE):
        words = Words(batch.column("text"))
        counts: Counter = Counter()
        for i, (toxic, half) in enumerate(zip(batch.column("toxic").to_pylist(), batch.column("half").to_pylist(), strict=True)):
            low = words.low[words.text_start[i] : words.text_start[i + 1]].tobytes().decode("utf-8", "replace")
            own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
            terms = {("w", w) for w in own} | {("p", w[:n]) for w in own for n in PREFIXES if n <= len(w)}
            counts.update((kind, term, toxic, half) for kind, term in terms)
        keys = list(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "kind": pa.array([k[0] for k in keys], pa.string()),
                "term": pa.array([k[1] for k in keys], pa.string()),
                "toxic": pa.array([k[2] for k in keys], pa.int32()),
                "half": pa.array([k[3] for k in keys], pa.int32()),
                "n": pa.array([counts[k] for k in keys], pa.int64()),
            }
        )


def _log_odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    return np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((clean + 0.5) / (all_clean + 1))


def _lexicon(rows: list, toxic: np.ndarray, clean: np.ndarray, sizes: tuple[float, float], ordinary: frozenset[str] = frozenset()) -> Lexicon:
    weight = _log_odds(toxic, clean, *sizes)
    words, starts, fuzzy = {}, {}, []
    for i in np.flatnonzero((weight >= MIN_WEIGHT) & (toxic >= MIN_DOCS - 1)):
        kind, term = rows[i]["kind"], rows[i]["term"]
        (words if kind == "w" else starts)[term] = float(weight[i])
        if kind == "w" and len(term) >= SPELT:
            fuzzy.append(term)
    return Lexicon(words, starts, fuzzy, ordinary)


def _regression(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and regression coefficients, from at most ``fit_rows`` labelled rows outside the held-out third."""
    small_batches(documents.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))
    # The sample is bounded by ``fit_rows``, so it can be broadcast.  An id that repeats gives one text, the least.
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample.withColumnRenamed("doc_id", "label_id")), F.col("doc_id") == F.col("label_id"))
    scratch = Scratch(documents.sparkSession)
    texts = scratch.store(texts.groupBy("doc_id", "toxic", "half").agg(F.min("text").alias("text")), "toxic-sample")
    sizes = {(r["toxic"], r["half"]): float(r["count"]) for r in texts.groupBy("toxic", "half").count().collect()}
    t, c = np.array([sizes.get((1, h), 0.0) for h in (0, 1)]), np.array([sizes.get((0, h), 0.0) for h in (0, 1)])
    if not t.sum() or not c.sum():
        # One kind of label: nothing to tell apart.
        return Lexicon({}, {}, []), np.array([0.0] * FEATURES + [30.0 if t.sum() else -30.0])

    counted = texts.select("text", "toxic", "half").mapInArrow(lean(_count_terms), "kind string, term string, toxic int, half int, n bigint")
    per = [F.sum(F.when((F.col("toxic") == y) & (F.col("half") == h), F.col("n")).otherwise(0)).alias(f"n{y}{h}") for y in (1, 0) for h in (0, 1)]
    terms = counted.groupBy("kind", "term").agg(*per)
    toxic_docs, clean_docs = F.col("n10") + F.col("n11"), F.col("n00") + F.col("n01")
    odds = F.log((toxic_docs + 0.5) / (t.sum() + 1)) - F.log((clean_docs + 0.5) / (c.sum() + 1))
    terms = scratch.store(terms, "toxic-terms")
    # As many as the bounded sample's words allow.
    rows = terms.filter((toxic_docs >= MIN_DOCS) & (odds >= MIN_WEIGHT - 1)).orderBy("kind", "term").collect()
    n = {k: np.array([float(r[k]) for r in rows]) for k in ("n10", "n11", "n00", "n01")}

    whole = _lexicon(rows, n["n10"] + n["n11"], n["n00"] + n["n01"], (t.sum(), c.sum()))
    halves = [_lexicon(rows, n[f"n1{1 - h}"], n[f"n0{1 - h}"], (t[1 - h], c[1 - h])) for h in (0, 1)]

    def near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"term": pa.array([w for w in batch.column("term").to_pylist() if w not in whole.words and whole.near(w)], pa.string())})

    # Ordinary words one edit from the lexicon: all of them, and few, as they are drawn from the bounded sample.
    ordinary = terms.filter((F.col("kind") == "w") & (clean_docs >= 1)).select("term").mapInArrow(near_words, "term string")
    ordinary = frozenset(r["term"] for r in ordinary.collect())
    for lexicon in (whole, *halves):
        lexicon.ordinary = ordinary

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            words = Words(batch.column("text"))
            half = batch.column("half").to_numpy()
            x = np.where((half == 0)[:, None], features(words, halves[0]), features(words, halves[1]))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(x[:, j]) for j in range(FEATURES)]], names=["toxic", *[f"x{j}" for j in range(FEATURES)]])

    table = texts.mapInArrow(lean(crossed), "toxic int, " + ", ".join(f"x{j} double" for j in range(FEATURES))).toArrow()
    scratch.keep()
    x = np.stack([table.column(f"x{j}").to_numpy() for j in range(FEATURES)], axis=1)
    y = table.column("toxic").to_numpy().astype(float)
    order = np.lexsort((y, *x.T))  # sums then don't depend on how rows were dealt
    return whole, _regression(x[order], y[order])


def score(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``."""
    lexicon, beta = fit(documents, labels, fit_rows)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            x = features(Words(batch.column("text")), lexicon)
            value = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(value)], names=["doc_id", "held_out", "score"])

    rows = documents.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(scored), f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def drop_toxic(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``documents`` without those scored toxic; columns as they came."""
    lexicon, beta = fit(documents, labels, fit_rows)
    at = documents.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(iter([batch]), batch.schema.names[at], PIECE):
                x = features(Words(part.column(at)), lexicon)
                value = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
                yield part.filter(pa.array(value < CUT))

    return documents.mapInArrow(lean(clean), documents.schema)
