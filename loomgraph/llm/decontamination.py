r"""Benchmark decontamination by winnowing.  DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.  A window of a
benchmark item is ``WINDOW`` consecutive words; an item of fewer words is one window.  For windows of
L words, k-grams of ``min(K, L)`` words are hashed, and each run of ``L - k + 1`` k-grams keeps its
minimum, so two texts that share L words in a row share a fingerprint: none is missed.

1. Training and test fingerprints are joined.  Consecutive windows with one minimum are one
   fingerprint with a run length, so about 2 in 7 positions of a document are looked up.
2. Documents with a joined fingerprint are read again, hits are extended: each window around a hit
   is compared word by word (by its full text) with the distinct test windows.
3. Covered words and items are counted per document.

A fingerprint shared by many documents costs one row per place, never pairs of places: the test
side is reduced to distinct fingerprints and distinct window texts before each join.  Which side of
a join is broadcast is left to Spark's own size check.

Defined cases: a null or empty text has no words and is clean; an item without words has no window;
repeated item rows count by item_id, a null item_id never counts as an item; rows that repeat
both doc_id and text give one row; an empty benchmark leaves every document clean; an item of one word
hits that word everywhere; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, unused, words_of

WINDOW, K = 10, 5
#: Places of a text that are looked up among its fingerprints together.
TOGETHER = 256


def _gram_hashes(words: Column, k: int) -> Column:
    """Hash of the k words from each position on; needs at least k words."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(k)]))


def _window_minima(grams: Column, span: int, none: Column) -> Column:
    if span == 1:
        return grams
    starts = F.sequence(F.lit(0), F.size(grams) - span)
    return F.when(F.size(grams) < span, none).otherwise(F.transform(starts, lambda i: F.least(*[F.get(grams, i + j) for j in range(span)])))


def _prints_of(length: int) -> Column:
    """The distinct fingerprints of windows of one length; equal neighbours are one fingerprint."""
    return F.transform(F.array_distinct(f"minima_{length}"), lambda m: F.struct(F.lit(length).alias("length"), m.alias("print")))


def _spots_of(length: int) -> Column:
    """The windows of one length whose fingerprint is among ``prints``, with their words."""
    # A stretch of places first keeps the fingerprints that it holds (a hash look-up), so that a place isn't held
    # against all fingerprints of a long text.
    own = F.transform(F.filter("prints", lambda p: p["length"] == length), lambda p: p["print"])
    minima = F.col(f"minima_{length}")
    starts = F.when(F.size(minima) > 0, F.sequence(F.lit(0), F.size(minima) - 1, F.lit(TOGETHER))).otherwise(F.expr("cast(array() as array<int>)"))
    stretch = lambda a: F.slice(minima, a + 1, F.lit(TOGETHER))
    stretches = F.transform(starts, lambda a: F.struct(a.alias("at"), F.array_intersect(stretch(a), own).alias("own")))
    places = F.flatten(
        F.transform(stretches, lambda s: F.filter(F.transform(stretch(s["at"]), lambda m, i: F.when(F.array_contains(s["own"], m), s["at"] + i)), lambda i: i.isNotNull()))
    )
    return F.transform(
        places,
        lambda i: F.struct(F.lit(length).alias("length"), F.array_join(F.slice("words", i + 1, F.lit(length)), " ").alias("content"), i.alias("start")),
    )


def _with_minima(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``minima_L``: for each window of L of the ``words`` its smallest k-gram hash; empty if the text is shorter.

    The k-gram hashes are columns of their own, so that a window looks them up and doesn't hash again.
    """
    none = F.expr("cast(array() as array<bigint>)")
    words = F.col("words")
    for k in sorted({min(K, n) for n in lengths}):
        rows = rows.withColumn(f"grams_{k}", F.when(F.size(words) >= k, _gram_hashes(words, k)).otherwise(none))
    minima = {}
    for n in lengths:
        minima[f"minima_{n}"] = _window_minima(F.col(f"grams_{min(K, n)}"), n - min(K, n) + 1, none)
    return rows.withColumns(minima).drop(*[f"grams_{k}" for k in range(1, K + 1)])


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (length, content, item_id): every window of every item, with its words joined by spaces."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = items.select("item_id", "words", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("start"))
    return starts.select("length", F.array_join(F.slice("words", F.col("start"), F.col("length")), " ").alias("content"), "item_id").distinct()


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each (doc_id, text) of ``documents``."""
    windows = stored(item_windows(benchmark, window), "bench-windows")
    # At most ``window`` numbers: the lengths that occur, the usual one always among them.
    lengths = sorted({window} | {r["length"] for r in windows.select("length").distinct().collect()})
    prints = None
    for n in lengths:
        own = _with_minima(windows.filter(F.col("length") == n).select("length", F.split("content", " ").alias("words")), [n])
        own = own.select("length", F.array_min(f"minima_{n}").alias("print"))
        prints = own if prints is None else prints.unionByName(own)
    prints = prints.distinct()

    tagged = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    base = tagged.select("doc_id", "text_hash", F.size("words").cast("bigint").alias("n_words")).distinct()
    tagged = _with_minima(tagged, lengths)
    per_length = [_prints_of(n) for n in lengths]
    rows = tagged.select("doc_id", "text_hash", F.explode(F.concat(*per_length)).alias("p")).select("doc_id", "text_hash", "p.length", "p.print")
    found = stored(rows.join(prints, ["length", "print"]), "doc-prints")

    candidates = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("length", "print")).alias("prints"))
    hits = stored(_extend(documents, candidates, windows, lengths), "doc-hits")

    within = Window.partitionBy("doc_id", "text_hash").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("stop").over(within), F.lit(0))
    fresh = hits.select("doc_id", "text_hash", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reach)).alias("fresh"))
    covered = fresh.groupBy("doc_id", "text_hash").agg(F.sum("fresh").cast("bigint").alias("n_hit"))
    owners = hits.select("doc_id", "text_hash", "length", "content").distinct().join(windows, ["length", "content"])
    items = owners.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))

    covered = covered.withColumnsRenamed({"doc_id": "c_id", "text_hash": "c_hash"})
    items = items.withColumnsRenamed({"doc_id": "i_id", "text_hash": "i_hash"})
    joined = base.join(covered, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")), "left")
    joined = joined.join(items, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("text_hash") == F.col("i_hash")), "left")
    listed = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _extend(documents: DataFrame, candidates: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Windows of candidate documents that equal a test window: doc_id, text_hash, length, content, start, stop."""
    wanted = candidates.withColumnsRenamed({"doc_id": "w_id", "text_hash": "w_hash"})
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    # Candidates grow with the corpus: one plan at every size.
    texts = keyed.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")))
    texts = texts.select("doc_id", "text_hash", words_of(F.col("text")).alias("words"), "prints")
    texts = texts.dropDuplicates(["doc_id", "text_hash"])
    texts = _with_minima(texts, lengths)
    spots = [_spots_of(n) for n in lengths]
    rows = texts.select("doc_id", "text_hash", F.explode(F.concat(*spots) if len(spots) > 1 else spots[0]).alias("w"))
    rows = rows.select("doc_id", "text_hash", "w.length", "w.content", "w.start", (F.col("w.start") + F.col("w.length")).alias("stop"))
    return rows.join(windows.select("length", "content").distinct(), ["length", "content"])


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` without the contaminated ones; columns as they came."""
    bad_id, bad_hash = unused(documents, "bad_id"), unused(documents, "bad_hash")
    bad = contamination(documents, benchmark, window).filter("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash))
    match = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_hash))
    return documents.join(bad, match, "left_anti")
