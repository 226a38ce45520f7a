"""Line deduplication by winnowing over line hashes.  DataFrame functions only.

A run is a sequence of consecutive non-blank lines of one document.  Every run of at least
``MIN_WORDS`` words that occurs earlier (a smaller doc_id, or before it in the same document without
overlap) is deleted; shorter repeats stay.

1. Windows: from each line on the shortest stretch with ``MIN_WORDS`` words (forward), and up to each
   line likewise (backward).  The line with the smallest hash of a window is its fingerprint.  Which line is
   chosen depends on the window's lines only, so two runs of enough words share a fingerprint.
2. Fingerprint positions are joined with the number of places their line was chosen at.  A position that
   stands alone can't repeat and goes no further.
3. Around every position left the match is extended both ways: the windows that chose it reach up to
   ``MIN_WORDS`` words to its left and right, and are matched by 128 bits of all their lines.  The first
   place of each content stays, and every other place is a repeat.  A common run's forward windows begin
   at its left end and its backward windows end at its right end, so their union is the whole run.
   (Line-by-line extension against one earlier place would lose what only another place shares, and
   against all places would make all pairs of a group.)
4. Overlapping repeats are merged into stretches of lines, which are cut from the text.

Lines are stored by number and hashes, without their text; content is gathered around joined positions
only.  A very common line is one row per place in each step, counts are combined before the shuffle, and
counts and first places of frequent lines and windows come back by broadcast, a thousand at most; the
others by merge joins, one plan at every size.

Defined cases: lines end at ``\\n``; a line is blank if it holds only spaces, and lines are compared
without outer spaces; blank lines inside a deleted run go with it; a null text stays null; rows that
repeat both doc_id and text are one document and get the same result; a null doc_id counts as the
smallest; an empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_weighed

MIN_WORDS = 50
_DOC = ("doc_id", "text_hash")


def _lines(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, ln, h, h2, s, e of the non-blank lines; s and e count the words before and up to it."""
    split = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    kept = split.withColumn("line", F.trim("line")).filter("line != ''")
    words = F.size(F.split("line", " +")).cast("bigint")
    hashed = kept.select(*_DOC, "ln", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), words.alias("w"))
    dealt = hashed.repartition(*_DOC).dropDuplicates([*_DOC, "ln"])
    upto = Window.partitionBy(*_DOC).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    counted = dealt.withColumn("e", F.sum("w").over(upto))
    return counted.select(*_DOC, "ln", "h", "h2", (F.col("e") - F.col("w")).alias("s"), "e")


def _frames(min_words: int) -> dict:
    doc = Window.partitionBy(*_DOC)
    return {"f": doc.orderBy("s").rangeBetween(0, min_words - 1), "b": doc.orderBy("e").rangeBetween(-(min_words - 1), 0)}


def _positions(lines: DataFrame, min_words: int) -> DataFrame:
    """print, doc_id, text_hash, s of the lines that some window chooses, each once."""
    whole = {kind: F.max("e").over(frame) - F.min("s").over(frame) >= min_words for kind, frame in _frames(min_words).items()}
    chosen = [F.when(whole[kind], F.min(F.struct("h", "s")).over(frame)) for kind, frame in _frames(min_words).items()]
    picked = lines.select(*_DOC, F.array(*chosen).alias("chosen")).select(*_DOC, F.explode(F.array_compact("chosen")).alias("p"))
    return picked.select("p.h", *_DOC, "p.s").withColumnRenamed("h", "print").distinct()


def _extended(lines: DataFrame, joined: DataFrame, min_words: int) -> DataFrame:
    """doc_id, text_hash, s, e, first_ln, last_ln, key, key2 of the windows around ``joined`` positions."""
    same = lines.doc_id.eqNullSafe(joined.doc_id) & (lines.text_hash == joined.text_hash) & (lines.s == joined.s)
    marked = lines.join(joined.withColumn("live", F.lit(True)).hint("merge"), same, "left").select(
        *[lines[c] for c in lines.columns], F.coalesce("live", F.lit(False)).alias("live")
    )
    parts = []
    for kind, frame in _frames(min_words).items():
        own = marked.select(
            *_DOC,
            F.min("s").over(frame).alias("s"),
            F.max("e").over(frame).alias("e"),
            F.min("ln").over(frame).alias("first_ln"),
            F.max("ln").over(frame).alias("last_ln"),
            F.collect_list(F.struct("h", "h2")).over(frame).alias("content"),
            F.min(F.struct("h", "s", "live")).over(frame).alias("p"),
        ).filter((F.col("e") - F.col("s") >= min_words) & F.col("p.live"))
        keys = [F.xxhash64(F.lit(seed), F.lit(kind), "content").alias(name) for seed, name in ((1, "key"), (2, "key2"))]
        parts.append(own.select(*_DOC, "s", "e", "first_ln", "last_ln", *keys))
    return parts[0].unionByName(parts[1])


def repeated_stretches(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, stretches (array of first and last line to delete) of documents with repeats."""
    scratch = Scratch(documents.sparkSession)
    lines = scratch.store(_lines(documents), "line-hashes")
    places = scratch.store(_positions(lines, min_words), "line-positions")
    shared = scratch.store(places.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1"), "line-prints")
    joined = join_weighed(places, shared, "print", "n").select(*_DOC, "s")
    live = scratch.store(_extended(lines, joined, min_words), "line-windows")
    scratch.keep(live)

    at = F.struct(*_DOC, "s", "e")
    first = live.groupBy("key", "key2").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = scratch.store(first, "line-firsts")
    same_doc = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = join_weighed(live, first, ["key", "key2"], "n").filter(~same_doc | (F.col("s") >= F.col("first.e")))

    doc = Window.partitionBy(*_DOC)
    ordered = doc.orderBy("s", "e")
    reach = F.max("e").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.select(*_DOC, "s", "e", "first_ln", "last_ln", F.when(F.col("s") <= reach, 0).otherwise(1).alias("opens"))
    islands = opened.withColumn("island", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*_DOC, "island").agg(F.min("first_ln").alias("first_ln"), F.max("last_ln").alias("last_ln"))
    stretches = merged.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("first_ln", "last_ln"))).alias("stretches"))
    stretches = scratch.store(stretches, "line-stretches")
    scratch.keep(stretches)
    return stretches


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (without later repeated runs), n_lines, n_removed, one row for each row of ``documents``."""
    found = repeated_stretches(documents, min_words)
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "stretches")
    keyed = documents.select("doc_id", "text")
    lines = F.split("text", "\n")
    match = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.xxhash64("text") == F.col("found_hash"))
    joined = keyed.join(found.hint("merge"), match, "left").select("doc_id", "text", lines.alias("lines"), "stretches")
    stay = F.filter("lines", lambda x, i: ~F.exists("stretches", lambda r: (i >= r["first_ln"]) & (i <= r["last_ln"])))
    left = F.when(F.col("stretches").isNull(), F.col("lines")).otherwise(stay)
    return joined.select("doc_id", "text", "lines", left.alias("left")).select(
        "doc_id",
        F.array_join("left", "\n").alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
