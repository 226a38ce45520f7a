"""Exact deduplication through a cuckoo-filter index of live digests.

Texts are equal when identical after each run of blanks (space, tab to carriage return) became one
space; a null text counts as empty.  The digest is the SHA-256 of that normalised text.

Spark deals the work out twice.  Each input partition keeps its own index and sends one entry per
live digest on (pre-aggregation: a group of copies, however hot, leaves a partition as one row).
Entries are then dealt by digest, sorted, and a second round of indexes merges them.  An index of
``FULL`` live digests sends on and deletes those that it has met only once, or all if most have copies, so memory is
bounded whatever a partition holds, and hot groups stay; an executor's loss only repeats its partitions.

Defined cases: an empty table gives an empty result; rows that repeat both doc_id and text are one
document's repeats, the smallest row tag stays; a null doc_id sorts after every other id; ids may be of
any type that can be ordered; extra columns are left alone, names such as ``digest`` or ``kept`` in the
input do not clash because only (doc_id, text) enter the index.  When copies are dropped, rows that
repeat both doc_id and text become one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_weighed, lean, row_hash, row_key, unused

SLOTS = 4
#: Live digests that one index holds at most.
FULL = 200_000


class CuckooIndex:
    """A cuckoo filter whose slots also hold the number of the stored key.

    ``find`` compares 16-bit fingerprints first and verifies a hit against the full digest that
    its bucket stores, so a false positive never merges two digests.  ``insert`` moves entries
    between their two buckets; when ``max_kicks`` moves find no free slot, the table doubles and is
    rebuilt from the stored keys.  ``delete`` frees a slot.  Values (smallest id, count) live beside
    the keys.
    """

    def __init__(self, buckets: int = 1024, max_kicks: int = 200):
        self.max_kicks = max_kicks
        self.keys: list[bytes | None] = []
        self.values: list[list] = []
        self.free: list[int] = []
        self.resizes = 0
        self._new_table(1 << max(2, (buckets - 1).bit_length()))

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def _new_table(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [[0] * SLOTS for _ in range(buckets)]
        self.slots = [[-1] * SLOTS for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> int | None:
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            if mark in (prints := self.prints[bucket]):
                for at in range(SLOTS):
                    if prints[at] == mark and self.keys[self.slots[bucket][at]] == digest:
                        return self.slots[bucket][at]
        return None

    def insert(self, digest: bytes, value: list) -> int:
        if self.free:
            number = self.free.pop()
            self.keys[number], self.values[number] = digest, value
        else:
            number = len(self.keys)
            self.keys.append(digest)
            self.values.append(value)
        if not self._place(number):
            self._resize()
        return number

    def _place(self, number: int) -> bool:
        mark, bucket, two = self._places(self.keys[number])
        for at_bucket in (bucket, two):
            if 0 in self.prints[at_bucket]:
                at = self.prints[at_bucket].index(0)
                self.prints[at_bucket][at], self.slots[at_bucket][at] = mark, number
                return True
        for kick in range(self.max_kicks):
            at = (kick + mark) % SLOTS
            mark, self.prints[bucket][at] = self.prints[bucket][at], mark
            number, self.slots[bucket][at] = self.slots[bucket][at], number
            bucket = self._other(bucket, mark)
            if 0 in self.prints[bucket]:
                at = self.prints[bucket].index(0)
                self.prints[bucket][at], self.slots[bucket][at] = mark, number
                return True
        return False

    def _resize(self) -> None:
        buckets, dead = 2 * (self.mask + 1), set(self.free)
        while True:
            self.resizes += 1
            self._new_table(buckets)
            if all(self._place(number) for number in range(len(self.keys)) if number not in dead):
                return
            buckets *= 2

    def delete(self, digest: bytes) -> bool:
        number = self.find(digest)
        if number is None:
            return False
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            for at in range(SLOTS):
                if self.prints[bucket][at] == mark and self.slots[bucket][at] == number:
                    self.prints[bucket][at], self.slots[bucket][at] = 0, -1
                    self.keys[number] = None
                    self.free.append(number)
                    return True
        return False

    def add(self, digest: bytes, order: tuple, count: int) -> None:
        """Counts a copy; the smallest ``order`` of a digest stays."""
        number = self.find(digest)
        if number is None:
            self.insert(digest, [order, count])
        else:
            value = self.values[number]
            value[0] = min(value[0], order)
            value[1] += count

    def live(self) -> Iterator[tuple[bytes, tuple, int]]:
        for key, value in zip(self.keys, self.values, strict=True):
            if key is not None:
                yield key, value[0], value[1]


def _live_rows(live: list[tuple[bytes, tuple, int]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(live), 50_000):
        part = live[at : at + 50_000]
        yield pa.RecordBatch.from_pydict(
            {
                "digest": pa.array([d for d, _, _ in part], pa.binary()),
                "keep_id": pa.array([None if o[0] else o[1] for _, o, _ in part], kind),
                "keep_tag": pa.array([o[2] for _, o, _ in part], pa.int64()),
                "group_size": pa.array([n for _, _, n in part], pa.int64()),
            }
        )


def _evicted(index: CuckooIndex) -> list[tuple[bytes, tuple, int]]:
    """Deletes from a full index what it has met once, or everything if that is less than half of it."""
    live = list(index.live())
    once = [x for x in live if x[2] == 1]
    gone = once if 2 * len(once) >= len(live) else live
    for digest, _, _ in gone:
        index.delete(digest)
    return gone


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry per live digest; a full index sends on what it deletes between two digests.

    Of unsorted input a digest may then be sent more than once; sorted input gives each exactly once, as a
    deleted digest doesn't come again.
    """
    index, last, kind = CuckooIndex(), None, pa.int64()
    for batch in batches:
        kind = batch.schema.field("keep_id").type
        # A null id sorts last: (True, ...) after every (False, id).
        for digest, doc_id, tag, count in zip(*(batch.column(c).to_pylist() for c in ("digest", "keep_id", "keep_tag", "group_size")), strict=True):
            if digest != last and len(index) >= FULL:
                yield from _live_rows(_evicted(index), kind)
            index.add(digest, (doc_id is None, 0 if doc_id is None else doc_id, tag), count)
            last = digest
    yield from _live_rows(list(index.live()), kind)


def digest_of(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with blanks normalised."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def live_digests(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_tag, group_size) of each live digest of ``rows`` (doc_id, digest, tag)."""
    entries = rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("tag").alias("keep_tag"), F.lit(1).cast("bigint").alias("group_size"))
    kind = f"digest binary, keep_id {entries.schema['keep_id'].dataType.simpleString()}, keep_tag bigint, group_size bigint"
    local = entries.mapInArrow(lean(_merge), kind)
    return local.repartition("digest").sortWithinPartitions("digest").mapInArrow(lean(_merge), kind)


def _digests(documents: DataFrame, tag: Column, scratch: Scratch) -> DataFrame:
    return scratch.store(documents.select("doc_id", digest_of(F.col("text")).alias("digest"), tag.alias("tag")), "digests")


def find_copies(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(documents.sparkSession)
    rows = _digests(documents, F.monotonically_increasing_id(), scratch)
    live = scratch.store(live_digests(rows), "live-digests")
    return join_weighed(rows, live, "digest", "group_size").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("tag") == F.col("keep_tag"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(documents: DataFrame) -> DataFrame:
    """``documents`` without later copies; columns as they came.

    Of rows that share text and smallest doc_id the one with the least row hash stays, however rows are dealt.  Texts
    are shuffled once, by what tells rows apart: rows that repeat wholly meet on the map side already, and the others of
    a group of copies go to as many places as there are.
    """
    scratch, tag = Scratch(documents.sparkSession), row_hash(documents)
    live = scratch.store(live_digests(_digests(documents, tag, scratch)), "live-digests")
    scratch.keep(live)

    def key(doc_id: Column, digest: Column, tag: Column) -> Column:
        return row_key(doc_id, F.concat(F.hex(digest), F.hex(tag)))

    name = unused(documents, "row_key")
    kept = live.select(key(F.col("keep_id"), F.col("digest"), F.col("keep_tag")).alias(name))
    rows = documents.withColumn(name, key(F.col("doc_id"), digest_of(F.col("text")), tag)).dropDuplicates([name])
    return rows.join(kept.hint("merge"), name, "left_semi").select(*[f"`{c}`" for c in documents.columns])
