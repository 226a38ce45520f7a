r"""A Merkle manifest of a dataset, its trees stored as blocks in van Emde Boas order.

Trees.  Every row is a leaf: the SHA-256 of its five columns, each ``-`` if null, else UTF-8 byte count, colon, value.
The rows of one ``lang`` are a tree, ordered by doc_id: every ``FAN`` consecutive nodes (the last run may be shorter,
even one) become their digest, until one node remains, the tree's subroot.  The subroots, in bytewise order of lang,
null first, are the leaves of one more tree, whose top is the root.  Digests are hashed as lowercase hex text.

Blocks.  A tree is cut into aligned subtrees of ``FAN ** height`` leaves, one task's work each; the tops of the
blocks are the leaves of the next round, so a tree of any size needs a round for every ``height`` levels.  A block
holds its nodes in van Emde Boas order: the levels are split at half height, the upper part is stored first, the lower
subtrees one after another, each part split the same way, whatever the size of a cache line or page.  ``place`` gives a
node's address by arithmetic, in construction as in the look-up of siblings.  A tree lower than a block gets a block
of its own height; nodes that a short last run lacks stay zero.

Ranks.  Leaves are range-partitioned by (tree, doc_id, leaf) and numbered by counts per partition and prefix sums, so
no language is sorted or counted in one task.  Proofs go down round by round: a block, its own path and its entries
meet by (tree, block), at most ``FAN ** height`` rows.

Defined cases: nulls are ``-``, a null lang is a tree of its own, a null doc_id comes first; equal doc_ids are ordered
by leaf, repeated rows are leaves side by side; empty and long texts are hashed whole; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ascii_lower, lean, small_batches

FAN, BITS = 8, 3
HEIGHT = 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of subroots; the other trees are named after their lang.
TOP = "top"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of some columns, told apart by their lengths."""

    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in parts]), 256)


def leaf_of(text: Column | None = None) -> Column:
    """The leaf of a row of ``documents``, or of what it would be with another text."""
    return digest(*[text if text is not None and c == "text" else F.col(c) for c in COLUMNS])


def size_of(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def place(levels: int, depth: int, at: np.ndarray) -> np.ndarray:
    """Addresses, in van Emde Boas order, of nodes ``at`` (from the left) of a depth of a complete tree."""
    base, at = np.zeros(len(at), np.int64), np.asarray(at, np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
        else:
            depth, levels = depth - upper, levels - upper
            base += size_of(upper) + (at >> BITS * depth) * size_of(levels)
            at = at & ((1 << BITS * depth) - 1)
    return base


@cache
def _places(levels: int) -> list[np.ndarray]:
    return [place(levels, d, np.arange(FAN**d)) for d in range(levels)]


def levels_of(leaves: int, most: int) -> int:
    """Levels of a block: as few as hold its tree, or ``most`` and the leaves' own."""
    n = 1
    while n <= most and FAN ** (n - 1) < leaves:
        n += 1
    return n


def _hash(hexed: str) -> bytes:
    return hashlib.sha256(hexed.encode()).digest()


def build_block(leaves: np.ndarray, levels: int) -> np.ndarray:
    """The nodes (n, 32) of a block over ``leaves`` (up to FAN ** (levels - 1), 32)."""
    at = _places(levels)
    nodes = np.zeros((size_of(levels), 32), np.uint8)
    count = len(leaves)
    nodes[at[-1][:count]] = leaves
    for depth in range(levels - 2, -1, -1):
        below = nodes[at[depth + 1][:count]].tobytes().hex()
        count = -(-count // FAN)
        step = 64 * FAN
        made = b"".join(_hash(below[i * step : (i + 1) * step]) for i in range(count))
        nodes[at[depth][:count]] = np.frombuffer(made, np.uint8).reshape(-1, 32)
    return nodes


@dataclass
class Manifest:
    """``leaves``: tree, pos, total, node, doc_id, claim; ``rounds``: of each, blocks (tree, block, leaves, levels, total, nodes); ``tops``: likewise for the tree of subroots."""

    leaves: DataFrame
    rounds: list[DataFrame]
    tops: list[DataFrame]
    subroots: DataFrame
    height: int
    scratch: Scratch


def _ranked(rows: DataFrame, by: list[str], scratch: Scratch, label: str) -> DataFrame:
    """``rows`` with ``pos`` in their tree, ordered by ``by``, and the tree's ``total``."""
    order = ["tree", *[F.col(c).asc_nulls_first() for c in by]]
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    numbered = scratch.store(numbered.withColumn("part", F.shiftright("seq", 33)), label)
    counts = numbered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("from"))
    # One row a tree and partition, whatever the number of leaves.
    tree = Window.partitionBy("tree")
    counts = counts.select("tree", "part", "from", (F.sum("n").over(tree.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(tree).alias("total"))
    return numbered.join(counts, ["tree", "part"]).withColumn("pos", F.col("before") + F.col("seq") - F.col("from")).drop("part", "seq", "from", "before")


_BLOCK = "tree string, block bigint, leaves int, levels int, total bigint, nodes binary, node binary"


def _blocks(rows: DataFrame, height: int) -> DataFrame:
    """The blocks of one round, from (tree, pos, total, node)."""
    width = FAN**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "total", "node")), strict=True)

        for (tree, block), group in groupby(entries(), itemgetter(0, 1)):
            own = list(group)
            leaves = np.frombuffer(b"".join(r[3] for r in own), np.uint8).reshape(-1, 32)
            levels = levels_of(own[0][2], height)
            nodes = build_block(leaves, levels)
            yield pa.RecordBatch.from_pydict(
                {
                    "tree": [tree],
                    "block": pa.array([block], pa.int64()),
                    "leaves": pa.array([len(own)], pa.int32()),
                    "levels": pa.array([levels], pa.int32()),
                    "total": pa.array([own[0][2]], pa.int64()),
                    "nodes": pa.array([nodes.tobytes()], pa.binary()),
                    "node": pa.array([nodes[0].tobytes()], pa.binary()),
                }
            )

    cut = rows.select("tree", F.floor(F.col("pos") / width).cast("bigint").alias("block"), "pos", F.col("total").cast("bigint").alias("total"), "node")
    return cut.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(lean(run), _BLOCK)


def _rounds(rows: DataFrame, height: int, scratch: Scratch, label: str) -> list[DataFrame]:
    """Blocks of all rounds, from the leaves up; the last round of a tree has one block."""
    width, found = FAN**height, []
    while True:
        found.append(scratch.store(_blocks(rows, height), f"{label}-{len(found)}"))
        more = found[-1].filter(F.col("total") > width)
        if more.isEmpty():
            return found
        rows = more.select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / width).alias("total"), "node")


def _last(rounds: list[DataFrame], height: int) -> DataFrame:
    """(tree, node): the top of each tree."""
    tops = [r.filter(F.col("total") <= FAN**height).select("tree", "node") for r in rounds]
    whole = tops[0]
    for r in tops[1:]:
        whole = whole.unionByName(r)
    return whole


def build(documents: DataFrame, claim: Column | None = None, height: int = HEIGHT) -> Manifest:
    """The manifest of ``documents``; ``claim`` (hex) is the leaf that ``proofs`` is to check in place of a row's own, null for none."""
    small_batches(documents.sparkSession)
    scratch = Scratch(documents.sparkSession)
    claim = F.lit(None).cast("string") if claim is None else claim
    hashed = documents.select(
        # Names sort as langs do, bytewise, null first.
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        "doc_id",
        F.unhex(leaf_of()).alias("node"),
        F.unhex(claim).alias("claim"),
    )
    # Equal rows are told apart, so that a range boundary can fall between them.
    hashed = scratch.store(hashed.withColumn("tag", F.monotonically_increasing_id()), "leaves")
    ranked = _ranked(hashed, ["doc_id", "node", "tag"], scratch, "leaves-ranked").drop("tag")
    scratch.clear(hashed)
    rounds = _rounds(ranked, height, scratch, "blocks")
    subroots = _last(rounds, height)
    named = subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "node")
    top = scratch.store(_ranked(named, ["name"], scratch, "tops-ranked"), "tops")
    return Manifest(ranked, rounds, _rounds(top, height, scratch, "top-blocks"), top, height, scratch)


#: Rows that meet at a block, in this order.
_PATH, _NODES, _ENTRY = range(3)


def _siblings(nodes: np.ndarray, levels: int, leaves: int) -> list[list[tuple[int, bytes]]]:
    """For each depth but the top, per node: its place in its run and the run's others."""
    out, counts = [], [leaves]
    for _ in range(levels - 1):
        counts.append(-(-counts[-1] // FAN))
    for depth in range(1, levels):
        n = counts[levels - 1 - depth]
        raw = nodes[_places(levels)[depth][:n]].tobytes()
        own = []
        for a in range(0, n, FAN):
            run = raw[32 * a : 32 * min(n, a + FAN)]
            own += [(i, run[: 32 * i] + run[32 * i + 32 :]) for i in range(len(run) // 32)]
        out.append(own)
    return out


def packed(steps: list[tuple[int, bytes]]) -> bytes:
    """A path as bytes: per level the place in the run, the number of siblings, the siblings."""
    return b"".join(bytes((i, len(others) // 32)) + others for i, others in steps)


def unpacked(path: bytes) -> list[tuple[int, bytes]]:
    steps, at = [], 0
    while at < len(path):
        end = at + 2 + 32 * path[at + 1]
        steps.append((path[at], path[at + 2 : end]))
        at = end
    return steps


def fold(node: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root that a node and its siblings give."""
    for i, others in steps:
        node = _hash((others[: 32 * i] + node + others[32 * i :]).hex())
    return node


def _met(entries: DataFrame, blocks: DataFrame, paths: DataFrame, height: int, extra: tuple[str, ...]) -> DataFrame:
    """Paths, blocks and entries of one round, each block's rows together and in that order."""
    width, none, zero = FAN**height, F.lit(None).cast("binary"), F.lit(0)
    empty = [F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in extra]

    def row(df: DataFrame, kind: int, block: Column, pos: Column, leaves: Column, levels: Column, data: Column, subroot: Column, root: Column, more: list) -> DataFrame:
        return df.select(
            "tree", block.cast("bigint").alias("block"), F.lit(kind).alias("kind"), pos.cast("bigint").alias("pos"), leaves.alias("leaves"), levels.alias("levels"),
            data.alias("data"), subroot.alias("subroot"), root.alias("root"), *more,
        )

    all_rows = row(paths, _PATH, F.col("pos"), zero, zero, zero, F.col("path"), F.col("subroot"), F.col("root"), empty)
    all_rows = all_rows.union(row(blocks, _NODES, F.col("block"), zero, F.col("leaves"), F.col("levels"), F.col("nodes"), none, none, empty))
    all_rows = all_rows.union(row(entries, _ENTRY, F.floor(F.col("pos") / width), F.col("pos"), zero, zero, F.col("node"), none, none, list(extra)))
    return all_rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "pos")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each block its siblings, the steps above it, subroot, root, and its entries."""

    def entries() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    for _, group in groupby(entries(), itemgetter("tree", "block")):
        path, block = next(group), next(group)
        nodes = np.frombuffer(block["data"], np.uint8).reshape(-1, 32)
        own = _siblings(nodes, block["levels"], block["leaves"])
        upper = unpacked(path["data"])
        yield own, upper, path["subroot"], path["root"], group


def _steps(own: list, upper: list, at: int) -> list[tuple[int, bytes]]:
    return [own[depth][at >> BITS * (len(own) - 1 - depth)] for depth in range(len(own) - 1, -1, -1)] + upper


def _paths(entries: DataFrame, blocks: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """(tree, pos, path, subroot, root, node) of the entries of one round."""
    width = FAN**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, upper, subroot, root, group in _groups(batches):
            rows = [(r["tree"], r["pos"], packed(_steps(own, upper, r["pos"] % width)), subroot, root, r["data"]) for r in group]
            kinds = [pa.string(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["tree", "pos", "path", "subroot", "root", "node"])

    return _met(entries, blocks, paths, height, ()).mapInArrow(lean(run), "tree string, pos bigint, path binary, subroot binary, root binary, node binary")


def _descend(rounds: list[DataFrame], first: DataFrame, height: int, scratch: Scratch, label: str) -> list[DataFrame]:
    """For each round the paths of its blocks; ``first`` has those of the trees' tops, as (tree, pos 0, path, subroot, root)."""
    found: list[DataFrame] = []
    above: DataFrame | None = None
    for at in range(len(rounds) - 1, -1, -1):
        paths = first.join(rounds[at].filter(F.col("total") <= FAN**height).select("tree"), "tree", "left_semi")
        if above is not None:
            inner = rounds[at].filter(F.col("total") > FAN**height).select("tree", F.col("block").alias("pos"), "node")
            paths = paths.unionByName(scratch.store(_paths(inner, rounds[at + 1], above, height).drop("node"), f"{label}-{at}"))
        found.append(paths)
        above = paths
    return found[::-1]


def proofs(manifest: Manifest, with_paths: bool = False) -> DataFrame:
    """One row a leaf: doc_id, leaf, subroot, root, proof_sha256, n_siblings, folded_root, verified, all digests in hex.

    ``proof_sha256`` is the digest of the siblings' hex from the leaf to the root; ``folded_root`` is what the claimed
    leaf, or where none is claimed the leaf itself, and the siblings give.  ``with_paths`` adds ``path``, as ``packed`` makes it.
    """
    m, width = manifest, FAN**manifest.height
    none = F.lit(None).cast("binary")
    zero = F.lit(0).cast("bigint").alias("pos")
    whole = m.tops[-1].select("tree", zero, F.lit(b"").alias("path"), none.alias("subroot"), F.col("node").alias("root"))
    top = _descend(m.tops, whole, m.height, m.scratch, "top-paths")[0]
    named = _paths(m.subroots, m.tops[0], top, m.height)
    names = m.subroots.select(F.col("name").alias("lang_tree"), "pos")
    # A subroot's path, under the name of its tree.
    first = m.scratch.store(named.join(names, "pos").select(F.col("lang_tree").alias("tree"), zero, "path", F.col("node").alias("subroot"), "root"), "subroot-paths")
    paths = _descend(m.rounds, first, m.height, m.scratch, "paths")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, upper, subroot, root, group in _groups(batches):
            rows = []
            upper_hex = b"".join(others for _, others in upper).hex()
            upper_count = sum(len(others) for _, others in upper) // 32
            for r in group:
                inner = _steps(own, [], r["pos"] % width)
                siblings = b"".join(others for _, others in inner)
                proof = hashlib.sha256((siblings.hex() + upper_hex).encode()).hexdigest()
                folded = fold(r["claim"] or r["data"], inner + upper)
                path = packed(inner + upper) if with_paths else None
                rows.append((r["doc_id"], r["data"].hex(), subroot.hex(), root.hex(), proof, len(siblings) // 32 + upper_count, folded.hex(), folded == root, path))
            kinds = [*[pa.string()] * 5, pa.int64(), pa.string(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names_out)

    names_out = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "n_siblings", "folded_root", "verified", "path"]
    out = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, n_siblings bigint, folded_root string, verified boolean, path binary"
    entries = m.leaves.select("tree", "pos", "node", F.col("doc_id").cast("string").alias("doc_id"), "claim")
    found = _met(entries, m.rounds[0], paths, m.height, ("doc_id", "claim")).mapInArrow(lean(run), out)
    found = found.withColumn("doc_id", F.col("doc_id").cast(m.leaves.schema["doc_id"].dataType))
    return found if with_paths else found.drop("path")


def tampered(documents: DataFrame) -> Column:
    """The leaf of a row whose text lost its capitals, where 3 divides crc32(doc_id); else null."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_of(ascii_lower(F.col("text"))))
