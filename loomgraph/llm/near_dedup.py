"""Near-duplicate classes by DartMinHash (Christiani, 2020) and banded joins.

A document is a weighted set: its runs of five words with how often each occurs (a text of fewer
words is one run).  Similarity is the weighted Jaccard coefficient, sum of minima over sum of maxima;
documents at 0.8 or more are linked, and a class is a connected component of links, named after its
smallest doc_id.

Signatures.  An element of weight c spans c unit regions.  Each region receives darts at ranks that
form a Poisson process fixed by the region's hash alone, so documents that share a region see the
same darts.  Each dart belongs to one of ``K`` coordinates, and a coordinate keeps its earliest dart.
Darts are thrown only up to a rank at which the whole document expects about ``K (ln K + 2)`` of
them, so long documents look at few darts per region; should a coordinate stay empty, the rank bound
is doubled.  24 bands of 4 coordinates miss a pair at 0.8 with probability 3e-6.

Classes.
1. Rows of equal word sequences are one node (128 bits of the sequence); links join different nodes.
2. Each band value links its nodes to the one of them that shares most bands with others: one
   candidate a node and band, left out where the numbers of regions rule a link out.
3. Candidates are verified on the regions themselves, which are only taken from
   nodes that share a band; the verified links are contracted to classes.
4. A band value that still holds several classes elects two new leaders, one of its first leader's class
   and one of the others, and its nodes of other classes are compared with them; this goes on round by
   round, and each round's work is linear in what is left.  A value leaves the rounds when it holds one class,
   when all its pairs were compared, or when ``PATIENCE`` rounds in a row joined no classes of it.
5. Nodes of values that left with several classes are joined exactly, by prefix filtering.  Regions are ordered from
   rare to frequent, by a histogram of ``CELLS`` cells over all those nodes' regions.  Two of them can only reach the
   threshold if one of the rarest ninth of the smaller one's regions is among the rarest fifth of the larger one's, with
   enough regions behind both; such pairs, of different classes, are verified.  A node that is further from the text its
   group has in common than the threshold allows has a ninth of its own, so what a group shares makes no pairs.
6. Components come from alternating large-star and small-star steps over the links, as joins and
   groupings; neither links nor nodes are collected.

Defined cases: a text without words (null, empty, blanks) is a class of its own; rows are told apart by
their texts, so a doc_id that repeats with other texts has a class for each, and rows without an id
take part; a class is named after the smallest doc_id of its rows, null only if all are; ids may be of
any type that can be ordered; an empty table gives no rows; extra columns are ignored.  When copies
are dropped, rows that repeat in every column become one, and of rows that share doc_id and text the one with the least
hash of all columns stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_weighed, lean, row_hash, row_key, small_batches, unused
from .words import Words, mix, pieces

BANDS, ROWS = 24, 4
K = BANDS * ROWS
THRESHOLD = 0.8
#: Rounds without a new link after which a band value is left to the exact join.
PATIENCE = 1
#: Cells of the histogram that orders regions from rare to frequent: what the driver gets and tasks are sent, 2 MB.
CELLS = 1 << 18
#: Parts into which the rows of a class are dealt when its name changes.
SALTS = 16
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def unit_regions(owner: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and hashes of the unit regions of weighted sets, given one entry per unit of weight.

    The c-th entry of an element is its c-th region, so the weighted Jaccard coefficient of two sets
    is the plain one of their regions.
    """
    if not len(owner):
        return owner, element
    order = np.lexsort((element, owner))
    owner, element = owner[order], element[order]
    fresh = np.ones(len(owner), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (element[1:] != element[:-1])
    runs = np.flatnonzero(fresh)
    copy = np.arange(len(owner)) - np.repeat(runs, np.diff(np.append(runs, len(owner))))
    with np.errstate(over="ignore"):
        return owner, mix(element + copy.astype(np.uint64) * _GOLD)


def signatures(owner: np.ndarray, region: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """The (n, k) DartMinHash signatures of n sets of unit regions, sorted by owner; without regions, zeros."""
    out = np.zeros((n, k), dtype=np.uint64)
    if not len(owner):
        return out
    weight = np.bincount(owner, minlength=n).astype(float)
    bound = np.zeros(n)
    todo = weight > 0
    bound[todo] = k * (math.log(k) + 2) / weight[todo]
    while todo.any():
        live = todo[owner]
        cell, who, rank = region[live], owner[live], np.zeros(int(live.sum()))
        best = np.full(n * k, np.inf)
        mark = np.zeros(n * k, dtype=np.uint64)
        step = 0
        while len(cell):
            step += 1
            draw = mix(cell + np.uint64(step * 0xD1342543DE82EF95 & (1 << 64) - 1))
            rank = rank - np.log1p(-(draw >> np.uint64(11)).astype(float) * 2.0**-53)
            hit = rank < bound[who]
            cell, who, rank, draw = cell[hit], who[hit], rank[hit], draw[hit]
            dart = mix(draw ^ _GOLD)
            at = who * k + (dart % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, at, rank)
            won = best[at] == rank
            mark[at[won]] = dart[won]
        best = best.reshape(n, k)
        done = todo & np.isfinite(best).all(axis=1)
        out[done] = mark.reshape(n, k)[done]
        todo &= ~done
        bound[todo] *= 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One hash per band, (n, BANDS)."""
    acc = np.zeros((len(signature), BANDS), dtype=np.uint64)
    parts = signature.reshape(len(signature), BANDS, ROWS)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            acc = mix(acc * _GOLD + parts[:, :, j] + np.arange(BANDS, dtype=np.uint64))
    return acc


def _content(words: Words) -> np.ndarray:
    """128 bits of each word sequence, (n, 2): two sums over its words by position."""
    with np.errstate(over="ignore"):
        place = np.arange(len(words.hash), dtype=np.uint64) - np.repeat(words.first[:-1].astype(np.uint64), words.count)
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(words.hash + mix(place + np.uint64(c))), dtype=np.uint64)]) for c in (11, 1 << 40)]
        return np.stack([mix(s[words.first[1:]] - s[words.first[:-1]] + words.count.astype(np.uint64)) for s in sums], axis=1)


def _nodes(words: Words) -> pa.Array:
    content, some = _content(words), words.count > 0
    return pa.array([content[i].tobytes() if some[i] else None for i in range(len(some))], pa.binary())


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node, number of regions and band values of each text; its other columns stay, the text goes."""
    for batch in pieces(batches, "text"):
        words = Words(batch.column("text"))
        some, owner_region = words.count > 0, unit_regions(*words.shingles())
        size = np.bincount(owner_region[0], minlength=len(some)).astype(np.int32)
        keys = band_keys(signatures(*owner_region, len(some))).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()))
        kept = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in kept], _nodes(words), pa.array(size), bands], names=[*kept, "node", "size", "bands"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of the regions of each text."""
    for batch in pieces(batches, "text"):
        words = Words(batch.column("text"))
        owner, region = unit_regions(*words.shingles())
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words.count)))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([_nodes(words), pa.ListArray.from_arrays(pa.array(offsets), pa.array(region.view(np.int64)))], names=["node", "regions"])


def _cells(regions: np.ndarray) -> np.ndarray:
    return (mix(regions.view(np.uint64)) % np.uint64(CELLS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many regions of a task's texts fall into each cell."""
    n = np.zeros(CELLS, np.int64)
    for batch in batches:
        flat = batch.column("regions").flatten().to_numpy(zero_copy_only=False)
        np.add.at(n, _cells(flat), 1)
    cell = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n[cell])], names=["cell", "n"])


def prefix_sizes(size: int) -> tuple[int, int]:
    """Of two sets that reach the threshold, these many of the rarest regions of the smaller and of the larger one meet."""
    least = THRESHOLD * size - 1e-9
    return size - math.ceil(2 * least / (1 + THRESHOLD)) + 1, size - math.ceil(least) + 1


def _exact(rest: DataFrame, roots: DataFrame, regions: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, ra, rb): the links among ``rest`` (value, node, size) between nodes of different classes, and these."""
    named = rest.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = named.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("value")
    nodes = scratch.store(named.join(several.hint("merge"), "value", "left_semi").select("node", "root", "size").distinct(), "near-rest")
    own = scratch.store(nodes.join(regions.hint("merge"), "node"), "near-rest-regions")
    cells = own.select("regions").mapInArrow(lean(_counted), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(CELLS, np.int64)
    n[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, at, short, counts = [], [], [], []
            for row in batch.column("regions"):
                own = row.values.to_numpy(zero_copy_only=False)
                order = np.lexsort((own, n[_cells(own)]))
                few, many = prefix_sizes(len(own))
                region.append(own[order[:many]])
                at.append(np.arange(many, dtype=np.int32))
                short.append(at[-1] < few)
                counts.append(many)
            of = np.repeat(np.arange(len(counts)), counts)
            columns = [batch.column(c).take(pa.array(of)) for c in ("node", "root", "size")]
            columns += [pa.array(np.concatenate([np.zeros(0, kind), *x])) for x, kind in ((region, np.int64), (at, np.int32), (short, bool))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "size", "region", "at", "short"])

    firsts = scratch.store(own.mapInArrow(lean(rare), "node binary, root binary, size int, region bigint, at int, short boolean"), "near-rare")
    shared = firsts.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.bool_or("short").alias("short")).filter("low <> high and short").select("region")
    met = firsts.join(shared.hint("merge"), "region", "left_semi")
    one, two = (met.select("region", "short", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "size", "at")]) for k in ("a", "b"))
    fits = f"(size_a < size_b or size_a = size_b and node_a < node_b) and root_a <> root_b and size_a >= {THRESHOLD}D * size_b"
    behind = f"least(size_a - at_a, size_b - at_b) >= {THRESHOLD / (1 + THRESHOLD)!r}D * (size_a + size_b) - 1e-6D"
    pairs = one.filter("short").drop("short").join(two.drop("short").hint("merge"), "region").filter(f"{fits} and {behind}")
    pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("root_a").alias("ra"), F.col("root_b").alias("rb")).distinct()
    return scratch.store(_verify(pairs, regions), "near-exact")


def _verify(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose weighted Jaccard coefficient reaches the threshold."""
    left, right = (regions.select(F.col("node").alias(k), F.col("regions").alias(f"of_{k}")) for k in ("a", "b"))
    full = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return full.filter(both >= THRESHOLD * (F.size("of_a") + F.size("of_b") - both)).drop("of_a", "of_b")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the links no longer change.
    """
    scratch = Scratch(links.sparkSession)

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = scratch.store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), label)
    now = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_lowest, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_lowest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        was, before, edges = now, edges, scratch.store(small, label)
        now = state(edges)
        scratch.clear(before)
        if was == now:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _leaders_first(together: DataFrame) -> DataFrame:
    """Per band value the node that shares most bands: among copies of one text with edits of their own, the text
    itself, to which all of them are closer than to each other."""
    fame = together.groupBy("node").agg(F.sum("n").alias("fame"))
    famed = together.join(fame.hint("merge"), "node")
    return famed.groupBy("value").agg(F.max_by(F.struct("node", "size", F.col("node").alias("root")), F.struct("fame", "node")).alias("lead"))


def _candidates(rows: DataFrame, leads: DataFrame) -> DataFrame:
    """Pairs (a, b) of a leader and a row of its band value, of other classes and of sizes that allow a link."""
    pairs = rows.join(leads.hint("merge"), "value").filter(f"root <> lead.root and least(size, lead.size) >= {THRESHOLD} * greatest(size, lead.size)")
    one, two = F.struct("node", "root"), F.struct("lead.node", "lead.root")
    return pairs.select(F.least(one, two).alias("one"), F.greatest(one, two).alias("two")).distinct().select(
        F.col("one.node").alias("a"), F.col("two.node").alias("b"), F.col("one.root").alias("ra"), F.col("two.root").alias("rb")
    )


def _hooked(links: DataFrame) -> DataFrame:
    """(root, named): the least root that each root meets in the links, where that is another."""
    met = links.select(F.col("ra").alias("root"), F.col("rb").alias("named")).unionByName(links.select(F.col("rb").alias("root"), F.col("ra").alias("named")))
    return met.groupBy("root").agg(F.min("named").alias("named")).filter("named < root")


def _linked(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Sketches of ``rows`` (text and what else is wanted of each), and (node, root) of the nodes that are linked."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.withColumns({"text": F.coalesce("text", F.lit("")), "tag": F.md5(F.coalesce("text", F.lit("")))})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    sketches = scratch.store(rows.mapInArrow(lean(_sketched), f"{kinds}, node binary, size int, bands array<bigint>"), "near-sketches")
    own = scratch.store(sketches.filter("node is not null").select("node", "tag", "size", "bands").dropDuplicates(["node"]), "near-nodes")

    placed = own.select("node", "size", F.explode("bands").alias("value"))
    counted = placed.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    together = scratch.store(placed.join(counted.hint("merge"), "value"), "near-together")
    first = scratch.store(_leaders_first(together), "near-leaders")
    # The texts involved grow with the corpus: one plan at every size.  Copies of a text meet on the map side.
    involved = together.select("node").distinct().join(own.select("node", "tag").hint("merge"), "node").select("tag")
    wanted = rows.select("tag", "text").dropDuplicates(["tag"]).join(involved.hint("merge"), "tag", "left_semi").select("text")
    regions = scratch.store(wanted.mapInArrow(lean(_regions), "node binary, regions array<bigint>"), "near-regions")
    alone = together.withColumn("root", F.col("node"))
    links = scratch.store(_verify(_candidates(alone, first), regions).select("a", "b"), "near-links")

    # What is left of each band value, round by round: its nodes under their classes' names.
    roots = components(links)
    led = F.col("node") == F.col("lead.node")
    left = alone.join(first.hint("merge"), "value").select("value", "node", "size", "root", led.alias("led"), F.col("lead.node").alias("main"), F.lit(-1).alias("idle"))
    names, turn, rest = roots.withColumnsRenamed({"root": "named", "node": "root"}), 0, []
    while True:
        turn += 1
        # From the second round on, a class may hold many rows under one name: its rows are dealt by salt.
        salts = 1 if turn == 1 else SALTS
        left = left.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)))
        names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        left = left.join(names.hint("merge"), ["root", "salt"], "left").select("value", "node", "size", F.coalesce("named", "root").alias("root"), "led", "main", "idle", F.col("named").isNotNull().alias("renamed"))
        state = left.groupBy("value").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.count_if(~F.col("led")).alias("fresh"),
            F.max(F.when(F.col("node") == F.col("main"), F.col("root"))).alias("main_root"), F.max("idle").alias("idle"), F.bool_or("renamed").alias("renamed"),
        )
        # A value stays while it holds several classes and two nodes that haven't led; too long idle, it is left to the exact join.
        state = state.filter("low <> high and fresh > 1").select("value", "main_root", F.when(F.col("renamed"), 0).otherwise(F.col("idle") + 1).alias("idle"))
        now = left.drop("idle", "renamed").join(state.hint("merge"), "value").withColumn("seat", F.col("root") == F.col("main_root")).drop("main_root")
        now = scratch.store(now, "near-left")
        rest.append(now.filter((F.col("idle") >= PATIENCE) & ~F.col("led")).select("value", "node", "size"))
        now = now.filter(F.col("idle") < PATIENCE)
        if now.isEmpty():
            break
        # One leader a seat: the least hash among those that haven't led.
        leads = scratch.store(now.filter("not led").groupBy("value", "seat").agg(F.min_by(F.struct("node", "size", "root"), F.xxhash64("node", F.lit(turn))).alias("lead")), "near-leads")
        more = scratch.store(_verify(_candidates(now.filter("not led"), leads.drop("seat")), regions), "near-more")
        links = links.unionByName(more.select("a", "b"))
        marked = leads.select("value", F.col("lead.node").alias("node"), F.lit(True).alias("leads"))
        left = now.join(marked.hint("merge"), ["value", "node"], "left").select("value", "node", "size", "root", (F.col("led") | F.coalesce("leads", F.lit(False))).alias("led"), "main", "idle")
        # Classes that a new link joins take the least name among them.
        names = _hooked(more)
    if turn > 1:
        roots = components(links)
    left_over, joined = reduce(DataFrame.unionByName, rest), None
    if not left_over.isEmpty():
        more = _exact(left_over, roots, regions, scratch)
        # The classes that these links join, few beside all links, get one name.
        joined = components(more.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).withColumnsRenamed({"root": "named", "node": "root"})
    roots = own.select("node").join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    if joined is not None:
        roots = roots.join(joined, "root", "left").select("node", F.coalesce("named", "root").alias("root"))
    return sketches, scratch.store(roots, "near-roots")


def _classes(rows: DataFrame, order: Column, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Sketches of ``rows``, and per node: n rows, the least ``order`` and the number of rows of its class."""
    sketches, roots = _linked(rows, scratch)
    of_node = sketches.filter("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min(order).alias("least"))
    of_node = scratch.store(of_node.join(roots.hint("merge"), "node"), "near-members")
    of_class = of_node.groupBy("root").agg(F.sum("n").alias("class_size"), F.min("least").alias("best"), F.count("*").alias("nodes"))
    named = join_weighed(of_node.select("node", "n", "root"), scratch.store(of_class, "near-class"), "root", "nodes")
    named = scratch.store(named.select("node", "n", "class_size", "best"), "near-named")
    return sketches, named


def near_classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size for every row of ``documents``."""
    scratch = Scratch(documents.sparkSession)
    order = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id")
    sketches, named = _classes(documents.select("doc_id", "text"), order, scratch)
    classed = join_weighed(sketches.filter("node is not null").select("doc_id", "node"), named, "node", "n").select("doc_id", F.col("best.doc_id").alias("class_id"), "class_size")
    alone = sketches.filter("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    out = scratch.store(classed.unionByName(alone), "near-classes")
    scratch.keep(out)
    return out


def drop_near_copies(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each class, that of the smallest doc_id; columns as they came."""
    scratch = Scratch(documents.sparkSession)
    # Rows that differ in any column are told apart, so it doesn't matter how they are dealt which one stays.
    key = F.md5(F.concat(row_key(F.col("doc_id"), F.col("text")), F.hex(row_hash(documents))))
    order = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "key")
    sketches, named = _classes(documents.select("doc_id", key.alias("key"), "text"), order, scratch)
    classed = join_weighed(sketches.filter("node is not null").select("key", "node"), named, "node", "n")
    name = unused(documents, "row_key")
    gone = scratch.store(classed.filter("key <> best.key").select(F.col("key").alias(name)).distinct(), "near-gone")
    scratch.keep(gone)
    # Rows of one key are the same row; they meet before they are shuffled, and the join uses that shuffle.
    rows = documents.withColumn(name, key).dropDuplicates([name])
    return rows.join(gone.hint("merge"), name, "left_anti").select(*[f"`{c}`" for c in documents.columns])
