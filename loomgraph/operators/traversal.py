"""Graph algorithms as joins over (nodes, edges), per repository and for all repositories at once.

Rounds write their state to the shared folder, so plans stay short and a lost executor costs a round.
Whatever is compared between rounds is a count or a hash, never a set of nodes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import Scratch, stored

from .ranks import ranked

REPO = "repository_id"
_PAIR = [REPO, "id"]


def _links(edges: DataFrame, direction: str) -> DataFrame:
    """Distinct (repository_id, id, next) in the direction asked for."""
    out = edges.select(REPO, F.col("src").alias("id"), F.col("dst").alias("next"))
    back = edges.select(REPO, F.col("dst").alias("id"), F.col("src").alias("next"))
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction].distinct()


def bfs(start: DataFrame, edges: DataFrame, depth: int | None = None, direction: str = "outgoing") -> DataFrame:
    """(repository_id, id, depth, parent) reached from the start ids, which need not be nodes.

    ``parent`` is the smallest id of the level before that leads to a node.
    """
    # Every level joins the links again: derive them once.
    links = stored(_links(edges, direction), "bfs-links") if depth is None or depth > 1 else _links(edges, direction)
    seen = start.select(REPO, "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))
    front, level = seen, 0
    while depth is None or level < depth:
        level += 1
        fresh = front.select(REPO, "id").join(links, _PAIR).groupBy(REPO, "next").agg(F.min("id").alias("parent"))
        fresh = fresh.select(REPO, F.col("next").alias("id"), F.lit(level).alias("depth"), "parent").join(seen.select(REPO, "id"), _PAIR, "left_anti")
        front = stored(fresh, "bfs")
        if front.isEmpty():
            break
        seen = _compacted(seen.unionByName(front), level)
    return seen


def _compacted(seen: DataFrame, level: int) -> DataFrame:
    """What is seen so far, as one table every few levels, so that neither plans nor files add up."""
    return stored(seen, "seen") if level % 8 == 0 else seen


#: Starts in one word of bits; the sign bit stays free.
_WORD = 63


def distances(start: DataFrame, edges: DataFrame, depth: int, direction: str = "outgoing") -> DataFrame:
    """(repository_id, start, id, depth): what each start reaches within ``depth`` steps, and in how many at least.

    All starts go at once: they are numbered within their repository, ``_WORD`` of them are the bits of a word, and a row
    (node, word) carries those that reach the node.  A round spreads words along the links, joins them by ``bit_or`` and
    takes out the bits seen before, so a node that many starts reach is met once a word, not once a start.
    """
    scratch = Scratch(start.sparkSession)
    links = scratch.store(_links(edges, direction), "distance-links")
    numbered = ranked(start.select(REPO, "id").distinct(), [REPO], ["id"], "n", scratch)
    numbered = scratch.store(numbered.select(REPO, "id", F.floor(F.col("n") / _WORD).alias("word"), (F.col("n") % _WORD).cast("int").alias("bit")), "distance-starts")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    front = scratch.store(numbered.select(REPO, "id", "word", one.alias("bits")), "distance-front")
    seen, fronts = front, [front]
    for level in range(1, depth + 1):
        sent = front.join(links, _PAIR).groupBy(REPO, F.col("next").alias("id"), "word").agg(F.bit_or("bits").alias("sent"))
        met = sent.join(seen.withColumnRenamed("bits", "before"), [REPO, "id", "word"], "full")
        before = F.coalesce("before", F.lit(0).cast("bigint"))
        fresh = F.coalesce("sent", F.lit(0).cast("bigint")).bitwiseAND(F.bitwise_not(before))
        # One table a round holds what is seen so far and what is new: the next round reads it alone.
        state = scratch.store(met.select(REPO, "id", "word", before.bitwiseOR(fresh).alias("bits"), fresh.alias("fresh")), "distance-state")
        if level > 1:
            scratch.clear(seen)
        front, seen = state.filter("fresh <> 0").select(REPO, "id", "word", F.col("fresh").alias("bits")), state.drop("fresh")
        front = scratch.store(front, "distance-front")
        if front.isEmpty():
            break
        fronts.append(front)
    reached = reduce(DataFrame.unionByName, [f.withColumn("depth", F.lit(level)) for level, f in enumerate(fronts)])
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(_WORD - 1)), lambda b: F.call_function("shiftright", F.col("bits"), b).bitwiseAND(1) == 1))
    told = reached.select(REPO, "id", "word", "depth", bit.alias("bit"))
    return told.join(numbered.withColumnRenamed("id", "start"), [REPO, "word", "bit"]).select(REPO, "start", "id", "depth")


def follow(start: DataFrame, step: DataFrame) -> DataFrame:
    """(repository_id, id, ancestor, depth) along a table with at most one ``base`` per id; each id is its own ancestor at 0.

    All ids take one step a round, so rounds count the longest chain, not the ids; a cycle ends where it returns.
    """
    front = start.select(REPO, "id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    seen, level = front, 0
    step = stored(step.select(REPO, F.col("id").alias("ancestor"), "base"), "follow-step")
    while True:
        level += 1
        ahead = front.join(step, [REPO, "ancestor"]).select(REPO, "id", F.col("base").alias("ancestor"), F.lit(level).alias("depth"))
        front = stored(ahead.join(seen.select(REPO, "id", "ancestor"), [REPO, "id", "ancestor"], "left_anti"), "follow")
        if front.isEmpty():
            return seen
        seen = _compacted(seen.unionByName(front), level)


def lineage(ids: DataFrame, parents: DataFrame, targets: DataFrame, rounds: int = 16) -> DataFrame:
    """Those of ``parents`` that lie on the ways up from ``ids``, each as far as the first target.

    A round goes one step up from few ids; ways longer than ``rounds`` are left to whoever doubles pointers: then all parents are given.
    """
    front, steps = ids.select(REPO, "id").distinct().join(targets, _PAIR, "left_anti"), []
    for _ in range(rounds):
        step = stored(parents.select(REPO, "id", "parent").join(front, _PAIR, "left_semi"), "lineage")
        steps.append(step)
        if step.isEmpty():
            return reduce(DataFrame.unionByName, steps)
        ahead = step.select(REPO, F.col("parent").alias("id")).distinct().join(targets, _PAIR, "left_anti")
        # What was met before has its parents already; a cycle ends here and is told by ``nearest_above``.
        front = reduce(lambda rows, met: rows.join(met.select(REPO, "id"), _PAIR, "left_anti"), steps, ahead)
    return parents


#: Of rows that point to few places a shuffle by place makes few large tasks: places with a thousandth of the rows are looked up apart.
_SHARE, _MANY = 1000, 10_000


def _followed(rows: DataFrame, further: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    """``rows`` (repository_id, id, to), ``count`` of them, with ``to`` and ``done`` of the place that ``to`` is in ``further``."""
    at, known = [REPO, "to"], further.select(REPO, F.col("id").alias("to"), F.col("to").alias("next"), "done")
    ahead = lambda df: df.select(REPO, "id", F.col("next").alias("to"), "done")
    if count < _MANY:
        return ahead(rows.join(known, at))
    met = rows.groupBy(*at).agg(F.count("*").alias("n")).filter(F.col("n") >= max(count // _SHARE, _MANY // 10))
    heavy = scratch.store(known.join(F.broadcast(met.drop("n")), at, "left_semi"), "above-heavy")
    light = rows.join(F.broadcast(heavy.select(*at)), at, "left_anti")
    return ahead(light.join(known, at)).unionByName(ahead(rows.join(F.broadcast(heavy), at)))


def nearest_above(ids: DataFrame, parents: DataFrame, targets: DataFrame) -> DataFrame:
    """(repository_id, id, container): the first target met on the way up from each id, itself included; null without.

    Every node points to its parent, a target to itself; pointers are doubled until each has met a target or the top, so
    rounds grow with the logarithm of the depth.  A node that has is not joined again: in the end all of a graph points to few.
    """
    scratch = Scratch(ids.sparkSession)
    hit = scratch.store(targets.select(REPO, "id").distinct().withColumn("is_target", F.lit(True)), "above-targets")
    # Nodes that have a parent are told apart already; few others are.
    held = parents.select(REPO, "id", "parent")
    tops = ids.select(REPO, "id").unionByName(held.select(REPO, F.col("parent").alias("id")).distinct()).join(held, _PAIR, "left_anti").distinct()
    jump = held.unionByName(tops.withColumn("parent", F.lit(None).cast("string"))).join(hit, _PAIR, "left")
    to = F.when(F.col("is_target"), F.col("id")).otherwise(F.col("parent"))
    jump = scratch.store(jump.select(REPO, "id", to.alias("to"), (F.col("is_target").isNotNull() | F.col("parent").isNull()).alias("done")), "above")
    settled, left = jump.filter("done"), jump.filter("not done")
    count = left.count()
    while count:
        after = scratch.store(_followed(left.drop("done"), settled.unionByName(left), count, scratch), "above")
        settled, left, was = settled.unionByName(after.filter("done")), after.filter("not done"), count
        count = left.count()
        # On every way that ends, some pointers reach the end in a round.
        if count == was:
            raise ValueError("parents form a cycle")
    return ids.select(REPO, "id").join(settled, _PAIR, "left").select(REPO, "id", F.col("to").alias("container"))


def dfs(start: DataFrame, edges: DataFrame, depth: int | None = None, direction: str = "outgoing") -> DataFrame:
    """(repository_id, start, id, depth, parent, place) in preorder.

    Preorder is sequential by nature: each repository's edges are one group, as is one repository's
    code; repositories run in parallel.  A node is marked when taken off the stack, and its depth is
    that of the path walked, so a depth limit can hide nodes that a shorter path would reach.
    """
    columns = [REPO, F.col("src").alias("a"), F.col("dst").alias("b"), "ord"]
    out = edges.select(*columns)
    back = edges.select(REPO, F.col("dst").alias("a"), F.col("src").alias("b"), "ord")
    links = {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction].groupBy(REPO, "a", "b").agg(F.min("ord").alias("ord"))

    def walk(key: tuple, roots: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        ahead: dict[str, list[str]] = {}
        for a, b in own.sort_values(["ord", "b"])[["a", "b"]].itertuples(index=False):
            ahead.setdefault(a, []).append(b)
        rows = []
        for root in sorted(roots["id"]):
            stack, visited = [(root, 0, None)], set()
            while stack:
                node, at, parent = stack.pop()
                if node in visited:
                    continue
                visited.add(node)
                rows.append((key[0], root, node, at, parent, len(visited) - 1))
                if depth is None or at < depth:
                    stack += [(x, at + 1, node) for x in reversed(ahead.get(node, [])) if x not in visited]
        return pd.DataFrame(rows, columns=[REPO, "start", "id", "depth", "parent", "place"])

    schema = "repository_id string, start string, id string, depth int, parent string, place int"
    return start.groupBy(REPO).cogroup(links.groupBy(REPO)).applyInPandas(walk, schema)


def _peel(links: DataFrame) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """Yields (level, sources, what is left of the links) until no link's start is free of incoming links."""
    level = 0
    while True:
        starts = links.select(REPO, "id").distinct()
        free = starts.join(links.select(REPO, F.col("next").alias("id")), _PAIR, "left_anti")
        free = stored(free, "peel")
        if free.isEmpty():
            return
        yield level, free, links
        links = stored(links.join(free, _PAIR, "left_anti"), "peel-links")
        level += 1


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repository_id, id, level, unresolved): nodes by the length of the longest way to them.

    Ordering by (level, id) respects every edge.  ``unresolved`` nodes lie on a cycle or downstream of
    one; their level is null.
    """
    known = nodes.select(REPO, "id")
    links = stored(_links(edges, "outgoing").join(known, _PAIR, "left_semi").join(known.withColumnRenamed("id", "next"), [REPO, "next"], "left_semi"), "topo")
    levels, left = known.select(REPO, "id", F.lit(0).alias("level")), links
    parts = [levels]
    for level, free, before in _peel(links):
        ahead = before.join(free, _PAIR).select(REPO, F.col("next").alias("id")).distinct()
        parts.append(ahead.withColumn("level", F.lit(level + 1)))
        left = before.join(free, _PAIR, "left_anti")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = every.groupBy(REPO, "id").agg(F.max("level").alias("level"))
    stuck = left.select(REPO, F.col("next").alias("id")).distinct().withColumn("stuck", F.lit(True))
    marked = best.join(stuck, _PAIR, "left")
    return marked.select(REPO, "id", F.when(F.col("stuck"), None).otherwise(F.col("level")).alias("level"), F.coalesce("stuck", F.lit(False)).alias("unresolved"))


def topological_order(nodes: DataFrame, edges: DataFrame, relations: Iterable[str] | None = None) -> DataFrame:
    """(repository_id, id, level, unresolved, place): the order in which Kahn's queue gives the nodes, from 0 without gaps.

    The queue starts with the nodes that nothing leads to, by ``ord``, and takes a node when the last one before it is
    taken.  So it goes level by level, and a level's nodes follow the place of their last predecessor, then the order of
    that one's edges: relations as given (else as the node meets them first), then ``ord``.  Each level is numbered over
    all partitions; ``place`` is null for ``unresolved`` nodes.
    """
    scratch = Scratch(nodes.sparkSession)
    named = None if relations is None else list(relations)
    edges = edges if named is None else edges.filter(F.col("relation").isin(named))
    levels = scratch.store(topological_levels(nodes, edges), "order-levels")
    if named is None:
        first = edges.groupBy(REPO, "src", "relation").agg(F.min("ord").alias("turn"))
        turned = edges.join(first, [REPO, "src", "relation"])
    else:
        turned = edges.withColumn("turn", F.array_position(F.array(*map(F.lit, named)), F.col("relation")))
    links = turned.groupBy(REPO, F.col("src").alias("id"), F.col("dst").alias("next")).agg(F.min(F.struct("turn", "ord")).alias("edge"))
    known = levels.filter("not unresolved")
    ahead = known.select(REPO, F.col("id").alias("next"), (F.col("level") - 1).alias("level"))
    links = scratch.store(links.join(known.select(REPO, "id", "level"), _PAIR).join(ahead, [REPO, "next", "level"]), "order-links")
    counts = known.groupBy(REPO, "level").agg(F.count("*").alias("n"))
    before = counts.select(REPO, "level", (F.sum("n").over(Window.partitionBy(REPO).orderBy("level")) - F.col("n")).alias("before"))
    last = known.agg(F.max("level")).first()[0]
    turn = known.filter("level = 0").join(nodes.select(REPO, "id", "ord"), _PAIR).select(REPO, "id", F.struct("ord", "id").alias("key"))
    parts = []
    for level in range((last if last is not None else -1) + 1):
        place = ranked(turn, [REPO], ["key"], "rank", scratch).select(REPO, "id", "rank", F.lit(level).alias("level"))
        parts.append(place)
        met = links.filter(F.col("level") == level).join(place.select(REPO, "id", "rank"), _PAIR)
        turn = met.groupBy(REPO, F.col("next").alias("id")).agg(F.max(F.struct("rank", "edge")).alias("key"))
    if not parts:
        return levels.withColumn("place", F.lit(None).cast("bigint"))
    every = reduce(DataFrame.unionByName, parts).join(before, [REPO, "level"]).select(REPO, "id", (F.col("rank") + F.col("before")).alias("place"))
    return levels.join(every, _PAIR, "left")


def _least_before(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(repository_id, id, value): the smallest id that reaches each end of the links (repository_id, id, next).

    A round takes a step along the links and then a jump: what reaches the id that is the value so far reaches this one
    too.  So rounds follow the logarithm of a path where ids fall along it, and never its length alone.
    """
    ends = links.select(REPO, "id").unionByName(links.select(REPO, F.col("next").alias("id"))).distinct()
    values = scratch.store(ends.withColumn("value", F.col("id")), "spread")
    mark = _mark(values)
    while True:
        sent = values.join(links, _PAIR).select(REPO, F.col("next").alias("id"), "value")
        step = values.unionByName(sent).groupBy(*_PAIR).agg(F.min("value").alias("value"))
        jump = values.select(REPO, F.col("id").alias("value"), F.col("value").alias("further"))
        after = scratch.store(step.join(jump, [REPO, "value"]).select(REPO, "id", F.least("value", "further").alias("value")), "spread")
        scratch.clear(values)
        values, was, mark = after, mark, _mark(after)
        if was == mark:
            return values


def _inner(links: DataFrame, scratch: Scratch) -> DataFrame:
    """The links among nodes that have both a way in and a way out, as nodes on a cycle do."""
    size = links.count()
    while True:
        both = links.select(REPO, "id").distinct().join(links.select(REPO, F.col("next").alias("id")), _PAIR, "left_semi")
        kept = scratch.store(links.join(both, _PAIR, "left_semi").join(both.withColumnRenamed("id", "next"), [REPO, "next"], "left_semi"), "scc-inner")
        scratch.clear(links)
        links, was, size = kept, size, kept.count()
        if was == size:
            return links


def _shortened(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, passed, loops): links past the nodes that have one way in and one way out.

    ``passed`` (repository_id, id, before, after) are the nodes of a chain with the nodes around it; they are in a
    component with these if these are in one.  ``loops`` (repository_id, id, component) are chains that close.  Chains
    are followed by doubling pointers, so rounds follow the logarithm of their length.
    """
    out = links.groupBy(*_PAIR).agg(F.count("*").alias("n_out"), F.min("next").alias("after"))
    into = links.groupBy(REPO, F.col("next").alias("id")).agg(F.count("*").alias("n_in"), F.min("id").alias("before"))
    chain = scratch.store(out.join(into, _PAIR).filter("n_out = 1 and n_in = 1").select(REPO, "id", "before", "after"), "scc-chain")
    if chain.isEmpty():
        none = links.select(REPO, "id", F.col("next").alias("before"), F.col("next").alias("after")).limit(0)
        return links, none, none.select(REPO, "id", F.col("id").alias("component"))
    ids = chain.select(REPO, "id")
    # Pointers both ways at once; ``low`` is the least id passed.  A pointer that has left the chain stays.
    ways = scratch.store(
        chain.select(REPO, "id", F.lit(1).alias("way"), F.col("after").alias("to"), F.col("id").alias("low")).unionByName(chain.select(REPO, "id", F.lit(0).alias("way"), F.col("before").alias("to"), F.col("id").alias("low"))), "scc-way"
    )
    n, length = chain.count(), 1
    while length <= 2 * n:
        ahead = ways.select(REPO, F.col("id").alias("to"), "way", F.col("to").alias("further"), F.col("low").alias("lower"))
        after = ways.join(ahead, [REPO, "to", "way"], "left").select(REPO, "id", "way", F.coalesce("further", "to").alias("to"), F.least("low", F.coalesce("lower", "low")).alias("low"))
        after = scratch.store(after, "scc-way")
        scratch.clear(ways)
        ways, length = after, 2 * length
        inside = ways.join(ids.withColumnRenamed("id", "to"), [REPO, "to"], "left_semi")
        # What still points into a chain is a loop if all chains with an end have been walked.
        if inside.isEmpty():
            break
    within = ids.withColumnRenamed("id", "to").withColumn("inside", F.lit(True))
    ends = ways.join(within, [REPO, "to"], "left").groupBy(*_PAIR).agg(
        F.max(F.when(F.col("way") == 1, F.col("to"))).alias("after"), F.max(F.when(F.col("way") == 0, F.col("to"))).alias("before"), F.min("low").alias("low"), F.bool_or(F.coalesce("inside", F.lit(False))).alias("loop"),
    )
    ends = scratch.store(ends, "scc-ends")
    loops = ends.filter("loop").select(REPO, "id", F.col("low").alias("component"))
    passed = ends.filter("not loop").select(REPO, "id", "before", "after")
    rest = links.join(ids, _PAIR, "left_anti").join(ids.withColumnRenamed("id", "next"), [REPO, "next"], "left_anti")
    return scratch.store(rest.unionByName(passed.select(REPO, F.col("before").alias("id"), F.col("after").alias("next"))).distinct(), "scc-short"), passed, loops


def _mark(table: DataFrame) -> tuple:
    """What tells a table of a round from the next one's: its size and the sum of its rows' hashes."""
    return tuple(table.agg(F.count("*"), F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)"))).first())


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repository_id, id, component): the smallest id reachable when directions are ignored.

    The links themselves are contracted: each round hangs a node's larger neighbours, then all of its
    neighbours, on the smallest of them, until every component is a star around its smallest id.  Rounds
    grow with the logarithm of a component's size, and nodes without links take no part in them.
    """
    scratch = Scratch(nodes.sparkSession)
    links = scratch.store(edges.filter("src <> dst").select(REPO, F.greatest("src", "dst").alias("id"), F.least("src", "dst").alias("low")).distinct(), "weak")
    mark = _mark(links)
    while True:
        both = links.unionByName(links.select(REPO, F.col("low").alias("id"), F.col("id").alias("low")))
        least = both.groupBy(*_PAIR).agg(F.least("id", F.min("low")).alias("top"))
        large = both.join(least, _PAIR).filter("low > id").select(REPO, F.col("low").alias("id"), F.col("top").alias("low")).distinct()
        least = large.groupBy(*_PAIR).agg(F.min("low").alias("top"))
        hung = large.join(least, _PAIR).select(REPO, F.col("low").alias("id"), F.col("top").alias("low")).unionByName(least.select(REPO, "id", F.col("top").alias("low")))
        after = scratch.store(hung.filter("id <> low").distinct(), "weak")
        scratch.clear(links)
        links, was, mark = after, mark, _mark(after)
        if was == mark:
            break
    return nodes.select(REPO, "id").join(links, _PAIR, "left").select(REPO, "id", F.coalesce("low", "id").alias("component"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repository_id, id, component): component is its smallest id.

    Nodes without a way in or out are peeled off, and chains are replaced by one link.  In what is left a component is
    where the smallest id that reaches a node is also the smallest that it reaches, within the nodes that share the
    former; the rest goes another round.  No round follows the length of a chain: see ``_shortened``, ``_least_before``.
    """
    scratch = Scratch(nodes.sparkSession)
    # Most links lead to nodes without a way out: these are left out before links are made distinct and written.
    between = edges.filter("src <> dst")
    onward = between.select(REPO, F.col("src").alias("dst")).distinct()
    left = scratch.store(_links(between.join(onward, [REPO, "dst"], "left_semi"), "outgoing"), "scc-links")
    found: list[DataFrame] = []
    chains: list[DataFrame] = []
    while True:
        left = _inner(left, scratch)
        if left.isEmpty():
            break
        left, passed, loops = _shortened(left, scratch)
        chains.append(passed)
        found.append(loops)
        # A chain whose ends are one node is a cycle through it: the node's own component, found below or alone here.
        left = scratch.store(left.filter("id <> next"), "scc-links")
        if left.isEmpty():
            break
        first = _least_before(left, scratch)
        a, b = first.withColumnRenamed("value", "a"), first.select(REPO, F.col("id").alias("next"), F.col("value").alias("b"))
        within = scratch.store(left.join(a, _PAIR).join(b, [REPO, "next"]).filter("a = b").select(REPO, F.col("next").alias("id"), F.col("id").alias("next")), "scc-back")
        reached = _least_before(within, scratch).withColumnRenamed("value", "least")
        part = scratch.store(first.join(reached, _PAIR, "left").filter("coalesce(least, id) = value").select(REPO, "id", F.col("value").alias("component")), "scc-part")
        found.append(part)
        gone = part.select(REPO, "id")
        left = scratch.store(left.join(gone, _PAIR, "left_anti").join(gone.withColumnRenamed("id", "next"), [REPO, "next"], "left_anti"), "scc-links")
    known = nodes.select(REPO, "id")
    if not found:
        return known.withColumn("component", F.col("id"))
    parts = scratch.store(reduce(DataFrame.unionByName, found), "scc-found")
    # The last chains first: their ends may be nodes of chains found before them, never of later ones.
    for passed in reversed(chains):
        ends = [parts.select(REPO, F.col("id").alias(end), F.col("component").alias(f"of_{end}")) for end in ("before", "after")]
        own = passed.join(ends[0], [REPO, "before"], "left").join(ends[1], [REPO, "after"], "left")
        of = [F.coalesce(F.col(f"of_{end}"), F.col(end)) for end in ("before", "after")]
        parts = parts.unionByName(own.filter(of[0] == of[1]).select(REPO, "id", of[0].alias("component")))
        # A node that only chains join to itself has no component of its own yet.
        alone = own.filter(of[0] == of[1]).filter(F.col("of_before").isNull()).select(REPO, F.col("before").alias("id"), of[0].alias("component")).distinct()
        parts = scratch.store(parts.unionByName(alone), "scc-found")
    # Names: the smallest id of each, chains included.
    names = parts.groupBy(REPO, "component").agg(F.min("id").alias("named"))
    named = parts.join(names, [REPO, "component"]).select(REPO, "id", "named")
    return known.join(named, _PAIR, "left").select(REPO, "id", F.coalesce("named", "id").alias("component"))


def cycles(nodes: DataFrame, edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(repository_id, component, members): strong components of several nodes, or of one with an edge to itself."""
    parts = strong_components(nodes, edges) if components is None else components
    grouped = parts.groupBy(REPO, "component").agg(F.sort_array(F.collect_list("id")).alias("members"))
    loops = edges.filter("src = dst").select(REPO, F.col("src").alias("component")).distinct().withColumn("loop", F.lit(True))
    return grouped.join(loops, [REPO, "component"], "left").filter("size(members) > 1 or loop").select(REPO, "component", "members")


def between_components(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(repository_id, src, dst, relation) of the edges between different components, which are their ends; not distinct."""
    a = parts.select(REPO, F.col("id").alias("src"), F.col("component").alias("src_component"))
    b = parts.select(REPO, F.col("id").alias("dst"), F.col("component").alias("dst_component"))
    between = edges.select(REPO, "src", "dst", "relation").join(a, [REPO, "src"]).join(b, [REPO, "dst"]).filter("src_component <> dst_component")
    return between.select(REPO, F.col("src_component").alias("src"), F.col("dst_component").alias("dst"), "relation")


def condensation(nodes: DataFrame, edges: DataFrame, components: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components with members, distinct edges between components, component of each node)."""
    parts = stored(strong_components(nodes, edges) if components is None else components, "condensed")
    members = parts.groupBy(REPO, "component").agg(F.sort_array(F.collect_list("id")).alias("members"))
    members = ranked(members, [REPO], ["component"]).withColumn("name", F.concat(F.lit("scc:"), "place")).drop("place", "place_total")
    collapsed = between_components(edges, parts).select(REPO, "src", "relation", "dst").distinct().withColumn("metadata_json", F.lit('{"collapsed":true}'))
    return members, collapsed, parts
