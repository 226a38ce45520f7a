r"""Conversation repair by alignment with the alternating grammar.

A whole conversation's role initials are ``(s?(ua)+)?``, so its length alone says what it is: an even length is
``uaua...``, an odd one of three or more ``suaua...``, and one is infeasible.  The turns are aligned with the grammar
string of each feasible length by Wagner and Fischer's table.  Edits, with their initials:

* Keep (0): the turn's initial is the string's
* Rerole to user or assistant (3)
* Delete (4), the only edit of a blank or repeated turn
* Insert an empty user or assistant turn (3), anywhere

A truncated turn that isn't deleted costs 3 more.  Tables run from the end, where strings of all lengths agree, so
one table of (turn, letters left) serves every length, with one more layer for the leading ``s``.  Ukkonen's band:
a greedy repair, or deleting all, costs C; a cell is computed only if the letters left can differ so far from the
turns left within C.  Among the lengths of least cost, each one's least audit (initials in ASCII order) is backtraced
from the front, and the least of them is taken.

A turn's first fault counts: blank (nothing but ``[\x20\x09-\x0D]``), duplicate (role and text occurred earlier in the
conversation), truncated (its last other character isn't one of ``.!?``).

Defined cases: nulls are one space, a null conv_id is a conversation of its own; turns are ordered by (turn, role,
text), a null turn first; a conversation whose rows are all dead (see ``repair``) gives zeros and an empty audit; an
empty table gives no rows; extra columns are ignored.  A conversation is one sequence and is repaired in one task; only
every so-many-th row of its table is held, so memory follows its texts and the band, not turns times band.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import isqrt
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_SPACE = " \t\n\x0b\x0c\r"
_FAR = 1 << 40
#: Rows of the table that are held at once, where a conversation has more turns.
HELD = 512

#: What a turn counts for: its role's initial, whether it must go, whether it is truncated.
Turn = tuple[str, bool, bool]


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text), or an empty string."""
    found, seen = [], set()
    for role, text in rows:
        body = text.rstrip(_SPACE)
        if not body:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def _greedy(turns: list[Turn]) -> int:
    """The cost of one repair: no insertion before the end."""
    cost, kept, want = 0, 0, "u"
    for initial, gone, cut in turns:
        if gone:
            cost += DELETE
            continue
        cost += TRUNCATED * cut
        kept += 1
        if kept == 1 and initial == "s":
            continue
        cost += 0 if initial == want else REROLE
        want = "a" if want == "u" else "u"
    only_system = kept == 1 and want == "u"
    return min(cost + INSERT * (want == "a") + 2 * INSERT * only_system, DELETE * len(turns))


class _Table:
    """Least costs of aligning turns i.. with the last k letters (``plain``), or with ``s`` and the last k (``led``)."""

    def __init__(self, turns: list[Turn]):
        self.turns, n = turns, len(turns)
        gone = np.array([t[1] for t in turns], bool)
        cut = np.array([t[2] for t in turns], bool) & ~gone

        def after(x: np.ndarray) -> np.ndarray:
            return np.concatenate([np.cumsum(x[::-1])[::-1], [0]])

        # What any repair pays: the deletions it can't avoid, and 3 at least for a truncated turn.
        spare = _greedy(turns) - DELETE * int(gone.sum()) - TRUNCATED * int(cut.sum())
        free, cheap = after(~gone), after(cut)
        # Deleting a truncated turn costs 1 beyond that, any other turn 4; inserting costs 3.
        fewer = np.where(spare <= cheap, spare, cheap + (spare - cheap) // DELETE)
        self.low = np.maximum(0, free - fewer - 1).tolist()
        self.high = (free + spare // INSERT).tolist()
        self.step = n if n <= HELD else max(HELD // 2, isqrt(n))
        k = np.arange(self.low[n], self.high[n] + 1, dtype=np.int64)
        self.marks = {n: (k * INSERT, np.full(len(k), _FAR))}
        self.block: tuple[int, list] = (-1, [])

    def _row(self, i: int, below: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        low, high, base, (initial, gone, cut) = self.low[i], self.high[i], self.low[i + 1], self.turns[i]
        plain, led = np.full(high - low + 1, _FAR), np.full(high - low + 1, _FAR)
        top = base + len(below[0]) - 1
        a, b = max(low, base), min(high, top)
        if a <= b:
            plain[a - low : b - low + 1] = below[0][a - base : b - base + 1] + DELETE
            led[a - low : b - low + 1] = below[1][a - base : b - base + 1] + DELETE
            if initial == "s" and not gone:
                np.minimum(led[a - low : b - low + 1], below[0][a - base : b - base + 1] + TRUNCATED * cut, out=led[a - low : b - low + 1])
        a, b = max(low, base + 1), min(high, top + 1)
        if not gone and a <= b:
            # The letter k places from the end: a where k is odd, u where it is even.
            for odd, letter in ((1, "a"), (0, "u")):
                at = a + ((a & 1) != odd)
                if at <= b:
                    cost = TRUNCATED * cut + (0 if initial == letter else REROLE)
                    part = plain[at - low : b - low + 1 : 2]
                    np.minimum(part, below[0][at - 1 - base : b - base : 2] + cost, out=part)
        ramp = np.arange(low, high + 1, dtype=np.int64) * INSERT
        return np.minimum.accumulate(plain - ramp) + ramp, led

    def rows(self, a: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows a..b of the block that starts at ``a``; ``marks`` holds row b."""
        if self.block[0] != a:
            b = min(a + self.step, len(self.turns))
            out = [self.marks[b]]
            for i in range(b - 1, a - 1, -1):
                out.append(self._row(i, out[-1]))
            self.block = (a, out[::-1])
            self.marks[a] = out[-1]
        return self.block[1]

    def starts(self) -> list[int]:
        return list(range(0, len(self.turns), self.step))


def align(turns: list[Turn]) -> tuple[int, str]:
    """The least cost, and the ASCII-least audit of that cost."""
    if not turns:
        return 0, ""
    table = _Table(turns)
    for a in reversed(table.starts()):
        table.rows(a)
    plain, led = table.marks[0]
    low = table.low[0]
    # Even lengths are all letters, odd ones (3 and more) s and an even number of letters.
    ends = [(int(x), low + j, lead) for lead, row in ((False, plain), (True, led)) for j, x in enumerate(row.tolist()) if (low + j) % 2 == 0 and (low + j or not lead)]
    cost = min(ends)[0]
    paths = [(k, lead, []) for x, k, lead in ends if x == cost]
    for a in table.starts():
        rows = table.rows(a)
        b = a + len(rows) - 1
        paths = [(*_trace(table, rows, a, b, k, lead, audit), audit) for k, lead, audit in paths]
    return cost, min("".join(audit) + "I" * k for k, _, audit in paths)


def _trace(table: _Table, rows: list, a: int, b: int, k: int, lead: bool, audit: list[str]) -> tuple[int, bool]:
    """Walks the least audit from (a, k) to row b, and appends it."""

    def cost(i: int, k: int, lead: bool) -> int:
        j, row = k - table.low[i], rows[i - a][lead]
        return int(row[j]) if 0 <= j < len(row) else _FAR

    i, now = a, cost(a, k, lead)
    while i < b:
        below = cost(i + 1, k, lead)
        if below + DELETE == now:
            audit.append("D")
            i, now = i + 1, below
        elif lead:
            audit.append("K")
            i, lead = i + 1, False
            now = cost(i, k, lead)
        elif k and cost(i, k - 1, False) + INSERT == now:
            audit.append("I")
            k, now = k - 1, now - INSERT
        else:
            audit.append("K" if table.turns[i][0] == ("a" if k % 2 else "u") else "R")
            i, k = i + 1, k - 1
            now = cost(i, k, False)
    return k, lead


def apply(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The (role, text) that an audit makes of the rows."""
    length = len(audit) - audit.count("D")
    out, i = [], 0
    for edit in audit:
        left = length - len(out)
        role = "assistant" if left % 2 else "user"
        if edit == "I":
            out.append((role, ""))
            continue
        if edit != "D":
            out.append((rows[i][0] if edit == "K" else role, rows[i][1]))
        i += 1
    return out


_OUT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired array<struct<role:string,text:string>>"


def _repaired(rows: list[tuple[int | None, str, str]]) -> tuple:
    said = [(role, text) for _, role, text in rows]
    found = faults(said)
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = align([(role[:1], f in ("blank", "duplicate"), f == "truncated") for (role, _), f in zip(said, found, strict=True)])
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, [{"role": r, "text": t} for r, t in apply(said, audit)]


def repair(conversations: DataFrame, live: Column | None = None) -> DataFrame:
    """One row a conversation: conv_id, gaps, the counts of faults, illegal, cost, audit, repaired (role and text in order).

    ``gaps`` are the whole numbers missing between the least and the greatest turn.  Where ``live`` isn't true, a row
    counts for nothing but that its conversation exists.
    """
    small_batches(conversations.sparkSession)
    alive = F.lit(True) if live is None else F.coalesce(live, F.lit(False))
    rows = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), alive.alias("alive")
    )
    schema = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list = []

        def entries() -> Iterator[tuple]:
            for batch in batches:
                kind[:] = [batch.schema.field("conv_id").type]
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "alive")), strict=True)

        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
        kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), [kind[0], *kinds], strict=True)], names=names)

        done, size = [], 0
        for conv_id, group in groupby(entries(), itemgetter(0)):
            own = [row[1:4] for row in group if row[4]]
            done.append((conv_id, *_repaired(own)))
            size += sum(len(text) for _, _, text in own) + 100
            if size > 1_000_000:
                yield out(done)
                done, size = [], 0
        if done:
            yield out(done)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(lean(run), f"conv_id {schema.simpleString()}, {_OUT}")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, stays: rows after damage by crc32(``conv_id:turn``) % 20, nulls being one space.

    0 drops the row (``stays`` is false), 1 empties its text, 2 takes ``[.!?]`` out, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(kind != 0, F.when(kind == 3, 2).otherwise(1))).alias("stays"),
    )


def digests(repaired: DataFrame) -> DataFrame:
    """The rows of ``repair`` with a digest in place of the turns."""
    text = F.concat_ws("\n", F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    return repaired.withColumn("repaired_sha256", F.sha2(text, 256)).drop("repaired")
