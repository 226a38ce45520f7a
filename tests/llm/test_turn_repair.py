"""Conversation repair against a search over all edits."""

import functools
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import turn_repair

ROWS = "conv_id bigint, turn bigint, role string, text string, alive string, audit string"


def least(turns):
    """The least (cost, audit) by trying every edit at every turn."""
    n = len(turns)

    @functools.lru_cache(None)
    def go(i, made, run):
        """``made``: nothing yet, a lone s, up to an a, or up to a u; ``run``: insertions in a row."""
        found = [(0, "")] if i == n and made in ("", "a") else []

        def then(cost, edit, rest):
            if rest:
                found.append((cost + rest[0], edit + rest[1]))

        letter = "a" if made == "u" else "u"
        if run < 3:
            then(3, "I", go(i, letter, run + 1))
        if i < n:
            initial, gone, cut = turns[i]
            then(4, "D", go(i + 1, made, 0))
            if not gone:
                if made == "" and initial == "s":
                    then(3 * cut, "K", go(i + 1, "s", 0))
                then(3 * cut + 3 * (initial != letter), "K" if initial == letter else "R", go(i + 1, letter, 0))
        return min(found, default=None)

    return go(0, "", 0)


@pytest.mark.parametrize("held", [2, 512])
def test_least_audit_equals_search(monkeypatch, held):
    monkeypatch.setattr(turn_repair, "HELD", held)
    draw = random.Random(held)
    for _ in range(1500):
        turns = [(draw.choice("suauaxU"), draw.random() < 0.2, draw.random() < 0.25) for _ in range(draw.randrange(12))]
        assert turn_repair.align(turns) == least(tuple(turns))


def test_long_conversations_stay_in_their_band():
    draw = random.Random(3)
    turns = [("ua"[i % 2] if draw.random() < 0.99 else "s", draw.random() < 0.005, False) for i in range(20_000)]
    cost, audit = turn_repair.align(turns)
    kept = turn_repair.apply([({"u": "user", "a": "assistant", "s": "system"}[t[0]], "x.") for t in turns], audit)
    assert len(audit) - audit.count("I") == len(turns) and "".join(r[0] for r, _ in kept) in ("ua" * (len(kept) // 2), "s" + "ua" * (len(kept) // 2))
    assert cost == 4 * audit.count("D") + 3 * audit.count("I") + 3 * audit.count("R")


def expected(rows):
    """What the query gives for (turn, role, text) of one conversation, nulls being one space."""
    own = sorted(((t is not None, t, r or " ", " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0], r[1] or 0, *r[2:]))
    seen, turns, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    for _, _, role, text in own:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        count[fault] += 1
        turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    numbers = {t for known, t, _, _ in own if known}
    cost, audit = least(tuple(turns))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    out, i, size = [], 0, len(audit) - audit.count("D")
    for edit in audit:
        role = "user" if (size - len(out)) % 2 == 0 else "assistant"
        if edit in "KR":
            out.append((own[i][2] if edit == "K" else role) + ":" + own[i][3])
        elif edit == "I":
            out.append(role + ":")
        i += edit != "I"
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


ODD = {
    1: [(0, "system", "Be brief."), (1, "user", "Hi!"), (2, "assistant", "Yes?")],
    2: [(5, "assistant", "No."), (None, "user", "first."), (9, None, "who?"), (9, None, "who?")],
    3: [(None, None, None), (None, "user", "")],
    4: [(0, "user", " "), (0, "user", "b!\x0c"), (0, "user", "a\n.")],
    5: [(0, "system", "s."), (1, "system", "t.")],
    6: [(i, "user" if i % 2 else "assistant", f"long {i} " + "x" * 20_000 + ".") for i in range(9)],
    None: [(0, "user", "q?"), (0, "user", "q?")],
}


def test_repair_of_odd_conversations(spark):
    rows = [(c, *r, "x", "y") for c, own in ODD.items() for r in own]
    frame = spark.createDataFrame(rows, ROWS)
    for parts in (1, 4):
        got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.digests(turn_repair.repair(frame.repartition(parts))).collect()}
        assert got == {c: expected(own) for c, own in ODD.items()}
    kept = {r["conv_id"]: r["repaired"] for r in turn_repair.repair(frame).collect()}
    assert [(t["role"], t["text"]) for t in kept[1]] == [r[1:] for r in ODD[1]]
    assert turn_repair.repair(frame.limit(0)).count() == 0
    dead = turn_repair.digests(turn_repair.repair(frame, F.col("conv_id") == 1))
    assert {tuple(r)[1:] for r in dead.filter("conv_id is null or conv_id > 1").collect()} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two?!") for c in range(20) for t in range(20)] + [(None, None, None, None)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else text.translate({46: None, 33: None, 63: None}) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text, kind != 0)] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in turn_repair.damage(frame).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {r[4] for r in got} == {True, False}
