"""The Merkle manifest against one built level by level in plain Python."""

import hashlib
import zlib

import numpy as np
import pytest

from loomgraph.llm import merkle

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, node string, claim string, tree string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """All levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def expected(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {lang: sorted(trees[lang], key=lambda r: r[:3]) for lang in names}
    inner = {lang: climb([r[2] for r in own[lang]]) for lang in names}
    top = climb([inner[lang][-1][0] for lang in names])
    out = []
    for at, lang in enumerate(names):
        for i, (_, _, digest, row) in enumerate(own[lang]):
            claim = digest
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                claim = leaf((*row[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])))
            proof, folded = "", claim
            for levels, place in ((inner[lang], i), (top, at)):
                for level in levels[:-1]:
                    run = level[place // 8 * 8 : place // 8 * 8 + 8]
                    others = run[: place % 8] + run[place % 8 + 1 :]
                    proof += "".join(others)
                    folded = sha("".join(others[: place % 8] + [folded] + others[place % 8 :]))
                    place //= 8
            root = top[-1][0]
            out.append((row[0], digest, inner[lang][-1][0], root, sha(proof), len(proof) // 64, folded, folded == root))
    return sorted(out, key=repr)


def rows_of(n):
    langs = ["en", "de", None, "", "é", "z"]
    rows = [(i * 7 % n, f"s{i % 3}" if i % 5 else None, langs[min(i % 11, 5)], i if i % 4 else None, f"Text {i} " + "É" * (i % 9)) for i in range(n)]
    rows += [rows[3], rows[3], (None, None, None, None, None), (None, "s", "en", 1, ""), (5, "s", "en", 1, "A" * 200_000), (1, "s", "lone", 1, "Only")]
    return rows


@pytest.mark.parametrize(("height", "n"), [(1, 300), (2, 300), (4, 300), (1, 1), (1, 9)])
def test_proofs_equal_plain_trees(spark, height, n):
    rows = rows_of(max(n, 4)) if n > 9 else [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS).repartition(3)
    manifest = merkle.build(frame, merkle.tampered(frame), height)
    found = merkle.proofs(manifest, with_paths=True)
    got = found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "n_siblings", "folded_root", "verified", "path").collect()
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == expected(rows)
    for r in got:
        steps = merkle.unpacked(bytes(r["path"]))
        assert merkle.packed(steps) == bytes(r["path"]) and merkle.fold(bytes.fromhex(r["leaf"]), steps).hex() == r["root"]
        assert sha("".join(others.hex() for _, others in steps)) == r["proof_sha256"]


def test_without_claims_everything_verifies(spark):
    frame = spark.createDataFrame([(str(i), "s", "en", 1, "T", "", "", "") for i in range(20)], DOCS.replace("doc_id bigint", "doc_id string"))
    found = merkle.proofs(merkle.build(frame, height=1))
    assert found.filter("verified").count() == 20 and found.schema["doc_id"].dataType.simpleString() == "string"
    assert merkle.proofs(merkle.build(frame.limit(0))).count() == 0


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_places_are_van_emde_boas(levels):
    def laid(levels, depth, at):
        """Addresses of nodes in the order the recursive split lists them."""
        if levels == 1:
            return [(depth, at)]
        upper = levels // 2
        out = laid(upper, depth, at)
        for i in range(8**upper):
            out += laid(levels - upper, depth + upper, at * 8**upper + i)
        return out

    order = laid(levels, 0, 0)
    assert len(order) == merkle.size_of(levels)
    for depth in range(levels):
        want = {at: i for i, (d, at) in enumerate(order) if d == depth}
        assert merkle.place(levels, depth, np.arange(8**depth)).tolist() == [want[i] for i in range(8**depth)]
