"""Vectorised words, word hashes and shingles for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Inverse of the odd base modulo 2**64.
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of text that are hashed together; what hashing holds besides the words follows this, not the text.
_BLOCK = 1 << 18


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x)]), dtype=np.uint64) for x in (_BASE, _INVERSE))


_TABLES = _tables(_BLOCK)


def _word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word, by differences of prefix sums, block by block; a word may be longer than a block."""
    out = np.empty(len(start), dtype=np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + _BLOCK, side="right")))
        at, n = int(start[a]), int(end[b - 1] - start[a])
        powers, inverses = _TABLES if n <= _BLOCK else _tables(n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((low[at : at + n].astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
            first, last = start[a:b] - at, end[a:b] - at
            out[a:b] = mix((sums[last] - sums[first]) * inverses[first] + (last - first).astype(np.uint64))
        a = b
    return out


class Words:
    """The words of some texts: hashes in order, and where each lies in the joined bytes."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0]
        self.text_start = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        self.low = _LOWER[self.raw]
        is_word = _IS_WORD[self.low]
        # A word begins where a word byte follows a text's border or another byte; it ends likewise.
        border = np.zeros(len(is_word) + 1, dtype=bool)
        border[self.text_start] = True
        before = np.concatenate([[False], is_word[:-1]]) if len(is_word) else is_word
        after = np.concatenate([is_word[1:], [False]]) if len(is_word) else is_word
        self.start = np.flatnonzero(is_word & (~before | border[:-1]))
        self.end = np.flatnonzero(is_word & (~after | border[1:])) + 1
        self.hash = _word_hashes(self.low, self.start, self.end)
        #: Word k of text i is number first[i] + k.
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def word(self, k: int) -> str:
        return self.low[self.start[k] : self.end[k]].tobytes().decode("utf-8", "replace")

    def shingles(self, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Text number and hash of each run of k words; a text of fewer words, but not none, is one run."""
        h, n = self.hash, len(self.hash)
        owner = self.text_of_word()
        with np.errstate(over="ignore"):
            acc = np.zeros(max(0, n - k + 1), dtype=np.uint64)
            for j in range(k):
                acc = mix(acc * _BASE + h[j : n - k + 1 + j]) if n >= k else acc
            whole = owner[: n - k + 1] == owner[k - 1 :] if n >= k else np.zeros(0, bool)
            out_owner, out_hash = owner[: max(0, n - k + 1)][whole], acc[whole]
            short = np.flatnonzero((self.count > 0) & (self.count < k))
            if len(short):
                extra = np.empty(len(short), dtype=np.uint64)
                for at, i in enumerate(short):
                    x = np.zeros(1, dtype=np.uint64)
                    for y in h[self.first[i] : self.first[i + 1]]:
                        x = mix(x * _BASE + y)
                    extra[at] = mix(x + np.uint64(int(self.count[i])))[0]
                out_owner, out_hash = np.concatenate([out_owner, short]), np.concatenate([out_hash, extra])
                order = np.argsort(out_owner, kind="stable")
                out_owner, out_hash = out_owner[order], out_hash[order]
        return out_owner, out_hash


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that one holds about ``limit`` bytes of text; a longer text is one piece by itself."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        if not len(sizes):
            continue
        group = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(group, prepend=group[0])).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
