r"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, URL schemes and identifier cues.  Deterministic
local parsers then expand each anchor to the left and right and validate what they find.  Stretches of
digits and what may stand between them anchor the numeric kinds, whose parsers read a stretch once, from
left to right.  Kinds, in the order in which equal starts are listed:

* ``email``: at-sign anchors, ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``
* ``ip``: four dotted numbers of at most 255
* ``card``: 12 to 19 digits, single blanks or hyphens between, passing Luhn's check
* ``phone``: a plus sign and 9 to 15 digits with blanks, dots, brackets and hyphens
* ``url``: an address after ``http://``, ``https://``, ``ftp://`` or ``www.``, without closing punctuation
* ``mailto``: the address after ``mailto:``
* ``account``: what follows a cue, up to its own end: after ``iban`` groups of letters and digits whose
  checksum (mod 97) holds, after ``ssn`` nine digits whose parts may occur, else a token of 4 characters or
  more with a digit
* ``secret``: a token of 16 characters or more with letters and digits after a cue such as ``token`` or ``password``
* ``handle``: ``@name`` where no letter or digit comes before and no address is

The first four follow their base patterns exactly (leftmost, not overlapping per kind, failing
matches dropped); the others are added by the method and may overlap them.  Offsets are code points,
ends exclusive.

Defined cases: null is empty; texts of any length are read whole, in time that grows with their length (a run of
token characters is read once, however many cues it holds); an at-sign without a valid
domain, or a cue without an identifier after it, gives nothing; repeated rows each get their spans;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches
from .words import pieces

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "mailto", "account", "secret", "handle")
_RANK = {kind: i for i, kind in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A maximal run of what the numeric kinds are made of.
_STRETCH = re.compile(r"[0-9+][\x20().0-9+-]*")
#: From the first digit of a number only, and never giving a digit back: each number is read four times at most.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_URL_TAIL = re.compile(r"[^\s<>\"'`|\\^{}\[\]]+")
_GAP = re.compile(r"(?:\s{0,4}(?:is|no\.?|number|id|key|#|:|=))*\s{0,4}[\"'`]?", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
_SECRET = re.compile(r"[A-Za-z0-9+/_=.~-]+")
_GROUPS = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[\x20-]?[A-Za-z0-9])*")
_SSN = re.compile(r"([0-9]{3})([\x20-]?)([0-9]{2})\2([0-9]{4})(?![0-9A-Za-z])")
_HANDLE = re.compile(r"[A-Za-z0-9_]{2,}")

SCHEMES = ("http://", "https://", "ftp://", "www.")
CUES = ("account number", "account no", "account:", "acct", "user id", "userid", "user:", "username", "login:", "passport", "customer id", "member id")
SECRETS = ("token", "secret", "api key", "api_key", "apikey", "password", "passwd", "bearer")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor, kind in [("@", "at"), ("mailto:", "mailto"), *((s, "url") for s in SCHEMES), ("iban", "iban"), ("ssn", "ssn"), *((c, "account") for c in CUES), *((c, "secret") for c in SECRETS)]:
        found.add_word(anchor, (kind, len(anchor)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _lower_ascii(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def _numbers(text: str) -> list[tuple[str, int, int]]:
    spans = []
    for stretch in _STRETCH.finditer(text):
        at, end = stretch.span()
        if end - at < 7:  # the shortest is 1.1.1.1
            continue
        part = stretch.group()
        if "." in part:
            for m in _IP.finditer(part):
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m.group().split("."))):
                    spans.append(("ip", at + m.start(), at + m.end()))
        for m in _CARD.finditer(part):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGITS.sub("", m.group())
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    spans.append(("card", at + m.start(), at + m.end()))
        if "+" in part:
            for m in _PHONE.finditer(part):
                if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
                    spans.append(("phone", at + m.start(), at + m.end()))
    return spans


def _iban(text: str, at: int) -> int:
    """The end of the longest account number at ``at`` that is whole groups and passes mod 97; 0 for none."""
    m = _GROUPS.match(text, at)
    if not m:
        return 0
    found, value, size = 0, "", 0
    head = ""
    for i in range(at, min(m.end(), at + 80)):
        c = text[i].upper()
        if not c.isalnum():
            continue
        size += 1
        if size > 34:
            break
        digits = c if c.isdigit() else str(ord(c) - 55)
        if size <= 4:
            head += digits
        else:
            value += digits
        whole = i + 1 == m.end() or text[i + 1] in " -"
        if size >= 15 and whole and int(value + head) % 97 == 1:
            found = i + 1
    return found


class _Runs:
    """Runs of token characters in one text, each read once: cues follow each other inside long runs."""

    def __init__(self, text: str):
        self.text = text
        #: Of each pattern the last run met: start, end, end without closing marks, last digit and last letter before that.
        self.met: dict[re.Pattern, tuple[int, int, int, int, int]] = {}

    def _read(self, pattern: re.Pattern, at: int) -> tuple[int, int, int, int, int]:
        m = pattern.match(self.text, at)
        run = m.group() if m else ""
        token = run.rstrip("._-")
        digit, letter = (next((i for i in range(len(token) - 1, -1, -1) if is_one(token[i])), -1) for is_one in (str.isdigit, str.isalpha))
        return at, at + len(run), at + len(token), at + digit if digit >= 0 else -1, at + letter if letter >= 0 else -1

    def token(self, pattern: re.Pattern, at: int) -> tuple[int, bool, bool]:
        """The end of the token at ``at`` (``at`` for none), and whether it has a digit and a letter."""
        run = self.met.get(pattern)
        if run is None or not run[0] <= at < run[1]:
            run = self.met[pattern] = self._read(pattern, at)
        if at >= run[2] or not pattern.match(self.text, at, at + 1):
            return at, False, False
        return run[2], run[3] >= at, run[4] >= at


def _identifier(kind: str, text: str, cue_end: int, runs: _Runs) -> tuple[str, int, int] | None:
    """What a cue announces, expanded to its boundary and validated."""
    at = _GAP.match(text, cue_end).end()
    if kind == "iban":
        end = _iban(text, at)
        return ("account", at, end) if end else None
    if kind == "ssn":
        m = _SSN.match(text, at)
        fits = m and m[1] not in ("000", "666") and m[1][0] != "9" and m[3] != "00" and m[4] != "0000"
        return ("account", at, m.end()) if fits else None
    end, digit, letter = runs.token(_SECRET if kind == "secret" else _TOKEN, at)
    fits = end - at >= 16 and letter if kind == "secret" else end - at >= 4
    return (kind, at, end) if digit and fits else None


def spans_of(text: str, automaton: ahocorasick.Automaton, digits: bool = True) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text, ordered by start, kind and end."""
    spans = _numbers(text) if digits else []
    last, runs = {"email": 0, "url": 0, "cue": 0}, _Runs(text)
    for end, (kind, length) in automaton.iter(_lower_ascii(text)):
        start, end = end + 1 - length, end + 1
        if kind == "at":
            left = start
            while left > last["email"] and text[left - 1] in _LOCAL:
                left -= 1
            domain = _DOMAIN.match(text, end) if left < start else None
            if domain:
                spans.append(("email", left, domain.end()))
                last["email"] = domain.end()
            elif (start == 0 or not text[start - 1].isalnum()) and (m := _HANDLE.match(text, end)):
                spans.append(("handle", start, m.end()))
        elif kind == "mailto":
            at = end
            while at < len(text) and text[at] in _LOCAL:
                at += 1
            if at > end and text[at : at + 1] == "@" and (domain := _DOMAIN.match(text, at + 1)):
                spans.append(("mailto", start, domain.end()))
        elif kind == "url":
            if start >= last["url"] and (start == 0 or not text[start - 1].isalnum()) and (m := _URL_TAIL.match(text, end)):
                stop = m.end()
                while stop > end and text[stop - 1] in ".,;:!?)":
                    stop -= 1
                if stop > end:
                    spans.append(("url", start, stop))
                    last["url"] = stop
        elif start >= last["cue"] and (start == 0 or not text[start - 1].isalnum()) and (span := _identifier(kind, text, end, runs)):
            spans.append(span)
            last["cue"] = span[2]
    return sorted(spans, key=lambda s: (s[1], _RANK[s[0]], s[2]))


_FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, base string, spans string"


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in pieces(batches, "text"):
        column = batch.column("text")
        # A text without digits can't hold the numeric kinds; one scan of the batch tells.
        has_digit = pc.match_substring_regex(column, "[0-9]").to_pylist()
        rows = []
        for text, digits in zip(column, has_digit, strict=True):
            spans = spans_of(text.as_py(), automaton, digits)
            base = [s for s in spans if s[0] in BASE]
            n = [sum(s[0] == kind for s in base) for kind in BASE]
            rows.append((*n, len(spans) - len(base), _joined(base), _joined(spans)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        names = ["n_email", "n_ip", "n_card", "n_phone", "n_added", "base", "spans"]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *names])


def find_pii(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, n_added, base and spans (``kind:start:end``, comma-joined)."""
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lean(_find), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_FOUND}")


def mask(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans go as one."""
    out, at = [], 0
    for part in filter(None, spans.split(",")):
        kind, a, b = part.split(":")
        if int(a) >= at:
            out += [text[at : int(a)], f"<{kind}>"]
        at = max(at, int(b))
    return "".join([*out, text[at:]])


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


__all__ = ["BASE", "KINDS", "digests", "find_pii", "mask", "spans_of"]
