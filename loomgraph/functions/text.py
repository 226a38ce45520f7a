"""String measures used by search and by chunk rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters; the text itself if it is shorter, nothing if empty."""
    n = F.length(text)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(n >= 3, F.array_distinct(runs)).when(n > 0, F.array(text)).otherwise(F.expr("cast(array() as array<string>)"))


def trimmed(text: Column) -> Column:
    """Without blanks of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """Lower case, trimmed, with one space for every run of blanks."""
    return F.regexp_replace(trimmed(F.lower(text)), r"(?U)\s+", " ")


def fuzzy_score(value: Column, query: str | Column) -> Column:
    """How well ``query`` (lower case if it is a column) fits: 1000 equal, 800 or 600 less the length for a beginning or a part, else by gaps.

    The last tier walks the query's characters through the value greedily and adds 10 less the gap
    (9 at most) for each; a missing character makes the score 0.
    """
    v, q = F.lower(value), F.lit(query.lower()) if isinstance(query, str) else query
    length = utf16_length(v)
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("sum"), F.lit(True).alias("fits"))

    def step(s: Column, c: Column) -> Column:
        found = F.call_function("locate", c, v, s["at"] + 1)
        gap = found - 1 - s["at"]
        return F.struct(
            F.when(found > 0, found).otherwise(s["at"]).alias("at"),
            (s["sum"] + F.when(found > 0, 10 - F.least(gap, F.lit(9))).otherwise(0)).alias("sum"),
            (s["fits"] & (found > 0)).alias("fits"),
        )

    none = F.expr("cast(array() as array<string>)")
    letters = F.when(F.length(q) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(q), F.lit(1))), lambda i: F.substring(q, i, F.lit(1)))).otherwise(none)
    walked = F.aggregate(letters, state, step, lambda s: F.when(s["fits"], s["sum"]).otherwise(0))
    return (
        F.when(v == q, F.lit(1000))
        .when(v.startswith(q), 800 - length)
        .when(v.contains(q), 600 - length)
        .otherwise(walked)
        .cast("int")
    )


def visibility(modifiers: Column) -> Column:
    """The first of public, private, protected, internal among the modifiers; public by default."""
    found = F.lit("public")
    for word in ("internal", "protected", "private", "public"):
        found = F.when(F.array_contains(modifiers, word), F.lit(word)).otherwise(found)
    return F.coalesce(found, F.lit("public"))
