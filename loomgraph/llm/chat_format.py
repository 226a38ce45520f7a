r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the formatted text holds all preceding turns
as context and that reply last, and only the reply lies under the loss mask, given as the code
points ``[loss_start, loss_end)`` of the formatted text.  A conversation that does not end with an
assistant turn yields one more example without a target (an empty mask), so no turn is lost.

Template: a user turn is ``[INST] text [/INST]``, any other turn ``<s>[ROLE]role[/ROLE]text</s>``.
Inside roles and texts a backslash is doubled, and a backslash goes after the first character of
whatever would read as one of the six control strings; ``unescape`` takes both back.

Defined cases: null role or text is empty; turns are ordered by (turn, role, text), a null turn
first, and repeated rows are repeated turns; a null conv_id is a conversation of its own; an empty
table gives no examples; extra columns are ignored.  An example is one row by definition, so a
conversation must fit in a task; the expansion itself is row by row (only turn numbers are exploded).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER_OPEN, USER_CLOSE = "[INST] ", " [/INST]"
ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"
_CONTROL_AHEAD = r"(?:(?<=<)(?=/?s>)|(?<=\[)(?=/?(?:INST|ROLE)\]))"
_TURN = r"(?s)\[INST\] (.*?) \[/INST\]|<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL_AHEAD, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _formatted(turn: Column) -> Column:
    return F.when(turn["role"] == "user", F.concat(F.lit(USER_OPEN), turn["text"], F.lit(USER_CLOSE))).otherwise(
        F.concat(F.lit(ROLE_OPEN), turn["role"], F.lit(ROLE_CLOSE), turn["text"], F.lit(TURN_CLOSE))
    )


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, target (number of the reply, null without one), n_context, formatted, loss_start, loss_end."""
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("plain_role"),
            F.coalesce(F.col("text"), F.lit("")).alias("plain_text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    whole = whole.select(
        "conv_id",
        F.transform("ts", lambda t: F.struct(escape(t["plain_role"]).alias("role"), escape(t["plain_text"]).alias("text"), (t["plain_role"] == "assistant").alias("reply"))).alias("turns"),
    )
    n = F.size("turns")
    last = F.element_at("turns", -1)
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["reply"])
    # -n stands for "all turns, no target".
    ends = F.when(last["reply"], replies).otherwise(F.concat(replies, F.array(-n)))
    rows = whole.select("conv_id", "turns", F.explode(ends).alias("end"))
    upto = F.abs("end")
    text = F.array_join(F.transform(F.slice("turns", 1, upto), _formatted), "")
    rows = rows.select("conv_id", "end", text.alias("formatted"), F.element_at("turns", upto)["text"].alias("reply"))
    stop = F.length("formatted") - len(TURN_CLOSE)
    return rows.select(
        "conv_id",
        F.when(F.col("end") > 0, F.col("end") - 1).alias("target"),
        F.when(F.col("end") > 0, F.col("end") - 1).otherwise(-F.col("end")).alias("n_context"),
        "formatted",
        F.when(F.col("end") > 0, stop - F.length("reply")).otherwise(0).alias("loss_start"),
        F.when(F.col("end") > 0, stop).otherwise(0).alias("loss_end"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, unescaped."""
    found = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))
    return F.transform(
        found,
        lambda x: F.when(
            x.startswith(USER_OPEN),
            F.struct(F.lit("user").alias("role"), unescape(F.substring(x, F.lit(len(USER_OPEN) + 1), F.length(x) - len(USER_OPEN + USER_CLOSE))).alias("text")),
        ).otherwise(
            F.struct(
                unescape(F.regexp_extract(x, _TURN, 2)).alias("role"),
                unescape(F.regexp_extract(x, _TURN, 3)).alias("text"),
            )
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, trained text, and formatted characters."""
    mask = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    longest = F.struct(F.length("formatted").alias("n"), F.col("formatted"))
    whole = examples.groupBy("conv_id").agg(
        F.max(longest)["formatted"].alias("formatted"),
        F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", mask.alias("text")))).alias("masks"),
        F.sum(F.length("formatted")).cast("bigint").alias("formatted_chars"),
        F.count("*").cast("bigint").alias("n_examples"),
    )
    turns = read_back(F.col("formatted"))
    whole = whole.select(
        "conv_id", turns.alias("turns"), F.array_join(F.transform(F.sort_array("masks"), lambda m: m["text"]), "").alias("trained"), "formatted_chars", "n_examples"
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
