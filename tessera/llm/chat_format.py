"""Chat formatting with Spark expressions only (operator 9).

One conversation is the rows of one ``conv_id``, sorted by (turn, role, text). Adjacent turns of one role share a block:

    <|im_start|>ROLE<|im_body|>TEXT<|im_sep|>TEXT<|im_end|>\\n

Roles and texts are escaped: a backslash is doubled, and a backslash is put behind each ``<`` or ``[`` that could
begin a control string of this or of the other usual templates. So none of those strings occurs in escaped text, and
``unescape`` gives back the text as it was.

Defined cases: null text or role counts as empty; null turns come first; rows with a null ``conv_id`` are one
conversation with that id; repeated rows are turns of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BODY, SEP, END = "<|im_start|>", "<|im_body|>", "<|im_sep|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), r"([<\[])(?=[|/sI<])", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chat(conversations: DataFrame, targets: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, segments): ``segments`` are consecutive pieces of ``formatted``; ``loss`` marks the
    pieces, one for each text of a role in ``targets``, that a completion-only loss covers."""
    rows = conversations.select(
        "conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    other = lambda i, step: F.get("turns", i + F.lit(step))["role"]

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block(t: Column, i: Column) -> Column:
        opens = (i == 0) | (other(i, -1) != t["role"])
        closes = F.coalesce(other(i, 1) != t["role"], F.lit(True))
        head = F.when(opens, F.concat(F.lit(START), escape(t["role"]), F.lit(BODY))).otherwise(F.lit(SEP))
        return F.array(
            piece(head, F.lit(False)),
            piece(escape(t["text"]), t["role"].isin(*targets)),
            piece(F.when(closes, F.lit(END)).otherwise(F.lit("")), F.lit(False)),
        )

    segments = turns.select("conv_id", F.filter(F.flatten(F.transform("turns", block)), lambda s: s["loss"] | (s["text"] != "")).alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns, as array<struct<role, text>>, read back from a formatted string."""
    quoted = lambda s: "\\Q" + s + "\\E"
    blocks = F.filter(F.split(formatted, quoted(END), -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        parts = F.split(F.substr(b, F.lit(len(START) + 1)), quoted(BODY), 2)
        role = unescape(parts[0])
        return F.transform(F.split(parts[1], quoted(SEP), -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))
