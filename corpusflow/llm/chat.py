"""Chat formatting with a reversible template, in DataFrame functions only.

A conversation becomes one string. Adjacent turns of one role are merged under one header:

    <|turn|>user\\nfirst text<|part|>second text<|end|>\\n<|turn|>assistant\\n...<|end|>\\n

Control strings inside texts and roles, of this template and of other common ones, are escaped by a
backslash after their first character; one that already has k backslashes there gets k + 1. So an
escaped text holds no control string, and taking one backslash away restores it exactly. A conversation
is one row, so the longest must fit a task; none is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, PART, END = "<|turn|>", "<|part|>", "<|end|>\n"
#: What follows the first character of a control string; none holds such a character
#: itself, so escapes never overlap.
CONTROL = r"\||/?s>|/?INST\]|/?SYS>>|bos>|eos>|pad>|unk>|start_of_turn>|end_of_turn>|begin_of_text|end_of_text"
ESCAPE = rf"([<\[])(\\*)(?={CONTROL})"
UNESCAPE = rf"([<\[])\\(\\*)(?={CONTROL})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def role_line(role: Column) -> Column:
    """A role as the first line of its header: a line feed is %0A, a percent sign %25."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def read_role(line: Column) -> Column:
    return F.replace(F.replace(unescape(line), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: conv_col, segments, formatted.

    segments is array<struct<text, loss>>; its texts joined are `formatted`, and loss marks what a
    model is to be trained on: the texts of the assistant, without headers, ends or part marks.
    Turns are ordered by number, null first, ties by role and text, so reruns agree; repeated rows
    are repeated turns. A null text or role counts as empty. Rows with a null conversation form one
    conversation. An empty table gives an empty result. Only the four named columns are read.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    sorted_turns = turns.groupBy(F.col(conv_col).alias("_conv")).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    # A turn opens a header unless the one before has its role; it is closed unless the next one has.
    at = lambda i: F.get("_turns", i)["role"]

    def segments(t: Column, i: Column) -> Column:
        body = F.struct(escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss"))
        mark = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
        head = F.when(at(i - 1).eqNullSafe(t["role"]), F.lit(PART)).otherwise(F.concat(F.lit(TURN), role_line(t["role"]), F.lit("\n")))
        tail = F.when(at(i + 1).eqNullSafe(t["role"]), F.lit("")).otherwise(F.lit(END))
        return F.array(mark(head), body, mark(tail))

    parts = F.flatten(F.transform("_turns", segments))
    return sorted_turns.select(F.col("_conv").alias(conv_col), F.filter(parts, lambda s: s["text"] != "").alias("segments")).withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>"), lambda b: b != "")

    def block(b: Column) -> Column:
        whole = F.regexp_replace(b, r"(?s)<\|end\|>\n\z", "")
        role = read_role(F.substring_index(whole, "\n", 1))
        body = F.substring(whole, F.length(F.substring_index(whole, "\n", 1)) + 2, F.length(whole))
        return F.transform(F.split(body, r"<\|part\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, block))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
