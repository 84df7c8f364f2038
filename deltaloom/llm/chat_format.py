"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context, and only
that reply is trainable. A turn is rendered as ``<s>role[INST]text</s>``. A control string inside a
role or a text gets one more backslash after its first character (``</s>`` is written ``<\\/s>``,
``<\\/s>`` is written ``<\\\\/s>``), so that no control string is left and taking one backslash away
restores the text.

Defined results: turns are ordered by ``turn``, ties by role and text, a null turn comes first. A
null role or text counts as empty; a null ``conv_id`` is a conversation like any other. Repeated rows
are repeated turns. Turns after the last reply, or a conversation without one, give a last example
without a target (``loss_start`` = ``loss_end``), so that no turn is lost. An empty table gives no
examples; other columns are ignored. A conversation is one record of the output and must fit a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
BEGIN, SPLIT, END = "<s>", "[INST]", "</s>"
CONTROL = r"(/?s>|/?INST\]|</?SYS>>)"
ESCAPE = (r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, *map(F.lit, ESCAPE))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, *map(F.lit, UNESCAPE))


def examples(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, text, loss_start, loss_end, trained): an example and its loss mask, in
    code points, the end exclusive; ``n_turns`` counts the turns in ``text``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    pieces = F.transform(
        "ts",
        lambda t: F.struct(
            F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(SPLIT)).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == trained_role).alias("trained"),
        ),
    )
    one = (
        conv.select("conv_id", pieces.alias("ps"))
        .select("conv_id", "ps", F.posexplode("ps").alias("i", "p"))
        .filter(F.col("p.trained") | (F.col("i") == F.size("ps") - 1))
    )
    before = F.transform(F.slice("ps", F.lit(1), F.col("i")), lambda p: F.concat(p["head"], p["body"], F.lit(END)))
    one = one.select("conv_id", (F.col("i") + 1).cast("long").alias("n_turns"), "p", F.concat_ws("", before).alias("context"))
    start = (F.length("context") + F.length("p.head")).cast("long")
    return one.select(
        "conv_id",
        "n_turns",
        F.concat("context", "p.head", "p.body", F.lit(END)).alias("text"),
        start.alias("loss_start"),
        (start + F.when(F.col("p.trained"), F.length("p.body")).otherwise(0)).alias("loss_end"),
        F.col("p.trained").alias("trained"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as ``array<struct<role, text>>``."""
    parts = F.split(text, END)
    both = lambda p: F.split(p, r"\[INST\]")  # noqa: E731  no other is left inside a turn
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.substring(both(p)[0], len(BEGIN) + 1, 2**30)).alias("role"),
            unescape(both(p)[1]).alias("text"),
        ),
    )


def read_loss(text: Column, start: Column, end: Column) -> Column:
    """The text under an example's loss mask, unescaped."""
    return unescape(text.substr((start + 1).cast("int"), (end - start).cast("int")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: the turns and what was trained on, in order.
    The examples are still dealt by ``conv_id``, so this adds no shuffle."""
    loss = read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end"))
    return (
        formatted.withColumn("loss", loss)
        .groupBy("conv_id")
        .agg(
            F.max_by("text", "n_turns").alias("text"),
            F.sort_array(F.collect_list(F.when(F.col("trained"), F.struct("n_turns", "loss")))).alias("losses"),
            F.sum(F.length("text")).alias("formatted_chars"),
        )
        .select(
            "conv_id",
            read_turns(F.col("text")).alias("turns"),
            F.concat_ws("", F.col("losses.loss")).alias("loss"),
            "formatted_chars",
        )
    )
