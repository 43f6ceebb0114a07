"""Chat formatting by prefix-target expansion: every assistant turn becomes one example whose context is all turns before it and whose
reply alone is trained on. Turns after the last reply form a last example without a target, so that the output holds
every turn.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts each ``<|`` is written with a backslash between,
and one more for each that stands there, so control strings in a text never look like the template and come back exactly. A role ends with its
line, so a line end inside a role is written ``<\\n``, with one more backslash before the letter for each that the role has there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """``<|`` to ``<\\|``, ``<\\|`` to ``<\\\\|`` and so on."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """:func:`escape`, and line ends in one line: ``\\n`` to ``<\\n``, ``<\\n`` to ``<\\\\n`` and so on."""
    return F.replace(F.regexp_replace(escape(role), r"<(\\+)n", r"<\\$1n"), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    """Inverse of :func:`escape_role`."""
    return unescape(F.regexp_replace(F.regexp_replace(role, r"<\\n", "\n"), r"<\\(\\+)n", "<$1n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, example, formatted, loss_start, loss_length`` from ``conv_id, turn, role, text``.

    ``example`` counts from 0 in turn order. ``formatted`` is the rendered context and reply; the loss mask covers
    ``loss_length`` characters from ``loss_start`` (0-based, in characters): the escaped reply, without the turn's markers. Both are null
    in a last example without a target. Null texts and roles are empty; turns go by number, then role, then text, nulls first, so repeated
    turns all stay; null conv_ids are one conversation. Empty tables give no rows.
    """
    said = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    rendered = turns.select("conv_id", F.struct(
        F.col("turn").alias("turn"), role.alias("role"), said.alias("text"),
        F.concat(head, escape(said), F.lit(END)).alias("shown"), F.length(head).alias("head"),
        F.length(escape(said)).alias("body")).alias("t"))
    whole = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    last = F.size("ts") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("ts", i)["role"] == "assistant") | (i == last))
    examples = whole.select("conv_id", "ts", F.posexplode(targets).alias("example", "at"))
    shown = F.array_join(F.transform(F.slice("ts", F.lit(1), F.col("at") + 1), lambda t: t["shown"]), "")
    final = F.get("ts", F.col("at"))
    trained = final["role"] == "assistant"
    return examples.select("conv_id", "example", shown.alias("formatted"), F.when(
        trained, F.length(shown) - F.length(F.lit(END)) - final["body"]).alias("loss_start"),
        F.when(trained, final["body"]).alias("loss_length"))


def read_back(examples: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns, replies, formatted_chars`` from the output of :func:`format_chats` alone: the turns of the
    last example, the trained texts in order, and the characters of all examples."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(1), F.length(piece) - F.length(F.lit(END)))
        cut = F.instr(body, "\n")
        return F.struct(unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"),
                        unescape(F.substring(body, cut + 1, F.length(body))).alias("text"))

    reply = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    per = examples.select("conv_id", "example", F.length("formatted").cast("long").alias("n"), reply.alias("reply"), "formatted")
    whole = per.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"), F.sum("n").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("rs"))
    return whole.select("conv_id", F.transform(pieces, turn).alias("turns"),
                        F.transform("rs", lambda r: r["reply"]).alias("replies"), "formatted_chars").select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), "turns", "replies", "formatted_chars")
