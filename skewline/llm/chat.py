r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and only that reply trainable. What
follows a conversation's last reply, or a conversation without any, becomes one more row with nothing trainable, so that
no turn is lost.

Template: a prompt turn is `<s>[INST]role\ntext[/INST]</s>`, a reply is `<s>role\ntext</s>`. Control strings inside texts
and roles are escaped by one backslash behind their first character (`</s>` becomes `<\/s>`, and `<\/s>` becomes
`<\\/s>`); `unescape` takes one away, so the escape is reversible and unescaped control strings are the template's own.
A line break or backslash in a role is written `\n` or `\\` first.

Defined results: a null text or role is empty; turns are in order of (turn, role, text), nulls first, so ties and repeated
rows are kept, side by side; rows with a null conversation id form one conversation; an empty table gives an empty table;
other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLY_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2"), r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<\\(\\*)(/?s>)", "<$1$2"), r"\[\\(\\*)(/?INST\])", "[$1$2")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # A pair of backslashes is set aside as a line break, which an escaped role never holds.
    parts = F.split(F.replace(unescape(role), F.lit("\\\\"), F.lit("\n")), "\n", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def _format_turn(turn: Column) -> Column:
    head = F.concat(_escape_role(turn["role"]), F.lit("\n"))
    return F.when(turn["role"] == REPLY_ROLE, F.concat(F.lit("<s>"), head, escape(turn["text"]), F.lit("</s>"))).otherwise(F.concat(F.lit("<s>[INST]"), head, escape(turn["text"]), F.lit("[/INST]</s>")))


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """(conv_id, target int, is_last boolean, formatted string, loss_start long, loss_chars long).

    `target` is the place of the trained turn among the conversation's turns, or the number of turns where nothing is
    trained. The loss mask is the code points [loss_start, loss_start + loss_chars) of `formatted`, the escaped reply.
    One shuffle by conversation; an example is built from its conversation's row alone.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn"), empty("role").alias("role"), empty("text").alias("text")))).alias("turns"))
    n = F.size("turns")
    replies = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("turns", i)["role"] == REPLY_ROLE)
    tail = F.when(F.get("turns", n - 1)["role"] == REPLY_ROLE, F.expr("cast(array() as array<int>)")).otherwise(F.array(n))
    rows = grouped.select("conv_id", F.col("turns"), F.transform("turns", _format_turn).alias("parts"), F.concat(replies, tail).alias("targets"))
    rows = rows.select("conv_id", "turns", "parts", F.element_at("targets", -1).alias("last"), F.explode("targets").alias("target"))
    trained = F.col("target") < F.size("turns")
    reply = F.get("turns", F.col("target"))
    before = F.array_join(F.slice("parts", 1, F.col("target")), "")
    rows = rows.select(
        "conv_id",
        "target",
        (F.col("target") == F.col("last")).alias("is_last"),
        F.concat(before, F.when(trained, F.get("parts", F.col("target"))).otherwise("")).alias("formatted"),
        F.when(trained, F.char_length(before) + F.lit(len("<s>")) + F.char_length(_escape_role(reply["role"])) + 1).otherwise(F.lit(0)).cast("long").alias("loss_start"),
        F.when(trained, F.char_length(escape(reply["text"]))).otherwise(F.lit(0)).cast("long").alias("loss_chars"),
    )
    return rows


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    pieces = F.filter(F.split(formatted, "</s>", -1), lambda p: p != "")
    inner = F.transform(pieces, lambda p: F.regexp_replace(F.regexp_replace(F.substring(p, 4, 1 << 30), r"\A\[INST\]", ""), r"\[/INST\]\z", ""))
    cut = lambda p: F.instr(p, "\n")
    return F.transform(inner, lambda p: F.struct(_unescape_role(p.substr(F.lit(1), cut(p) - 1)).alias("role"), unescape(p.substr(cut(p) + 1, F.lit(1 << 30))).alias("text")))


def read_loss(formatted: Column, loss_start: Column, loss_chars: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(formatted.substr((loss_start + 1).cast("int"), loss_chars.cast("int")))


def digests(examples: DataFrame) -> DataFrame:
    """What the formatted examples say when read back, one row a conversation."""
    loss = read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))
    read = examples.select(
        "conv_id",
        F.struct("target", loss.alias("text")).alias("loss"),
        F.char_length(loss).cast("long").alias("n_loss"),
        F.char_length("formatted").cast("long").alias("n_formatted"),
        F.when(F.col("is_last"), read_turns(F.col("formatted"))).alias("turns"),
    )
    text = lambda parts: F.sha2(F.array_join(parts, "").cast("binary"), 256)
    out = read.groupBy("conv_id").agg(F.max("turns").alias("turns"), F.array_sort(F.collect_list("loss")).alias("losses"), F.sum("n_loss").alias("loss_chars"), F.sum("n_formatted").alias("formatted_chars"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        text(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("turns_sha256"),
        "loss_chars",
        text(F.transform("losses", lambda x: x["text"])).alias("loss_sha256"),
        "formatted_chars",
    )
