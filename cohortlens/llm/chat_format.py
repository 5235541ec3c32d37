"""Chat formatting with prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and
the turn's text as the one trainable stretch. Turns after a conversation's last assistant
turn, or a conversation without one, make a last example with no trainable text, so that every
turn can be read back.

Template of a turn: ``<|turn|>role<|text|>text<|end|>``. Escaping puts a backslash before
each backslash and inside each control string (after its first character), so no control
string of this template, or of the other common ones listed, survives inside a text;
``unescape`` undoes it exactly.

Order is by turn, then role, then text; null roles and texts count as empty, a null turn
comes first. Rows with a null conv_id form one conversation. Repeated rows are turns of their own.
Extra columns are ignored. An example holds its whole context, so one conversation is
formatted where its turns are gathered; examples are exploded one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings that must not survive in texts.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_INSIDE = r"<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _INSIDE, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escape(role), F.lit(TEXT), escape(text), F.lit(END))


def examples(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """turns: conv_id, turn, role, text. One row for each example: conv_id, target (index of its last turn, from 0), trainable (boolean), formatted, loss_start and loss_end (code points of the trainable stretch in formatted, end exclusive; equal if none)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    row = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    conv = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    conv = conv.select("conv_id", F.transform("t", lambda x: F.struct((x["role"] == trained_role).alias("trained"), turn_text(x["role"], x["text"]).alias("f"), (F.length(escape(x["role"])) + len(TURN) + len(TEXT)).alias("head"))).alias("t"))
    last = F.size("t") - 1
    index = F.filter(F.sequence(F.lit(0), last), lambda i: F.get(F.col("t"), i)["trained"] | (i == last))
    each = conv.select("conv_id", "t", F.explode(index).alias("target"))
    own = F.get(F.col("t"), F.col("target"))
    formatted = F.array_join(F.transform(F.slice("t", 1, F.col("target") + 1), lambda x: x["f"]), "")
    each = each.select("conv_id", "target", own["trained"].alias("trainable"), formatted.alias("formatted"), (F.length(own["f"])).alias("n"), own["head"].alias("head"))
    start = F.length("formatted") - F.col("n") + F.col("head")
    end = F.length("formatted") - len(END)
    return each.select("conv_id", "target", "trainable", "formatted", F.when(F.col("trainable"), start).otherwise(F.lit(0)).alias("loss_start"), F.when(F.col("trainable"), end).otherwise(F.lit(0)).alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted example."""
    parts = F.split(formatted, r"<\|end\|>", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def one(p: Column) -> Column:
        sides = F.split(p, r"<\|text\|>", 2)
        return F.struct(unescape(F.substring(sides[0], F.lit(len(TURN) + 1), F.length(sides[0]))).alias("role"), unescape(sides[1]).alias("text"))

    return F.transform(parts, one)


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(formatted, start + 1, end - start))


def digests(made: DataFrame) -> DataFrame:
    """What can be read back from examples, a row for each conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (all examples), n_examples."""
    got = made.groupBy("conv_id").agg(
        F.max_by("formatted", "target").alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("trainable"), F.struct("target", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text"))))).alias("loss"),
        F.sum(F.length("formatted")).cast("bigint").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    got = got.select("conv_id", read_turns(F.col("whole")).alias("turns"), F.array_join(F.transform("loss", lambda x: x["text"]), "").alias("loss"), "formatted_chars", "n_examples")
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return got.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
