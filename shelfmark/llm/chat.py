"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, then the reply, which alone is under
the loss mask. A conversation whose last turn is not the assistant's gets one more example with an empty mask, so the
examples hold every turn. The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Puts one more backslash into each ``<`` backslashes ``|``, so that no control string is left; undone by ``unescape``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    """As ``escape``, and a line break, which ends the role in the template, becomes ``\\n`` (backslashes are doubled)."""
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("<"), F.lit("\\l"))


def unescape_role(role: Column) -> Column:
    """What ``escape_role`` was given: the first two backslashes that meet are one pair, so the cuts at pairs fall where it made them."""
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<"))), "\\")


def prefix_target_examples(turns: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text to examples: conv_id, example (from 0), is_last, formatted, loss_start, loss_end.

    The mask is [loss_start, loss_end) in code points of ``formatted``. Turns go by turn, then role, then text; null
    turns come first. Null roles and texts count as empty, repeated rows as further turns, a null conv_id as one
    conversation. Other columns are left out. No row gives no example.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    n = F.size("turns")
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(head(t), escape(t["text"]), F.lit(END)).alias("whole"),
        F.length(head(t)).alias("head_chars"), F.length(escape(t["text"])).alias("text_chars"), (t["role"] == "assistant").alias("target")))
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (F.get("pieces", i)["target"]))
    one = conv.withColumn("pieces", pieces).select("conv_id", "pieces", n.alias("n"), F.posexplode(at).alias("example", "i"))
    upto = F.slice("pieces", 1, F.col("i") + 1)
    target = F.get("pieces", F.col("i"))
    formatted = F.array_join(F.transform(upto, lambda p: p["whole"]), "")
    end = F.length("formatted") - F.lit(len(END))
    return one.select("conv_id", "example", (F.col("i") == F.col("n") - 1).alias("is_last"), formatted.alias("formatted"), target.alias("t")).select(
        "conv_id", "example", "is_last", "formatted",
        F.when(F.col("t.target"), end - F.col("t.text_chars")).otherwise(F.length("formatted")).cast("long").alias("loss_start"),
        F.when(F.col("t.target"), end).otherwise(F.length("formatted")).cast("long").alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example: an array of role and text as they were before formatting."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(head) + 2, F.length(p) - F.length(head) - 1 - len(END))
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def conversation_digest(examples: DataFrame) -> DataFrame:
    """One row a conversation, read back from its examples alone."""
    turns = F.when(F.col("is_last"), read_turns(F.col("formatted")))
    loss = unescape(F.expr("substr(formatted, CAST(loss_start AS INT) + 1, CAST(loss_end - loss_start AS INT))"))
    per = examples.select(
        "conv_id", "example", F.length("formatted").alias("chars"), loss.alias("loss"), turns.alias("turns")).withColumn(
        "digest", F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256))
    out = per.groupBy("conv_id").agg(
        F.max(F.size("turns")).cast("long").alias("n_turns"), F.max("digest").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
