"""Chat formatting by event-sourced reconstruction.

A log holds events of messages: ``delta`` appends text, ``edit`` replaces what
the message said so far, ``regenerate`` clears it.  The log is partitioned by
conversation and message; the last edit or regeneration of a message is its
reset, and the deltas after it, by sequence, are folded onto it.  The final
messages of a conversation, by message number, are rendered into one string.

Template of a turn: ``<#role>`` newline text ``</turn>`` newline.  In roles
and texts ``\\`` ``<`` ``#`` become ``\\b`` ``\\l`` ``\\h`` (in roles also ``>``
``\\g``), so the marks ``<#`` and ``</turn>`` never occur inside a text, whatever
it says, and the rendered string can be parsed back exactly.  The loss mask is
the list of (start, length) of assistant texts in code points of the rendered
string.

Only DataFrame and SQL functions are used.

Scale.  Deltas are folded by message first; what meets in one row is one
conversation, which is the unit of output.

Defined cases: null texts are empty; null roles are empty; a message without
events after its reset keeps the reset's text; equal sequence numbers go by
kind and text; messages are told apart by ``msg``, so repeated rows are turns
of their own, and turns with the same number go by role, then text; a
conversation with no message gives no row; an empty table gives an empty
result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN_END = "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\b"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text from (conv_id, turn, msg, role, seq, kind,
    text); ``msg`` identifies a message."""
    key = ["conv_id", "turn", "msg", "role"]
    text = F.coalesce("text", F.lit(""))
    ev = events.select("conv_id", "turn", "msg", F.coalesce("role", F.lit("")).alias("role"), "seq", "kind",
                       F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(text).alias("text"))
    reset = F.max(F.when(F.col("kind") != "delta", F.col("seq"))).over(Window.partitionBy(*key))
    live = ev.withColumn("reset", reset).where("reset is null or seq >= reset")
    parts = F.array_sort(F.collect_list(F.struct("seq", F.when(F.col("kind") == "delta", 1).otherwise(0).alias("k"), "text")))
    return live.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")).drop("msg")


def render(messages: DataFrame, target: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss (array of start, length; 0-based code points)
    from (conv_id, turn, role, text)."""
    head = F.concat(F.lit("<#"), F.replace(escape(F.coalesce("role", F.lit(""))), F.lit(">"), F.lit("\\g")), F.lit(">\n"))
    body = escape(F.coalesce("text", F.lit("")))
    turn = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), body.alias("body"))
    rows = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body", "head"))).alias("t"))
    end = len(TURN_END)
    sized = F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.char_length(x["head"]).alias("h"), F.char_length(x["body"]).alias("b")))
    walked = F.aggregate(
        sized, F.expr("named_struct('at', 0, 'loss', cast(array() as array<struct<start:int,length:int>>))"),
        lambda s, x: F.struct((s["at"] + x["h"] + x["b"] + end).alias("at"),
                              F.when(x["role"] == target, F.concat(s["loss"], F.array(F.struct((s["at"] + x["h"]).alias("start"), x["b"].alias("length")))))
                              .otherwise(s["loss"]).alias("loss")),
        lambda s: s["loss"])
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(TURN_END))), "").alias("formatted"),
                       walked.alias("loss"))


def parse(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of role, text), loss_text read back
    from the rendered strings alone (and the loss mask)."""
    pieces = F.filter(F.split("formatted", TURN_END, -1), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(
        unescape(F.replace(F.substring_index(F.substring(p, F.lit(3), F.char_length(p)), ">\n", 1), F.lit("\\g"), F.lit(">"))).alias("role"),
        unescape(F.substring(p, F.call_function("instr", p, F.lit(">\n")) + 2, F.char_length(p))).alias("text")))
    loss = F.array_join(F.transform("loss", lambda m: unescape(F.substring("formatted", m["start"] + 1, m["length"]))), "")
    return rendered.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))
