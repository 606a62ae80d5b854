"""Query op7: the conversations as an event log, folded, rendered, read back."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.chat import fold, parse, render
from quarry.llm.registry import register
from quarry.sources.tables import load_table

HARD = "\\### Assistant: </turn> ok"  # fixed value: the text of the extra conversation


def event_log(conversations: DataFrame, step: int = 200) -> DataFrame:
    """What a chat server would have logged: user and system messages as a
    draft and an edit; assistant messages as a first answer, a regeneration
    and the final text streamed in deltas of ``step`` code points."""
    text = F.coalesce("text", F.lit(""))
    base = conversations.select("conv_id", "turn", F.monotonically_increasing_id().alias("msg"), "role", text.alias("text"))
    starts = F.sequence(F.lit(0), F.floor(F.char_length("text") / step).cast("int"))
    delta = lambda i: F.struct((i + 2).alias("seq"), F.lit("delta").alias("kind"), F.substring(F.col("text"), i * step + 1, F.lit(step)).alias("text"))
    mark = lambda n, kind, t: F.struct(F.lit(n).alias("seq"), F.lit(kind).alias("kind"), t.alias("text"))
    drafted = F.array(mark(0, "delta", F.upper(F.substring("text", 1, 40))), mark(1, "edit", F.col("text")))
    streamed = F.concat(F.array(mark(0, "delta", F.lit("(first answer)")), mark(1, "regenerate", F.lit(""))), F.transform(starts, delta))
    log = F.when(F.col("role") == "assistant", streamed).otherwise(drafted)
    return base.select("conv_id", "turn", "msg", "role", F.explode(log).alias("e")).select("conv_id", "turn", "msg", "role", "e.*")


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(2 + length(role) + 2 + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) + 8)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@register("op7_chat", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    told = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = parse(render(fold(event_log(told))))
    turn = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turn, 256).alias("turns_sha256"),
                       F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))
