"""Verbatim passage containment as an equi-join (used as retrieval ground
truth, SURVEY 5.4).

A passage occurring verbatim in a document may start or end inside a word
of that document, but its inner tokens (2nd to 6th) appear there as
consecutive tokens.  So: hash those inner tokens as the passage's anchor,
hash every 5-token window of every document, equi-join on the hash (the
passage side is small and AQE broadcasts it after measuring it; the corpus
is never shuffled for this), and verify each candidate with an exact
``instr``.  Hash collisions only add candidates that the check removes.

Passages with fewer than 3 tokens have no inner token; they are matched by
hashing every character window of their own length in the documents (one
pass per distinct short length), again an equi-join plus the exact check.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.functions.text import tokens
from quarry.session import spread

ANCHOR = 5


def verbatim_matches(passages: DataFrame, docs: DataFrame, *, p_id: str = "item_id", p_text: str = "text",
                     d_id: str = "doc_id", d_text: str = "text") -> DataFrame:
    """All (p_id, d_id) with ``p_text`` contained in ``d_text`` (case- and
    byte-exact, like ``contains``)."""
    p = passages.select(F.col(p_id).alias("_pid"), F.col(p_text).alias("_ptext"), tokens(p_text).alias("_pt"))
    p = p.where(F.col("_ptext").isNotNull() & (F.length("_ptext") > 0))
    n = F.size("_pt")
    width = F.least(F.lit(ANCHOR), n - 2)
    long_p = p.where(n >= 3).select("_pid", "_ptext", width.alias("_w"),
                                    F.xxhash64(F.slice("_pt", 2, width)).alias("_h"))
    d = spread(docs.select(F.col(d_id).alias("_did"), F.col(d_text).alias("_dtext")))
    dt = d.select("_did", tokens("_dtext").alias("_dt"))
    widths = [r[0] for r in long_p.select("_w").distinct().collect()]  # at most ANCHOR values
    cands = None
    for w in widths:
        starts = F.when(F.size("_dt") >= w, F.sequence(F.lit(1), F.size("_dt") - w + 1)) \
            .otherwise(F.array().cast("array<int>"))
        grams = dt.select("_did", F.explode(F.transform(
            starts, lambda i: F.xxhash64(F.slice("_dt", i, w)))).alias("_h"))
        c = grams.join(long_p.where(F.col("_w") == w).select("_h", "_pid"), "_h").select("_pid", "_did")
        cands = c if cands is None else cands.unionByName(c)
    short_p = p.where(n < 3).select("_pid", "_ptext", F.length("_ptext").alias("_len"))
    for (ln,) in short_p.select("_len").distinct().collect():
        starts = F.when(F.length("_dtext") >= ln, F.sequence(F.lit(1), F.length("_dtext") - ln + 1)) \
            .otherwise(F.array().cast("array<int>"))
        windows = d.select("_did", F.explode(F.transform(
            starts, lambda i: F.xxhash64(F.substring("_dtext", i, ln)))).alias("_h"))
        sp = short_p.where(F.col("_len") == ln).select("_pid", F.xxhash64("_ptext").alias("_h"))
        c = windows.join(sp, "_h").select("_pid", "_did")
        cands = c if cands is None else cands.unionByName(c)
    if cands is None:
        return passages.sparkSession.createDataFrame([], f"{p_id} {passages.schema[p_id].dataType.simpleString()}, "
                                                         f"{d_id} {docs.schema[d_id].dataType.simpleString()}")
    cands = cands.distinct()
    checked = (cands.join(p.select("_pid", "_ptext"), "_pid").join(d, "_did")
               .where(F.instr("_dtext", F.col("_ptext")) > 0))
    return checked.select(F.col("_pid").alias(p_id), F.col("_did").alias(d_id))
