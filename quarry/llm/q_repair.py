"""Query op13: damaged conversations and their repair."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.common import with_uid
from quarry.llm.registry import register
from quarry.llm.repair import report
from quarry.sources.tables import load_table


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, q_uid, copy: rows dropped, emptied, cut,
    repeated or renamed by a checksum of their place."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    base = with_uid(convs.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")), "q_uid")
    how = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    told = base.withColumn("how", how).where("how <> 0")
    changed = (F.when(F.col("how") == 1, F.lit("")).when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return told.select("conv_id", "turn", F.when(F.col("how") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       changed.alias("text"), "q_uid", F.explode(copies).alias("copy"))


_WHITE = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))


def _least(*options: str) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x.c < 100000000))" if len(options) > 1 else options[0]


def _then(state: str, cost: str, letter: str, line: str) -> str:
    """``state`` (a struct of cost, audit, lines) behind one more edit."""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {line}}}"


def _dp_sql() -> str:
    """Forward costs and audits of the four states, row by row: a CTE that
    keeps whole audits instead of crossing states."""
    none = "{'c': 100000000, 'a': '', 'r': ''}"
    nl = "chr(10)"
    user, helper = f"{nl} || 'user:'", f"{nl} || 'assistant:'"
    grow = lambda s: (f"{s}0", f"{s}1", _least(f"{s}2", _then(f"{s}0", "5", "I", user), _then(f"{s}1", "5", "I", user), _then(f"{s}3", "5", "I", user)),
                      _least(f"{s}3", _then(f"{s}2", "5", "I", helper)))
    safe = lambda x: f"coalesce({x}, {none})"
    own, as_user, as_helper = f"{nl} || role || ':' || text", f"{user} || text", f"{helper} || text"
    keep = lambda s, i: _then(s, f"if(cls = 2 OR init <> '{i}', 100000000, if(cls = 1, 5, 0))", "K", own)
    name = lambda s, line: _then(s, "if(cls = 2, 100000000, if(cls = 1, 6, 1))", "R", line)
    gone = lambda s: _then(s, "2", "D", "''")
    new = (gone("v0"), _least(gone("v1"), keep("v0", "s")),
           _least(gone("v2"), *[keep(f"v{q}", "u") for q in (0, 1, 3)], *[name(f"v{q}", as_user) for q in (0, 1, 3)]),
           _least(gone("v3"), keep("v2", "a"), name("v2", as_helper)))
    cols = lambda xs, p: ", ".join(f"{safe(x)} AS {p}{i}" for i, x in enumerate(xs))
    return f"""
dp AS (
  SELECT conv, 0::BIGINT AS i, {{'c': 0, 'a': '', 'r': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM (SELECT DISTINCT conv FROM r)
  UNION ALL
  SELECT conv, i, {cols(new, 's')} FROM (
    SELECT conv, i, init, cls, role, text, {cols(grow('w'), 'v')} FROM (
      SELECT r.conv, r.i, r.init, r.cls, r.role, r.text, {cols(grow('s'), 'w')} FROM dp JOIN r ON r.conv = dp.conv AND r.i = dp.i + 1))),
ends AS (
  SELECT conv, {_least('v0', 'v3')} AS best FROM (
    SELECT conv, {cols(grow('w'), 'v')} FROM (
      SELECT conv, {cols(grow('s'), 'w')} FROM dp JOIN (SELECT conv, max(i) AS i FROM r GROUP BY conv) USING (conv, i))))"""


# crc32 by bytes, its table from the polynomial
OP13_SQL = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(n::BIGINT, [0::BIGINT for k in range(8)]),
    lambda c, k: if(c & 1 = 1, xor(3988292384, c >> 1), c >> 1)) ORDER BY n) AS t FROM range(256) x(n)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(k, '')]),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS how FROM keyed, crc_table),
bad AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE how <> 0),
o AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, 'null') AS conv, turn, role, text, rtrim(text, {_WHITE}) AS shown,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM bad),
f AS (
  SELECT *, substr(role, 1, 1) AS init,
    CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) AS prev FROM o),
r AS (SELECT conv, i, init, role, text, CASE fault WHEN 'none' THEN 0 WHEN 'truncated' THEN 1 ELSE 2 END AS cls FROM f),
{_dp_sql()},
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (prev IS NOT NULL AND prev || init NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(substr(coalesce(best.r, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts ON counts.conv = coalesce(c.conv_id::VARCHAR, 'null') LEFT JOIN ends ON ends.conv = coalesce(c.conv_id::VARCHAR, 'null')
"""


@register("op13_repair", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return report(damaged(convs), convs)
