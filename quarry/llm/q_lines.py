"""Query op1."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.lines import MIN_CHARS, line_report
from quarry.llm.registry import register
from quarry.sources.tables import load_table

# lines within one edit: equal before or behind the middle of the shorter one
OP1_SQL = rf"""
WITH raw AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, i - 1 AS line_no, line FROM (
    SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, trim(unnest(ls), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM raw)
  WHERE line <> ''),
d AS (SELECT line, arg_min({{'doc_id': doc_id, 'line_no': line_no}}, {{'doc_id': doc_id, 'line_no': line_no}}) AS ord, length(line) AS n FROM l GROUP BY line),
k AS (
  SELECT DISTINCT line, ord, n, side, h, part FROM (
    SELECT line, ord, n, unnest([n // 2, (n - 1) // 2]) AS h FROM d WHERE n >= {MIN_CHARS}), 
    LATERAL (SELECT unnest(['l', 'r']) AS side), LATERAL (SELECT CASE side WHEN 'l' THEN left(line, h) ELSE right(line, h) END AS part)),
cand AS (
  SELECT DISTINCT a.line AS x, a.ord AS xo, b.line AS y, b.ord AS yo
  FROM k a JOIN k b ON a.side = b.side AND a.part = b.part AND a.h = b.h AND a.h = least(a.n, b.n) // 2
  WHERE a.ord < b.ord AND abs(a.n - b.n) <= 1),
near AS (
  SELECT y AS line, min(xo) AS keep FROM cand
  WHERE EXISTS (SELECT 1 FROM (SELECT unnest(range(0, least(length(x), length(y)) + 1)) AS p)
    WHERE left(x, p) = left(y, p) AND (CASE
      WHEN length(x) = length(y) THEN substr(x, p + 2) = substr(y, p + 2)
      WHEN length(x) > length(y) THEN substr(x, p + 2) = substr(y, p + 1)
      ELSE substr(x, p + 1) = substr(y, p + 2) END))
  GROUP BY y),
v AS (
  SELECT l.doc_id, l.line_no, l.line, near.keep IS NOT NULL AS is_near,
    coalesce(near.keep, d.ord) AS keep, near.keep IS NOT NULL OR d.ord <> {{'doc_id': l.doc_id, 'line_no': l.line_no}} AS gone
  FROM l JOIN d ON l.line = d.line LEFT JOIN near ON near.line = l.line),
r AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone AND NOT is_near) AS n_copies, count(*) FILTER (gone AND is_near) AS n_near,
    coalesce(string_agg(line_no || ':' || keep.doc_id || ':' || keep.line_no, ',' ORDER BY line_no) FILTER (gone), '') AS dropped,
    list(line_no) FILTER (gone) AS nos
  FROM v GROUP BY doc_id)
SELECT raw.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_copies, 0)::BIGINT AS n_copies, coalesce(n_near, 0)::BIGINT AS n_near,
  coalesce(dropped, '') AS dropped,
  CASE WHEN nos IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(nos, i - 1)), lambda i: ls[i]), chr(10)) END AS text
FROM raw LEFT JOIN r ON r.doc_id = raw.doc_id
"""


@register("op1_line_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    name = F.transform(F.coalesce("drops", F.array()), lambda d: F.concat_ws(":", d["line_no"], d["keep_doc_id"], d["keep_line_no"]))
    return line_report(docs).select("doc_id", "n_lines", "n_copies", "n_near", F.array_join(name, ",").alias("dropped"), "text")
