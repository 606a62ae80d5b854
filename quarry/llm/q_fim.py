"""Query op12."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.fim import fill_in_middle, restored
from quarry.llm.registry import register
from quarry.sources.tables import load_table

OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM d),
p AS (SELECT *, substr(t, 1, lo) AS a, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m
    WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@register("op12_fim", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(load_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
