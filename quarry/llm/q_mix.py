"""Queries op4 and op10."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.mixing import BLOCK_DOCS, PERIOD, schedule
from quarry.llm.packing import pack
from quarry.llm.registry import register
from quarry.sources.tables import load_table


@register("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load_table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH RECURSIVE r AS (SELECT source, count(*) AS n, floor(sqrt(count(*)))::BIGINT AS r FROM documents GROUP BY source),
w AS (SELECT source, n, greatest(1, ({PERIOD} * r) // (SELECT sum(r) FROM r)::BIGINT) AS a,
  row_number() OVER (ORDER BY source NULLS LAST) AS i FROM r),
tot AS (SELECT sum(a)::BIGINT AS q, list(a::BIGINT ORDER BY i) AS a FROM w),
edf AS (
  SELECT 0::BIGINT AS t, list_transform(a, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick, 0::BIGINT AS j FROM tot
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + (i = best)::BIGINT), best, done[best]
  FROM (SELECT t, done, (list_min(list_filter(list_transform(range(1, len(a) + 1), lambda i:
      CASE WHEN done[i] < a[i] AND (done[i] * q) // a[i] <= t
           THEN (((done[i] + 1) * q + a[i] - 1) // a[i]) * 100000 + i END), lambda x: x IS NOT NULL)) % 100000)::BIGINT AS best
    FROM edf, tot WHERE t < q)),
slots AS (SELECT pick AS i, j, t - 1 AS slot FROM edf WHERE t > 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS k FROM documents),
stop AS (SELECT min(((n + {BLOCK_DOCS - 1}) // {BLOCK_DOCS}) // w.a * q + s.slot) AS stop
  FROM w JOIN slots s ON s.i = w.i AND ((n + {BLOCK_DOCS - 1}) // {BLOCK_DOCS}) % w.a = s.j, tot)
SELECT d.doc_id, d.source, k // {BLOCK_DOCS} AS block, (k // {BLOCK_DOCS}) * q // w.a AS release,
  ((k // {BLOCK_DOCS} + 1) * q + w.a - 1) // w.a AS deadline, (k // {BLOCK_DOCS}) // w.a * q + s.slot AS slot,
  k % {BLOCK_DOCS} AS place, (k // {BLOCK_DOCS}) // w.a * q + s.slot < stop.stop AS mixed
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN slots s ON s.i = w.i AND s.j = (k // {BLOCK_DOCS}) % w.a, tot, stop
"""


@register("op10_mixing", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return schedule(docs).select("doc_id", "source", "block", "release", "deadline", "slot", "place", "mixed")
