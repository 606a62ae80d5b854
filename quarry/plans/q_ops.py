"""Driver queries for the answer cache (H1-H8, U2), metrics (M1-M9) and
formatting (F2, F3).

The ``events`` table plays the service's request log: ``value`` is the
latency in ms, ``props.k`` the number of documents retrieved,
``event_type = 'error'`` a failed request, and ``from_cache`` is what a TTL
cache keyed by user would have served (the H8 replay).
"""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.fmt import format_ms, format_seconds
from quarry.functions.keys import cache_key_kwargs, cache_key_md5, cache_key_prefixed
from quarry.operators.cache import answer_with_cache, clear_marker, entries, ttl_replay
from quarry.operators.cache_log import append_entries, read_log
from quarry.operators.metrics import (
    bench_stats, cost, counters, docs_histogram, latency_blend, latency_histogram, slow_queries, stage_split_long,
)
from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources.tables import load_table

R = 6


# --------------------------------------------------------------------------- #
# request log
# --------------------------------------------------------------------------- #

def request_log(spark, sf_dir):
    """The log without ``from_cache``: a projection of the events table."""
    return load_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", F.col("value").alias("total_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("n_docs"), (F.col("event_type") == "error").alias("failed"))


def events_query_log(spark, sf_dir):
    """The log with ``from_cache``: the replay carries what the metrics read."""
    rp = ttl_replay(request_log(spark, sf_dir), "user_id", "ts", "event_id", 3600,
                    carry=("event_type", "total_ms", "failed"))
    return rp.select("event_id", "user_id", "event_type", "total_ms", "failed",
                     F.when(F.col("failed"), F.lit(None)).otherwise(F.col("hit")).alias("from_cache"))


_REPLAY_SQL = """
ev AS (SELECT event_id, user_id, epoch_us(ts) AS us,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
rp AS (SELECT user_id, rn, event_id, us AS last_set, false AS hit FROM ev WHERE rn = 1
       UNION ALL
       SELECT ev.user_id, ev.rn, ev.event_id,
              CASE WHEN ev.us < rp.last_set + 3600000000 THEN rp.last_set ELSE ev.us END,
              ev.us < rp.last_set + 3600000000
       FROM rp JOIN ev ON ev.user_id = rp.user_id AND ev.rn = rp.rn + 1)"""

_LOG_SQL = "WITH RECURSIVE" + _REPLAY_SQL + """,
ql AS (SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value AS total_ms,
              (e.props ->> '$.k')::INTEGER AS n_docs, e.event_type = 'error' AS failed,
              CASE WHEN e.event_type = 'error' THEN NULL ELSE rp.hit END AS from_cache
       FROM events e JOIN rp USING (event_id))
"""


@register("cache_ttl_replay", "WITH RECURSIVE" + _REPLAY_SQL + """
SELECT event_id, user_id, hit FROM rp
""")
def q_cache_ttl_replay(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    return ttl_replay(ev, "user_id", "ts", "event_id", 3600)


@register("cache_ttl_replay_hot_path", "WITH RECURSIVE" + _REPLAY_SQL + """
SELECT event_id, user_id, hit FROM rp
""")
def q_cache_ttl_replay_hot_path(spark, sf_dir):
    """H8 with every key treated as hot: the pointer-doubling plan that
    handles keys too large for one task, checked against the same SQL."""
    ev = load_table(spark, sf_dir, "events")
    return ttl_replay(ev, "user_id", "ts", "event_id", 3600, hot_threshold=0, bucket_seconds=600)


# --------------------------------------------------------------------------- #
# cache keys and batch lookup
# --------------------------------------------------------------------------- #

@register("cache_keys", """
SELECT item_id, md5(text) AS key_md5,
       md5(text || ':' || '{"filters": ' ||
           CASE WHEN item_id % 3 = 0 THEN 'null' ELSE '{"source": "src' || (item_id % 20) || '"}' END ||
           ', "k": ' || coalesce(nullif(item_id % 4, 0)::VARCHAR, 'null') || '}') AS key_kwargs,
       'rag:' || md5(text) AS key_prefixed
FROM benchmark
""")
def q_cache_keys(spark, sf_dir):
    """H1-H3: the three key forms.  Per-question call parameters: k =
    item_id % 4 (0 = not given) and a source filter on two of three items."""
    b = load_table(spark, sf_dir, "benchmark")
    k = F.when(F.col("item_id") % 4 != 0, F.col("item_id") % 4)
    filters = F.when(F.col("item_id") % 3 != 0, F.create_map(
        F.lit("source"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))))
    return b.select("item_id", cache_key_md5("text").alias("key_md5"),
                    cache_key_kwargs("text", {"k": (k, "int"), "filters": (filters, "map")}).alias("key_kwargs"),
                    cache_key_prefixed("text").alias("key_prefixed"))


BATCH_AT = "2024-01-16 00:00:00"
CLEARED_AT = "2024-01-05 00:00:00"
CACHE_TTL_DAYS = 7


_LOOKUP_SQL = f"""
WITH c AS (
  SELECT md5(user_id || ':' || event_type) AS key, ts AS set_at, ts + INTERVAL {CACHE_TTL_DAYS} DAY AS expires_at,
         event_id AS seq, 'answer#' || event_id AS payload
  FROM events WHERE ts < TIMESTAMP '{BATCH_AT}' AND event_type <> 'error'),
live AS (
  SELECT key, arg_max(payload, (set_at, seq)) AS payload FROM c
  WHERE set_at >= TIMESTAMP '{CLEARED_AT}' AND set_at <= TIMESTAMP '{BATCH_AT}'
        AND expires_at > TIMESTAMP '{BATCH_AT}'
  GROUP BY key),
q AS (SELECT event_id, md5(user_id || ':' || event_type) AS key, ts FROM events WHERE ts >= TIMESTAMP '{BATCH_AT}'),
qh AS (SELECT q.*, live.payload FROM q LEFT JOIN live USING (key)),
ld AS (SELECT key, arg_min(event_id, (ts, event_id)) AS leader FROM qh WHERE payload IS NULL GROUP BY key)
SELECT event_id,
       coalesce(payload, 'answer#' || leader) AS payload,
       CASE WHEN payload IS NOT NULL THEN true WHEN event_id = leader THEN false ELSE true END AS from_cache,
       CASE WHEN payload IS NOT NULL THEN 'cache' WHEN event_id = leader THEN 'computed' ELSE 'batch' END AS served_by
FROM qh LEFT JOIN ld USING (key)
"""


@register("cache_lookup_union", _LOOKUP_SQL)
def q_cache_lookup_union(spark, sf_dir):
    """H4-H7 + U2.  Requests before the batch time were answered and stored
    (errors not stored) with a 7-day TTL; the cache was cleared on Jan 5;
    every later request is asked in one batch at the batch time: live
    entries serve hits, the first request of an uncached key is computed,
    repeats in the batch are served from it."""
    batch, log = _asked_and_stored(spark, sf_dir)
    return _served(batch, log)


def _asked_and_stored(spark, sf_dir):
    """(the requests of the batch, the log of earlier ones)."""
    ev = load_table(spark, sf_dir, "events")
    keyed = ev.withColumn("key", F.md5(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"))))
    past = keyed.where(F.col("ts") < F.lit(BATCH_AT).cast("timestamp_ntz")).withColumn("error",
        F.when(F.col("event_type") == "error", F.lit("failed")))
    log = entries(past, "key", "ts", F.concat(F.lit("answer#"), F.col("event_id").cast("string")),
                  ttl_seconds=CACHE_TTL_DAYS * 86400, seq=F.col("event_id"), error_col="error")
    log = log.unionByName(clear_marker(spark, CLEARED_AT))
    batch = keyed.where(F.col("ts") >= F.lit(BATCH_AT).cast("timestamp_ntz")).select("event_id", "key", "ts")
    return batch, log


def _served(batch, log):
    def compute(leaders):
        return leaders.select("event_id", F.concat(F.lit("answer#"), F.col("event_id").cast("string")).alias("payload"))

    out = answer_with_cache(batch, log, BATCH_AT, compute, key_col="key", id_col="event_id", order_cols=["ts"])
    return out.select("event_id", "payload", "from_cache", "served_by")


@register("cache_log_lookup", _LOOKUP_SQL)
def q_cache_log_lookup(spark, sf_dir):
    """H4-H6 over a stored log of two batches, before the clearing and with it;
    the lookup reads the days and buckets that can hold live entries."""
    batch, log = _asked_and_stored(spark, sf_dir)
    path, cleared = scratch_path(spark, "cache-log"), F.lit(CLEARED_AT).cast("timestamp_ntz")
    append_entries(log.where(F.col("set_at") < cleared), path, "1")
    append_entries(log.where(F.col("set_at") >= cleared), path, "2")
    return _served(batch, read_log(spark, path, BATCH_AT, batch))


# --------------------------------------------------------------------------- #
# metrics
# --------------------------------------------------------------------------- #

@register("query_counters", _LOG_SQL + """
SELECT event_type, count(*) AS queries, count(*) FILTER (WHERE failed) AS failures,
       count(*) FILTER (WHERE NOT failed AND coalesce(from_cache, false)) AS cache_hits,
       count(*) FILTER (WHERE NOT failed AND NOT coalesce(from_cache, false)) AS cache_misses,
       round(CASE WHEN count(*) FILTER (WHERE NOT failed) > 0 THEN
             (count(*) FILTER (WHERE NOT failed AND coalesce(from_cache, false)))::DOUBLE
             / count(*) FILTER (WHERE NOT failed) END, 6) AS hit_rate
FROM ql GROUP BY ROLLUP (event_type)
""")
def q_query_counters(spark, sf_dir):
    """M1 per request type with a rollup total (event_type NULL)."""
    log = events_query_log(spark, sf_dir)
    return counters(log, ["event_type"], rollup=True).withColumn("hit_rate", F.round("hit_rate", R))


def _hist_sql(value: str, edges, where: str) -> str:
    rows = [f"('{repr(float(e)) if isinstance(e, float) else e}', {e})" for e in edges]
    return f"""
edges(le, e) AS (VALUES {", ".join(rows)}),
obs AS (SELECT {value} AS v FROM ql WHERE {where})
SELECT le, (SELECT count(*) FROM obs WHERE v <= e) AS cum_count,
       round((SELECT sum(v)::DOUBLE FROM obs), 6) AS sum, (SELECT count(v) FROM obs) AS count FROM edges
UNION ALL
SELECT '+Inf', count(v), round(sum(v)::DOUBLE, 6), count(v) FROM obs
"""


@register("latency_histogram", _LOG_SQL + "," + _hist_sql(
    "total_ms / 1000.0", (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0), "TRUE"))
def q_latency_histogram(spark, sf_dir):
    """M2: request duration (seconds) histogram, cumulative buckets."""
    h = latency_histogram(request_log(spark, sf_dir))
    return h.select("le", "cum_count", F.round("sum", R).alias("sum"), "count")


@register("docs_histogram", _LOG_SQL + "," + _hist_sql("n_docs", (1, 2, 3, 5, 10, 20, 50, 100), "NOT failed"))
def q_docs_histogram(spark, sf_dir):
    """M3: documents per returned result (cache hits included)."""
    h = docs_histogram(request_log(spark, sf_dir))
    return h.select("le", "cum_count", F.round("sum", R).alias("sum"), "count")


@register("bench_stats", _LOG_SQL + """
SELECT event_type,
       round(avg(total_ms) FILTER (WHERE NOT coalesce(from_cache, false)), 6) AS first_avg_ms,
       round(min(total_ms) FILTER (WHERE NOT coalesce(from_cache, false)), 6) AS first_min_ms,
       round(max(total_ms) FILTER (WHERE NOT coalesce(from_cache, false)), 6) AS first_max_ms,
       round(avg(total_ms) FILTER (WHERE coalesce(from_cache, false)), 6) AS cached_avg_ms,
       round(min(total_ms) FILTER (WHERE coalesce(from_cache, false)), 6) AS cached_min_ms,
       avg(total_ms) FILTER (WHERE NOT coalesce(from_cache, false)) <= 20.0 AS meets_target,
       round(greatest(avg(total_ms) FILTER (WHERE NOT coalesce(from_cache, false)) - 20.0, 0.0), 6) AS over_target_ms
FROM ql WHERE NOT failed GROUP BY event_type
""")
def q_bench_stats(spark, sf_dir):
    """M4 + M5 per request type (target 20 ms)."""
    s = bench_stats(events_query_log(spark, sf_dir), ["event_type"])
    return s.select("event_type", *[F.round(c, R).alias(c) for c in
                                    ("first_avg_ms", "first_min_ms", "first_max_ms", "cached_avg_ms", "cached_min_ms")],
                    "meets_target", F.round("over_target_ms", R).alias("over_target_ms"))


@register("stage_split", """
SELECT event_type AS stage, round(avg(value), 6) AS avg_ms,
       round(sum(value) / (SELECT sum(value) FROM events), 6) AS share
FROM events GROUP BY event_type
""")
def q_stage_split(spark, sf_dir):
    """M6, unpivoted: mean time of each stage and its share of all time.  The
    request type names the stage that took an event's time."""
    long = stage_split_long(request_log(spark, sf_dir).withColumnRenamed("event_type", "stage"))
    return long.select("stage", F.round("avg_ms", R).alias("avg_ms"), F.round("share", R).alias("share"))


SLOW = {"total_ms": 250.0, "n_docs": 95.0}


@register("slow_queries", _LOG_SQL + """
SELECT event_id, array_to_string(list_filter([CASE WHEN total_ms > 250.0 THEN 'total_ms>250' END,
                                              CASE WHEN n_docs > 95.0 THEN 'n_docs>95' END],
                                             lambda x: x IS NOT NULL), ',') AS reasons
FROM ql WHERE total_ms > 250.0 OR n_docs > 95.0
""")
def q_slow_queries(spark, sf_dir):
    """M7: requests over a stage threshold, with reasons."""
    s = slow_queries(request_log(spark, sf_dir), SLOW)
    return s.select("event_id", F.array_join("reasons", ",").alias("reasons"))


@register("latency_blend", _LOG_SQL + """
SELECT event_type,
       round(avg(total_ms) FILTER (WHERE coalesce(from_cache, false)), 6) AS avg_hit_ms,
       round(avg(total_ms) FILTER (WHERE NOT coalesce(from_cache, false)), 6) AS avg_miss_ms,
       round(avg(coalesce(from_cache, false)::INTEGER::DOUBLE), 6) AS observed_hit_rate,
       round(0.7 * avg(total_ms) FILTER (WHERE coalesce(from_cache, false))
             + (1 - 0.7::DOUBLE) * avg(total_ms) FILTER (WHERE NOT coalesce(from_cache, false)), 6) AS expected_ms
FROM ql WHERE NOT failed GROUP BY event_type
""")
def q_latency_blend(spark, sf_dir):
    """M9 at the reference's 70 % hit rate, per request type."""
    b = latency_blend(events_query_log(spark, sf_dir), ["event_type"], hit_rate=0.7)
    return b.select("event_type", *[F.round(c, R).alias(c) for c in
                                    ("avg_hit_ms", "avg_miss_ms", "observed_hit_rate", "expected_ms")])


@register("cost_estimate", """
WITH t AS (SELECT conv_id, role, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations)
SELECT conv_id, (sum(n) FILTER (WHERE role <> 'assistant'))::BIGINT AS input_tokens,
       (sum(n) FILTER (WHERE role = 'assistant'))::BIGINT AS output_tokens,
       round(coalesce(sum(n) FILTER (WHERE role <> 'assistant'), 0) / 1000 * 0.0002
             + coalesce(sum(n) FILTER (WHERE role = 'assistant'), 0) / 1000 * 0.0006, 9) AS cost,
       round((coalesce(sum(n) FILTER (WHERE role <> 'assistant'), 0) / 1000 * 0.0002
             + coalesce(sum(n) FILTER (WHERE role = 'assistant'), 0) / 1000 * 0.0006) * (1 - 0.8::DOUBLE), 9) AS cost_with_cache
FROM t GROUP BY conv_id
""")
def q_cost_estimate(spark, sf_dir):
    """M8 per conversation: words as tokens, input = system + user, output =
    assistant, with the 80 % hit-rate saving."""
    c = load_table(spark, sf_dir, "conversations")
    n = F.size(F.filter(F.split("text", r"\s+", -1), lambda x: x != ""))
    t = c.select("conv_id", F.when(F.col("role") != "assistant", n).alias("inp"),
                 F.when(F.col("role") == "assistant", n).alias("out"))
    g = cost(t, "inp", "out", hit_rate=0.8, by=["conv_id"])
    return g.select("conv_id", "input_tokens", "output_tokens", F.round("cost", 9).alias("cost"),
                    F.round("cost_with_cache", 9).alias("cost_with_cache"))


@register("format_times", """
SELECT event_id,
       CASE WHEN value < 1 THEN printf('%.0f', value * 1000) || 'μs' ELSE printf('%.1f', value) || 'ms' END AS as_ms,
       CASE WHEN value / 1000 < 1 THEN printf('%.2f', value / 1000 * 1000) || ' ms'
            ELSE printf('%.2f', value / 1000) || ' sec' END AS as_seconds
FROM events
""")
def q_format_times(spark, sf_dir):
    """F2 (value as milliseconds) and F3 (value / 1000 as seconds)."""
    ev = load_table(spark, sf_dir, "events")
    return ev.select("event_id", format_ms("value").alias("as_ms"),
                     format_seconds(F.col("value") / 1000).alias("as_seconds"))
