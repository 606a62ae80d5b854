"""Query metrics as aggregations over a query-log table (M1-M9).

A query log has one row per request with (at least) ``failed BOOLEAN``,
``from_cache BOOLEAN`` (NULL = miss), ``total_ms DOUBLE`` and ``n_docs INT``;
stage columns such as ``retrieval_ms``/``llm_ms`` are optional.  Every
function is a grouped aggregation with map-side partial aggregation; none
collects rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

# Default histogram edges (seconds) of the metrics library the
# reference uses, slow-query thresholds, token prices per 1K tokens.
LATENCY_EDGES_S = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
DOCS_EDGES = (1, 2, 3, 5, 10, 20, 50, 100)
SLOW_RETRIEVAL_MS = 500.0
SLOW_LLM_MS = 2000.0
PRICE_INPUT_PER_1K = 0.0002
PRICE_OUTPUT_PER_1K = 0.0006
PRICE_EMBED_PER_1K = 0.00002
TARGET_MS = 20.0


def _served(log):
    return ~F.coalesce(F.col("failed"), F.lit(False))


def counters(log: DataFrame, by: Sequence[str] = (), rollup: bool = False) -> DataFrame:
    """M1: queries (counted before the call, failures included), hits and
    misses of returned results (NULL from_cache = miss), hit rate.
    ``rollup`` adds the subtotals (NULL in ``by``)."""
    served = _served(log)
    hit = served & F.coalesce(F.col("from_cache"), F.lit(False))
    miss = served & ~F.coalesce(F.col("from_cache"), F.lit(False))
    agg = [F.count("*").alias("queries"), F.count_if(~served).alias("failures"),
           F.count_if(hit).alias("cache_hits"), F.count_if(miss).alias("cache_misses")]
    g = (log.rollup(*by) if rollup else log.groupBy(*by)).agg(*agg)
    return g.withColumn("hit_rate", F.when(F.col("cache_hits") + F.col("cache_misses") > 0,
                                           F.col("cache_hits") / (F.col("cache_hits") + F.col("cache_misses"))))


def _label(e) -> str:
    return repr(float(e)) if isinstance(e, float) else str(e)


def histogram(log: DataFrame, value, edges: Sequence[float], where=None, by: Sequence[str] = ()) -> DataFrame:
    """M2/M3: cumulative buckets (``le`` label, +Inf last) with the sum and
    count of observations, long form via ``stack`` after one aggregation."""
    v = F.col(value) if isinstance(value, str) else value
    df = log if where is None else log.where(where)
    sums = [F.count_if(v <= F.lit(e)).alias(f"_c{i}") for i, e in enumerate(edges)]
    agg = df.groupBy(*by).agg(*sums, F.count(v).alias("_inf"), F.sum(v).cast("double").alias("sum"),
                              F.count(v).alias("count"))
    pairs = ", ".join([f"'{_label(e)}', _c{i}" for i, e in enumerate(edges)] + ["'+Inf', _inf"])
    return agg.selectExpr(*by, f"stack({len(edges) + 1}, {pairs}) AS (le, cum_count)", "sum", "count")


def latency_histogram(log: DataFrame, edges_s=LATENCY_EDGES_S, by=()) -> DataFrame:
    return histogram(log, F.col("total_ms") / 1000.0, edges_s, None, by)


def docs_histogram(log: DataFrame, edges=DOCS_EDGES, by=()) -> DataFrame:
    """Observed on every returned result, cache hits included (M3)."""
    return histogram(log, F.col("n_docs"), edges, _served(log), by)


def bench_stats(log: DataFrame, by: Sequence[str] = (), target_ms: float = TARGET_MS) -> DataFrame:
    """M4 + M5: first-run (not from cache) mean/min/max, cached mean/min,
    and the target check on the first-run mean."""
    first = ~F.coalesce(F.col("from_cache"), F.lit(False))
    cached = F.coalesce(F.col("from_cache"), F.lit(False))
    t = F.col("total_ms")
    g = log.where(_served(log)).groupBy(*by).agg(
        F.avg(F.when(first, t)).alias("first_avg_ms"), F.min(F.when(first, t)).alias("first_min_ms"),
        F.max(F.when(first, t)).alias("first_max_ms"), F.avg(F.when(cached, t)).alias("cached_avg_ms"),
        F.min(F.when(cached, t)).alias("cached_min_ms"))
    return (g.withColumn("meets_target", F.col("first_avg_ms") <= F.lit(target_ms))
             .withColumn("over_target_ms", F.greatest(F.col("first_avg_ms") - F.lit(target_ms), F.lit(0.0))))


def stage_split(log: DataFrame, stages: Sequence[str], total: str = "total_ms", by=()) -> DataFrame:
    """M6: mean per stage and each stage's share of the total time."""
    aggs = [F.sum(total).alias("_tot")]
    for s in stages:
        aggs += [F.avg(s).alias(f"avg_{s}"), F.sum(s).alias(f"_sum_{s}")]
    g = log.groupBy(*by).agg(*aggs)
    for s in stages:
        g = g.withColumn(f"share_{s}", F.col(f"_sum_{s}") / F.col("_tot")).drop(f"_sum_{s}")
    return g.drop("_tot")


def stage_split_long(log: DataFrame, stage: str = "stage", total: str = "total_ms", by=()) -> DataFrame:
    """M6 for a log with a row per stage time: ``stage``, avg_ms and the
    stage's share of all time, for every stage that occurs, null included."""
    g = log.groupBy(*by, stage).agg(F.avg(total).alias("avg_ms"), F.sum(total).alias("_sum"))
    # one row for each stage
    return g.withColumn("share", F.col("_sum") / F.sum("_sum").over(Window.partitionBy(*by))).drop("_sum")


def slow_queries(log: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """M7: requests over any stage threshold, with the list of reasons."""
    reasons = F.filter(F.array(*[F.when(F.col(c) > F.lit(float(t)), F.lit(f"{c}>{t:g}"))
                                 for c, t in thresholds.items()]), lambda x: x.isNotNull())
    return log.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def cost(log: DataFrame, input_tokens: str, output_tokens: str, embed_tokens: str | None = None,
         hit_rate=None, by=()) -> DataFrame:
    """M8: token cost (no tokens cost nothing); with a hit rate the cached
    share costs nothing."""
    def used(c):
        return F.coalesce(F.sum(c), F.lit(0))

    c = used(input_tokens) / 1000 * PRICE_INPUT_PER_1K + used(output_tokens) / 1000 * PRICE_OUTPUT_PER_1K
    if embed_tokens:
        c = c + used(embed_tokens) / 1000 * PRICE_EMBED_PER_1K
    g = log.groupBy(*by).agg(F.sum(input_tokens).alias("input_tokens"), F.sum(output_tokens).alias("output_tokens"),
                             c.alias("cost"))
    if hit_rate is not None:
        g = g.withColumn("cost_with_cache", F.col("cost") * (1 - F.lit(float(hit_rate))))
    return g


def latency_blend(log: DataFrame, by=(), hit_rate=None) -> DataFrame:
    """M9: expected latency = hit * avg(cached) + (1 - hit) * avg(first).
    ``hit_rate`` None uses the observed rate of each group."""
    served = _served(log)
    fc = F.coalesce(F.col("from_cache"), F.lit(False))
    g = log.where(served).groupBy(*by).agg(
        F.avg(F.when(fc, F.col("total_ms"))).alias("avg_hit_ms"),
        F.avg(F.when(~fc, F.col("total_ms"))).alias("avg_miss_ms"),
        F.avg(fc.cast("double")).alias("observed_hit_rate"))
    h = F.col("observed_hit_rate") if hit_rate is None else F.lit(float(hit_rate))
    return g.withColumn("expected_ms", h * F.col("avg_hit_ms") + (1 - h) * F.col("avg_miss_ms"))
