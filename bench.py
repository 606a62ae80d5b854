"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Every query is executed in full with the ``noop`` sink (no collect).  The
flagship (benchmark questions answered end to end over the chunked corpus)
is also reported as questions per second.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = [
    "knn_exact_top3", "knn_filtered", "knn_ivf_all_lists", "hash_embed", "chunk_256_20", "chunk_512_50",
    "text_knn_top5", "bm25_rerank_top3", "extractive_answers", "context_numbered", "prompt_chat",
    "messages_flat_labelled", "html_text", "source_report", "cache_keys", "cache_lookup_union",
    "cache_ttl_replay", "query_counters", "latency_histogram", "format_times", "cost_estimate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from quarry.plans import load_all
    from pyspark.sql import functions as F

    from quarry.operators.index import build_ivf_index
    from quarry.plans.flagship import ask_batch, ingest
    from quarry.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="quarry-bench")
    reg = load_all()
    # warm-up on the smallest scale (JIT, Python workers, Arrow), untimed
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in ("knn_exact_top3", "hash_embed", "bm25_rerank_top3", "cache_ttl_replay"):
            reg.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
        wc, wv, ws = ingest(spark, warm_dir)
        ask_batch(spark, warm_dir, wc, wv, ws).answers.write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t = time.perf_counter()
        reg.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    extra = {}
    if not only or "flagship" in only:
        t = time.perf_counter()
        chunks, vectors, stats, index_path = ingest(spark, sf_dir, return_path=True)
        times["flagship_ingest"] = round(time.perf_counter() - t, 3)
        t = time.perf_counter()
        first = ask_batch(spark, sf_dir, chunks, vectors, stats)
        first.answers.write.format("noop").mode("overwrite").save()
        times["flagship_query"] = round(time.perf_counter() - t, 3)
        # the same batch again 30 minutes later: every answer is a cache hit
        log = first.cache_entries.checkpoint()
        t = time.perf_counter()
        again = ask_batch(spark, sf_dir, chunks, vectors, stats, cache_log=log, now="2024-02-01 00:30:00")
        again.answers.write.format("noop").mode("overwrite").save()
        times["flagship_cached_query"] = round(time.perf_counter() - t, 3)
        n_q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
        extra["flagship_chunks"] = vectors.count()
        extra["flagship_questions_per_sec"] = round(n_q / times["flagship_query"], 3)
        extra["flagship_ms_per_question"] = round(1000 * times["flagship_query"] / n_q, 3)
        extra["flagship_cached_ms_per_question"] = round(1000 * times["flagship_cached_query"] / n_q, 3)
        extra["flagship_cache_hits"] = again.answers.where("from_cache").count()
        # approximate path: IVF layout (32 lists), 8 probed per question
        # (reported separately, not part of the summed total)
        t = time.perf_counter()
        ich, ivec, cents = build_ivf_index(spark, index_path, 32, seed=7)
        extra["flagship_ivf_build_sec"] = round(time.perf_counter() - t, 3)
        t = time.perf_counter()
        ivf = ask_batch(spark, sf_dir, ich, ivec, stats, centroids=cents, nprobe=8)
        ivf_answers = ivf.answers.select("qid", "answer").checkpoint()
        extra["flagship_ivf_query_sec"] = round(time.perf_counter() - t, 3)
        same = ivf_answers.join(first.answers.select("qid", F.col("answer").alias("exact")), "qid") \
            .where(F.col("answer") == F.col("exact")).count()
        extra["flagship_ivf_same_answer_share"] = round(same / n_q, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, **extra}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
