"""E1/E2 plug-in embedder, J8 threshold, X6/M6 stage log, T4 sessions,
skewed filter key split by the grid plan."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quarry.functions.time import instant_to_ntz, ntz_to_instant
from quarry.operators.embed import embed
from quarry.operators.knn import knn_join, with_scores
from quarry.plans.instrument import StageTimer, stage_shares, with_metrics
from quarry.streaming.common import file_stream
from quarry.streaming.metrics import run_windowed, session_counters
from tests.conftest import SF001


def test_plugin_embedder_dedupes(spark):
    calls = []

    def emb(texts: pd.Series) -> np.ndarray:
        calls.append(len(texts))
        return np.stack([np.array([len(t), 1.0, 0.0]) for t in texts])

    df = spark.createDataFrame([(1, "aa"), (2, "bbb"), (3, "aa")], "id long, text string")
    got = {r.id: r.embedding for r in embed(df, "text", emb, 3).collect()}
    assert np.allclose(got[1], got[3]) and abs(np.linalg.norm(got[2]) - 1) < 1e-6


def test_min_score_threshold(spark):
    idx = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.0])], "qid long, q_vec array<double>")
    hits = with_scores(knn_join(q, idx, 2, c_id="vec_id"), min_score=0.0).collect()
    assert [(h.rank, h.vec_id) for h in hits] == [(1, 1)]


def test_stage_log(spark, tmpdir_fresh):
    def fn(qs, timer: StageTimer):
        a = timer.timed("retrieval", qs.withColumn("x", F.col("id") * 2))
        return a.withColumn("answer", F.col("x").cast("string"))
    run = with_metrics(fn, f"{tmpdir_fresh}/log")
    run(spark.range(10), "b1")
    log = spark.read.parquet(f"{tmpdir_fresh}/log")
    assert {r.stage for r in log.collect()} == {"retrieval", "result", "total"}
    shares = {r.stage: r.share for r in stage_shares(log).collect()}
    assert set(shares) == {"retrieval", "result"} and all(0 <= v <= 1.5 for v in shares.values())


def test_session_windows(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    s = file_stream(spark, f"{SF001}/events*.parquet", ev.schema)
    agg = session_counters(s, "user_id", "ts", "30 minutes").select(
        instant_to_ntz("session_window.start").alias("start"), "user_id", "requests")
    out = {(r.start, r.user_id): r.requests for r in run_windowed(spark, agg, ["start", "user_id"], "append").collect()}
    batch = ev.groupBy(F.session_window(ntz_to_instant("ts"), "30 minutes"), "user_id").agg(
        F.count("*").alias("requests")).select(
        instant_to_ntz("session_window.start").alias("start"), "user_id", "requests").collect()
    assert out and all(batch_row.requests == out[(batch_row.start, batch_row.user_id)]
                       for batch_row in batch if (batch_row.start, batch_row.user_id) in out)
    assert len(out) >= 0.9 * len(batch)


def test_grid_splits_hot_filter_key(spark):
    rows = [(i, [float(i % 7), float(i % 5)], 0 if i % 3 else 1) for i in range(600)]  # label 0 holds 2/3
    c = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q = c.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_vec"), "label")
    a = knn_join(q, c, 3, q_id="qid", q_vec="q_vec", c_id="vec_id", on=["label"], strategy="grid",
                 q_block=50, c_block=40)
    b = knn_join(q, c, 3, q_id="qid", q_vec="q_vec", c_id="vec_id", on=["label"], strategy="index_broadcast")
    key = lambda r: (r.qid, r.rank, r.vec_id, round(r.d2, 9))
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_vector_functions_and_input_truncation(spark):
    from quarry.functions.vectors import dot, norm, sq_l2
    from quarry.operators.embed import truncate_words
    r = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0], " a  b c d ")], "a array<double>, b array<double>, t string") \
        .select(dot("a", "b").alias("d"), sq_l2("a", "b").alias("s"), norm("a").alias("n"),
                truncate_words("t", 2).alias("w")).first()
    assert (r.d, r.s) == (13.0, 13.0) and abs(r.n - 5 ** 0.5) < 1e-12 and r.w == " a"


def test_ivf_scan_reads_only_probed_lists(spark, tmpdir_fresh):
    from quarry.operators.knn import build_ivf, ivf_knn_join
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    cents, assigned = build_ivf(e, 8, c_id="vec_id", c_vec="embedding", seed=5)
    assigned.write.partitionBy("list_id").parquet(f"{tmpdir_fresh}/vec")
    vec = spark.read.parquet(f"{tmpdir_fresh}/vec")
    q = e.limit(3).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_vec"))
    out = ivf_knn_join(q, cents, vec, 3, 1, q_id="qid", q_vec="q_vec", c_id="vec_id", strategy="query_broadcast")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    import re
    assert re.search(r"PartitionFilters: \[[^\]]*list_id#\d+ IN \(", plan), plan


def test_verbatim_matches_edge_cases_and_brute_force(spark):
    import pandas as pd
    from quarry.operators.match import verbatim_matches
    docs = spark.createDataFrame([(1, "xxthe quick brown fox jumps over the lazy dogs!"), (2, "ab"), (3, "cat"),
                                  (4, "The Quick brown fox jumps over")], "doc_id long, text string")
    ps = spark.createDataFrame([(10, "the quick brown fox jumps over the lazy dog"),  # starts/ends mid-word
                                (11, "at"), (12, "b"), (13, "brown fox"), (14, "")], "item_id long, text string")
    got = sorted((r.item_id, r.doc_id) for r in verbatim_matches(ps, docs).collect())
    assert got == [(10, 1), (11, 3), (12, 1), (12, 2), (12, 4), (13, 1), (13, 4)]
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    b = pd.read_parquet("/root/testdata/sf0.01/benchmark.parquet")
    exp = sorted((i, j) for i, p in zip(b.item_id, b.text) for j, t in zip(d.doc_id, d.text) if p in t)
    got = sorted((r.item_id, r.doc_id) for r in verbatim_matches(
        spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet"),
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect())
    assert got == exp and len(exp) == 26


def test_query_broadcast_many_small_batches(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_vec"))
    base = sorted((r.qid, r.rank, r.vec_id) for r in
                  knn_join(q, e, 4, q_id="qid", q_vec="q_vec", c_id="vec_id", strategy="index_broadcast").collect())
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r.qid, r.rank, r.vec_id) for r in
                     knn_join(q, e.repartition(2), 4, q_id="qid", q_vec="q_vec", c_id="vec_id",
                              strategy="query_broadcast").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == base


def test_index_stats_additive_over_appends(spark, tmpdir_fresh):
    from quarry.operators.index import build_and_write_index, read_term_stats
    from quarry.operators.rerank import term_stats
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "source")
    a, b = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    path = f"{tmpdir_fresh}/idx"
    build_and_write_index(a, path, mode="overwrite", id_cols=("doc_id",))
    build_and_write_index(b, path, mode="append", id_cols=("doc_id",))
    chunks = spark.read.parquet(f"{path}/chunks")
    assert set(chunks.columns) >= {"batch", "chunk_id"}
    terms, stats = read_term_stats(spark, path)
    t_all, s_all = term_stats(chunks, "chunk_id", "text")
    got = {r.term: r.df for r in terms.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    assert got == {r.term: r.df for r in t_all.collect()}
    g = stats.agg(F.sum("n_docs"), F.sum("total_len")).first()
    e = s_all.first()
    assert (g[0], g[1]) == (e.n_docs, e.total_len)
    assert spark.read.parquet(f"{path}/vectors").count() == chunks.count()


def test_plugin_embedder_input_truncation(spark):
    def emb(texts: pd.Series) -> np.ndarray:
        # the vector encodes how many words the embedder was given
        return np.stack([np.array([float(len(t.split())), 1.0]) for t in texts])

    df = spark.createDataFrame([(1, "a b c d"), (2, "a b x y z")], "id long, text string")
    out = {r.id: r.embedding for r in embed(df, "text", emb, 2, max_words=2).collect()}
    expect = np.array([2.0, 1.0]) / np.sqrt(5.0)
    assert np.allclose(out[1], expect) and np.allclose(out[2], expect)
