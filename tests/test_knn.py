"""All physical plans agree; edge cases; IVF."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators.knn import build_ivf, ivf_knn_join, knn_join
from tests.conftest import SF01


def _tables(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_vec"), "label")
    return q, e


def _rows(df):
    return sorted((r.qid, r.rank, r.vec_id, round(r.d2, 9)) for r in df.collect())


@pytest.mark.parametrize("strategy", ["query_broadcast", "grid"])
def test_strategies_agree(spark, strategy):
    q, e = _tables(spark)
    base = _rows(knn_join(q, e, 5, q_id="qid", q_vec="q_vec", c_id="vec_id", strategy="index_broadcast"))
    other = _rows(knn_join(q, e, 5, q_id="qid", q_vec="q_vec", c_id="vec_id", strategy=strategy,
                           q_block=37, c_block=61))
    assert base == other


@pytest.mark.parametrize("strategy", ["index_broadcast", "query_broadcast", "grid"])
def test_filtered_per_row_k(spark, strategy):
    q, e = _tables(spark)
    q = q.withColumn("k", F.when(F.col("label") % 4 == 0, F.lit(None)).otherwise(F.col("label") % 4))
    out = knn_join(q, e, 3, q_id="qid", q_vec="q_vec", c_id="vec_id", k_col="k", on=["label"],
                   strategy=strategy, q_block=50, c_block=40)
    lab = {r.vec_id: r.label for r in e.select("vec_id", "label").collect()}
    rows = out.collect()
    for r in rows:
        assert lab[r.qid] == lab[r.vec_id]
    per_q = {}
    for r in rows:
        per_q.setdefault(r.qid, []).append(r.rank)
    for qid, ranks in per_q.items():
        k = lab[qid] % 4 or 3
        assert sorted(ranks) == list(range(1, k + 1))


def test_fewer_than_k(spark):
    idx = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.0])], "qid long, q_vec array<double>")
    for s in ("index_broadcast", "query_broadcast", "grid"):
        out = knn_join(q, idx, 3, c_id="vec_id", strategy=s).collect()
        assert len(out) == 2 and [r.vec_id for r in sorted(out, key=lambda r: r.rank)] == [1, 2]


def test_zero_vector_normalize(spark):
    from quarry.operators.embed import normalize
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, v array<double>")
    got = {r.id: r.v for r in normalize(df, "v").collect()}
    assert got[1] == [0.0, 0.0] and np.allclose(got[2], [0.6, 0.8])


def test_ivf_all_lists_exact_and_recall(spark):
    q, e = _tables(spark)
    cents, assigned = build_ivf(e, 6, c_id="vec_id", c_vec="embedding", seed=3)
    exact = _rows(knn_join(q, e, 3, q_id="qid", q_vec="q_vec", c_id="vec_id"))
    for strategy in ("query_broadcast", "grid"):
        full = _rows(ivf_knn_join(q, cents, assigned, 3, 6, q_id="qid", q_vec="q_vec", c_id="vec_id",
                                  strategy=strategy, c_block=50))
        assert full == exact
    approx = ivf_knn_join(q, cents, assigned, 3, 1, q_id="qid", q_vec="q_vec", c_id="vec_id").collect()
    found = len({(r.qid, r.vec_id) for r in approx} & {(a, c) for a, _, c, _ in exact})
    assert 0 < found <= len(exact)


def test_no_cartesian_product(spark):
    q, e = _tables(spark)
    for s in ("query_broadcast", "grid"):
        plan = knn_join(q, e, 3, q_id="qid", q_vec="q_vec", c_id="vec_id", strategy=s) \
            ._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_window_group_limit(spark):
    q, e = _tables(spark)
    out = knn_join(q, e, 3, q_id="qid", q_vec="q_vec", c_id="vec_id", strategy="query_broadcast")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_ivf_with_filters_all_lists_equals_exact_filtered(spark):
    q, e = _tables(spark)
    cents, assigned = build_ivf(e, 5, c_id="vec_id", c_vec="embedding", seed=11)
    exact = _rows(knn_join(q, e, 3, q_id="qid", q_vec="q_vec", c_id="vec_id", on=["label"]))
    for strategy in ("query_broadcast", "grid"):
        got = _rows(ivf_knn_join(q, cents, assigned, 3, 5, q_id="qid", q_vec="q_vec", c_id="vec_id",
                                 strategy=strategy, on=["label"], c_block=60))
        assert got == exact


def test_null_filter_value_matches_nothing(spark):
    c = spark.createDataFrame([(1, [0.0, 1.0], None), (2, [1.0, 0.0], "a")], "vec_id long, embedding array<double>, f string")
    q = spark.createDataFrame([(10, [0.0, 1.0], None), (11, [0.0, 1.0], "a")], "qid long, q_vec array<double>, f string")
    for s in ("index_broadcast", "query_broadcast", "grid"):
        got = sorted((r.qid, r.vec_id) for r in knn_join(q, c, 2, c_id="vec_id", on=["f"], strategy=s).collect())
        assert got == [(11, 2)], (s, got)


def test_broadcast_limit_falls_back_to_grid(spark):
    from quarry.operators.knn import choose_strategy
    q, e = _tables(spark)
    qq = q.select("qid", "q_vec")
    cc = e.select("vec_id", "embedding")
    assert choose_strategy(qq, cc, "embedding", 64 << 20) == "index_broadcast"
    assert choose_strategy(qq, cc, "embedding", 64 << 20, allow_index_broadcast=False) == "query_broadcast"
    assert choose_strategy(qq, cc, "embedding", 1000) == "pivot"
    assert choose_strategy(qq, cc, "embedding", 1000, on=["label"]) == "grid"
    for s in ("index_broadcast", "query_broadcast"):
        with pytest.raises(ValueError, match="larger"):
            knn_join(q, e, 3, q_id="qid", q_vec="q_vec", c_id="vec_id", strategy=s, broadcast_bytes=1000)
    out = knn_join(q, e, 3, q_id="qid", q_vec="q_vec", c_id="vec_id", broadcast_bytes=1000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    base = _rows(knn_join(q, e, 3, q_id="qid", q_vec="q_vec", c_id="vec_id"))
    assert _rows(out) == base


def test_pivot_bounds_prune_and_stay_exact(spark):
    """Clustered vectors: exact rows, and a question meets few of the lists."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 20
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=8)]) for i in range(600)]
    c = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(10_000 + i, v, i % 4 + 1) for i, v in rows[::7]], "qid long, q_vec array<double>, k int")
    for options in ({}, {"k_col": "k"}):
        base = _rows(knn_join(q, c, 3, c_id="vec_id", strategy="index_broadcast", **options))
        assert _rows(knn_join(q, c, 3, c_id="vec_id", strategy="pivot", q_block=16, c_block=32, **options)) == base
    few = spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>")
    assert knn_join(q, few, 5, c_id="vec_id", strategy="pivot").count() == 2 * q.count()


def test_ivf_probes_until_k(spark):
    q, e = _tables(spark)
    cents, assigned = build_ivf(e, 12, c_id="vec_id", c_vec="embedding", seed=2)
    assigned = assigned.withColumn("rare", F.col("vec_id") % 100)
    qq = q.where("qid < 40").withColumn("rare", F.col("qid") % 100)
    held = {r.rare: r["count"] for r in assigned.groupBy("rare").count().collect()}
    got = {}
    for r in ivf_knn_join(qq, cents, assigned, 4, 1, q_id="qid", q_vec="q_vec", c_id="vec_id", on=["rare"]).collect():
        got[r.qid] = got.get(r.qid, 0) + 1
    assert got == {i: min(4, held[i % 100]) for i in range(40)}


def test_small_blocks_do_not_multiply_the_shuffle(spark):
    """However small the blocks asked for, a side is copied MIN_BLOCKS times at most."""
    from quarry.operators.knn import MIN_BLOCKS, _blocks
    assert _blocks(120_000, 16, 64) == MIN_BLOCKS and _blocks(100, 16, 64) == 7 and _blocks(0, 16, 64) == 1
    assert _blocks(10_000_000, 16, 64) == -(-10_000_000 // 65_536)
    n = spark.createDataFrame([(120_000,), (100,)], "n long")
    assert [r[0] for r in n.select(_blocks(F.col("n"), 16, 64)).collect()] == [MIN_BLOCKS, 7]


def test_streamed_goes_on_over_the_limit(spark):
    q, e = _tables(spark)
    q, e = q.where("qid < 40"), e.where("vec_id < 200")
    options = {"q_id": "qid", "q_vec": "q_vec", "c_id": "vec_id"}
    assert _rows(knn_join(q, e, 3, strategy="streamed", broadcast_bytes=1000, **options)) == _rows(knn_join(q, e, 3, **options))


def test_topk_block_ties_copies_and_odd_values():
    """The single-precision product only pre-selects: ties go by id, of copies
    the smallest ids stay, vectors that are not finite are no hits."""
    from quarry.operators.knn import topk_block
    r = np.random.default_rng(1)
    for scale, dtype in ((1.0, np.float32), (1e-20, np.float64), (1e20, np.float64)):
        x = r.normal(size=(6000, 5))
        x[:2500] = x[0]
        x[3000:3500] = np.round(x[3000:3500])
        x = (x * scale).astype(dtype)
        q, ids = np.concatenate([x[2400:2600], x[3000:3100]]).astype(float), r.permutation(6000)
        ks = r.integers(1, 6, len(q)).astype(np.int32)
        broken = x.copy()
        broken[5999] = np.nan
        got = topk_block(np.arange(len(q)), q, ks, ids, broken)
        d2 = ((q[:, None] - x[None, :5999].astype(float)) ** 2).sum(-1)
        want = [(i, ids[j]) for i in range(len(q)) for j in np.lexsort((ids[:5999], d2[i]))[:ks[i]]]
        assert list(zip(got.qid, got.cid)) == want


def test_repeated_question_ids_stay_together(spark):
    """Spreading the questions over all slots leaves the rows of an id in one task."""
    c = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i % 20, [float(i % 20), 1.0]) for i in range(40)], "qid long, q_vec array<double>").coalesce(1)
    got = knn_join(q, c, 2, c_id="vec_id", strategy="index_broadcast").groupBy("qid").agg(F.array_sort(F.collect_list("rank")).alias("r")).collect()
    assert len(got) == 20 and all(r.r == [1, 2, 3, 4] for r in got)
