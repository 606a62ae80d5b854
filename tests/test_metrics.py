"""M1-M9 on hand-made logs; reference check values."""
from quarry.operators.metrics import cost, counters, histogram, latency_blend, slow_queries


def _log(spark, rows):
    return spark.createDataFrame(rows, "failed boolean, from_cache boolean, total_ms double, n_docs int, llm_ms double")


def test_counters_missing_from_cache_is_miss(spark):
    log = _log(spark, [(False, True, 10.0, 3, 0.0), (False, None, 20.0, 3, 5.0), (True, None, 5.0, 0, 0.0)])
    r = counters(log).first()
    assert (r.queries, r.failures, r.cache_hits, r.cache_misses) == (3, 1, 1, 1) and r.hit_rate == 0.5
    empty = counters(_log(spark, [(True, None, 1.0, 0, 0.0)])).first()
    assert empty.hit_rate is None


def test_histogram_cumulative(spark):
    log = _log(spark, [(False, False, v, 1, 0.0) for v in (1.0, 2.0, 3.0, 10.0)])
    h = {r.le: r.cum_count for r in histogram(log, "total_ms", (2.0, 5.0)).collect()}
    assert h == {"2.0": 2, "5.0": 3, "+Inf": 4}


def test_cost_check_values(spark):
    df = spark.createDataFrame([(0, 500)] * 1000, "inp int, out int")
    r = cost(df, "inp", "out", hit_rate=0.8).first()
    assert abs(r.cost - 0.30) < 1e-12 and abs(r.cost_with_cache - 0.06) < 1e-12


def test_slow_and_blend(spark):
    log = _log(spark, [(False, False, 600.0, 1, 2500.0), (False, True, 100.0, 1, 0.0)])
    s = slow_queries(log, {"total_ms": 500.0, "llm_ms": 2000.0}).first()
    assert list(s.reasons) == ["total_ms>500", "llm_ms>2000"]
    b = latency_blend(log, hit_rate=0.7).first()
    assert abs(b.expected_ms - (0.7 * 100 + 0.3 * 600)) < 1e-9


def test_stage_split_any_type(spark, tmp_path):
    """Types other than those of the test data, and the null type, are stages."""
    from quarry.plans import load_all
    rows = [(1, "view", 1.0), (2, "refund", 2.0), (3, None, 4.0), (4, None, 1.0), (5, "view", None)]
    (spark.createDataFrame(rows, "event_id long, event_type string, value double")
     .selectExpr("*", "timestamp'2024-01-01' AS ts", "1L AS user_id", "'{}' AS props").write.parquet(str(tmp_path / "events.parquet")))
    got = {r.stage: (r.avg_ms, r.share) for r in load_all().QUERIES["stage_split"](spark, str(tmp_path)).collect()}
    assert got == {"view": (1.0, 0.125), "refund": (2.0, 0.25), None: (2.5, 0.625)}
