"""Embeddings kept between runs: nothing is embedded twice, the store is not shuffled."""
import numpy as np

from quarry.operators.embed import embed
from quarry.operators.embed_store import embed_stored


def _lengths(texts):
    return np.stack([texts.str.len().to_numpy(float), texts.str.count("a").to_numpy(float) + 1], axis=1)


def test_second_run_embeds_nothing(spark, tmpdir_fresh):
    path, schema = f"{tmpdir_fresh}/store", "id long, text string"
    rows = [(i, f"text {'a' * (i % 7)}") for i in range(50)] + [(99, None), (98, "")]
    docs = spark.createDataFrame(rows, schema)
    first, n = embed_stored(docs, "text", _lengths, 2, path)
    assert n == 8  # seven texts and the empty one
    plain = {r.id: list(r.v) for r in embed(docs.fillna(""), "text", _lengths, 2, "v").collect()}
    assert {r.id: list(r.embedding) for r in first.collect()} == plain
    again, n = embed_stored(docs, "text", lambda t: 1 / 0, 2, path)
    assert n == 0 and {r.id: list(r.embedding) for r in again.collect()} == plain
    more, n = embed_stored(docs.unionByName(spark.createDataFrame([(1, "another")], schema)), "text", _lengths, 2, path)
    assert n == 1 and more.count() == 53
    plan = more._jdf.queryExecution().executedPlan().toString()
    # the one exchange is that of the asked rows
    assert "Bucketed: true" in plan and plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
