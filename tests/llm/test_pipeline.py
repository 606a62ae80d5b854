"""The pipeline: every stage against a plain reading of its input."""
import corpus_pipeline as C
from quarry.llm import packing
from quarry.llm.common import written
from tests.conftest import SF001
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_minhash import brute as brute_near
from tests.llm.test_quality import base


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in C.STAGES[:-1]:
        out = written(stage(spark, docs, SF001), f"test-{name}")
        assert out.columns == columns
        before = [tuple(r) for r in docs.orderBy("doc_id").collect()]
        after = {r["doc_id"]: r for r in out.collect()}
        if name == "quality_rules":
            ok = {r[0] for r in before if not base(r[1])[5]}
            assert set(after) <= ok and len(after) > 0.8 * len(ok)
        if name == "line_dedup":
            gone = brute_lines(before, 1)
            for r in before:
                left = "\n".join(x for k, x in enumerate(r[1].split("\n")) if (r[0], k) not in gone)
                if left.strip() or left == r[1]:
                    assert after[r[0]]["text"] == left and after[r[0]]["n_chars"] == len(left)
                else:
                    assert r[0] not in after
        if name == "near_dedup":
            assert set(after) == {d for d, (_, c) in brute_near(before, 5, 80).items() if c == d}
        if name == "mixing":
            assert sorted(map(str, (tuple(r) for r in after.values()))) == sorted(map(str, before))
        docs = out
        sizes.append(len(after))
    assert sizes[0] > 0
    pieces = C.STAGES[-1][1](spark, docs, SF001).collect()
    encode = packing.encoder()
    assert sum(p["length"] for p in pieces) == sum(len(encode(r["text"])) + 1 for r in docs.collect())
    assert C.run(spark, SF001).count() == len(pieces)


def test_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in C.STAGES:
            out = stage(spark, docs, SF001)
            assert out.columns == docs.columns or name == "packing"
            docs = written(out, f"odd-{name}")


def test_sequences_are_mixed(spark, table):
    """Up to every border of two groups the sequences hold each source's share
    (a hot source included); each group's windows are its own and full but for the last."""
    from collections import Counter
    from quarry.llm import mixing as M
    source = lambda i: "hot" if i % 3 else f"s{i % 4}"
    docs = table([(i, f"text {i} " + "word " * (i * 7 % 90), "en", source(i), 1, None, None, None, None) for i in range(6000)])
    docs = docs.orderBy(docs.source, docs.doc_id)
    docs = written(docs, "by-source")
    weights = spark.createDataFrame([("hot", 4), ("s0", 2), ("s1", 2), ("s2", 1), ("s3", 1)], "source string, weight long")
    groups = M.slot_groups(docs, group_docs=256, weights=weights)
    pieces = packing.pack_groups(docs, groups, capacity=128).collect()
    mixed = {r["uid"]: r["mixed"] for r in groups.collect()}
    assert len(mixed) == 6000 and len({p["doc_id"] for p in pieces}) == 6000
    stretches, fill = {}, Counter()
    for p in pieces:
        stretches.setdefault(p["sequence_id"] >> packing.GROUP_BITS, set()).add(p["doc_id"])
        fill[p["sequence_id"]] += p["length"]
    assert max(fill.values()) <= 128 and sum(map(len, stretches.values())) == 6000
    assert sum(fill.values()) > 0.97 * 128 * len(fill)
    end = sum(mixed.values())
    seen, share, borders = Counter(), {"hot": 0.4, "s0": 0.2, "s1": 0.2, "s2": 0.1, "s3": 0.1}, 0
    for g in sorted(stretches):
        seen.update(source(d) for d in stretches[g])
        total = sum(seen.values())
        if total > end:
            break
        borders += 1
        assert all(abs(seen[s] - share[s] * total) < M.BLOCK_DOCS for s in share), (g, seen)
    assert borders >= 5


def test_run_follows_the_mixed_order(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    monkeypatch.setattr(C, "slot_groups", lambda d: __import__("quarry.llm.mixing", fromlist=["x"]).slot_groups(d, group_docs=32))
    pieces = C.STAGES[-1][1](spark, docs, SF001).collect()
    assert len({p["sequence_id"] >> packing.GROUP_BITS for p in pieces}) > 1
