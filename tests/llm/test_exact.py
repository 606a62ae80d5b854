"""Exact dedup against grouping by text."""
import hashlib

from quarry.llm.exact import exact_dedup, identities


def check(docs, **options):
    rows = docs.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    got = exact_dedup(docs, **options).collect()
    assert len(got) == len(rows)
    text = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    kept = {}
    for r in got:
        ids = groups[text[r["text_sha256"]]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept.setdefault(r["text_sha256"], []).append(r["kept"])
    assert all(sum(k) == 1 for k in kept.values())


def test_odd_rows(odd, empty):
    check(odd)
    check(odd, block=700)
    assert exact_dedup(empty).count() == 0


def test_levels(table):
    """Texts of up to many blocks that differ in one byte, at every place."""
    base = "abcdefgh" * 9
    texts = [base] * 5 + [base[:i] + "X" + base[i + 1:] for i in range(len(base))] + [base[:i] for i in range(len(base))] + [base + "abcd", "é" * 13, "é" * 13]
    docs = table([(i, t, "en", "s", 1, None, None, None, None) for i, t in enumerate(texts * 2)])
    check(docs, block=4)
    ids = identities(docs, block=4)
    assert ids.select("level", "name").distinct().count() == len(set(texts))


def test_hot_block(spark, table):
    """One block in a third of all rows, over more partitions than rows of it."""
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        check(table([(i, "hot" if i % 3 == 0 else f"t{i % 50}", "en", "s", 1, None, None, None, None) for i in range(600)]), block=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
