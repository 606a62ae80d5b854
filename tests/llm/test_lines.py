"""Line dedup against brute force over all pairs of lines."""
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import lines as L


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def edit(rng, s, k):
    s = list(s)
    for _ in range(k):
        p = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[p] = rng.choice("abcé🙂")
        elif kind == 1:
            s.insert(p, rng.choice("abcé🙂"))
        else:
            del s[p]
    return "".join(s)


def corpus(seed, bases=6, per=12, spread=3):
    rng = random.Random(seed)
    out = []
    for _ in range(bases):
        base = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(36, 60))).strip() + "end"
        out += [base] + [edit(rng, base, rng.randrange(spread + 1)) for _ in range(per)]
    rng.shuffle(out)
    docs = ["\n".join(out[i:i + 4]) for i in range(0, len(out), 4)]
    return [(i, t, "en", "s", len(t), None, None, None, None) for i, t in enumerate(docs)]


def brute(rows, tau, min_chars=L.MIN_CHARS):
    first, order = {}, []
    for d, t, *_ in rows:
        for k, x in enumerate(t.split("\n")):
            x = x.strip(" \t\x0b\x0c\r")
            if x:
                order.append((d, k, x))
                first.setdefault(x, (d, k))
    near = {x: min((p for y, p in first.items() if p < q and abs(len(x) - len(y)) <= tau and min(len(x), len(y)) >= min_chars
                    and distance(x, y) <= tau), default=None) for x, q in first.items()}
    return {(d, k) for d, k, x in order if first[x] != (d, k) or near[x]}


def found(docs, **options):
    _, _, drops = L.dropped_lines(docs, **options)
    uid = {r["uid"]: r["doc_id"] for r in L.line_report(docs, **options).select("uid", "doc_id").collect()}
    return {(uid[r["uid"]], d["line_no"]) for r in drops.collect() for d in r["drops"]}


@pytest.mark.parametrize("tau,hot", [(1, 64), (1, 2), (2, 64), (3, 64)])
def test_equals_brute_force(table, tau, hot):
    rows = corpus(tau * 10 + hot, spread=tau + 1)
    assert found(table(rows), tau=tau, hot=hot) == brute(rows, tau)


def test_hot_clique(table):
    """Lines that differ in one character: the single-character pieces."""
    base = "this line has one counter in it, number {} of the very long list"
    rows = [(i, base.format(c), "en", "s", 1, None, None, None, None) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    rows += [(100, base.format(""), "en", "s", 1, None, None, None, None)]
    assert found(table(rows), hot=2) == brute(rows, 1)


@pytest.mark.parametrize("tau", [1, 2, 4])
def test_band_distance(spark, tau):
    rng = random.Random(tau)
    pairs = []
    for _ in range(120):
        a = "".join(rng.choice("abé🙂") for _ in range(rng.randrange(8, 40)))
        b = edit(rng, a, rng.randrange(tau + 3))
        if abs(len(a) - len(b)) <= tau and min(len(a), len(b)) > tau:
            pairs.append((a, b))
    got = L._distance(spark.createDataFrame(pairs, "line_a string, line_b string"), tau).collect()
    for r in got:
        d = distance(r["line_a"], r["line_b"])
        assert r["edits"] == d if d <= tau else r["edits"] > tau


def test_odd_rows(odd, empty):
    got = L.line_report(odd)
    rows = got.collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["text"] for r in by[0]] == [None] and by[1][0]["text"] == "" and by[2][0]["text"] == " \n\t\n"
    assert sorted((r["n_lines"], r["n_copies"]) for r in by[5] + by[6]) == [(2, 0), (2, 2), (2, 2)]
    kept = L.dedup_lines(odd)
    assert kept.columns == odd.columns
    texts = [r["text"] for r in kept.collect()]
    assert texts.count("one") == 1 and sum("and a line" in (t or "") for t in texts) == 1
    assert kept.where(F.col("n_chars") != F.char_length("text")).where("text like 'same%'").count() == 0
    assert L.line_report(empty).count() == 0 and L.dedup_lines(empty).count() == 0
