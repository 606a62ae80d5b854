"""Near-duplicate groups against brute force over all pairs of sets."""
import random

import numpy as np

from quarry.llm import minhash as M


def words(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")


def sets(t, k):
    w = [x for x in words(t) if x]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    s = [sets(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(s[i] & s[j])
            if s[i] and s[j] and 100 * c >= percent * (len(s[i]) + len(s[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r[0]), r[0])
    return {r[0]: (len(s[i]), best[find(i)]) for i, r in enumerate(rows)}


def family(rng, base, n, lo, hi):
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randrange(lo, hi)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_equals_brute_force(table):
    rng = random.Random(5)
    texts = []
    for f in range(3):
        base = [f"w{f}x{rng.randrange(300)}" for _ in range(120)]
        texts += [" ".join(base)] + family(rng, base, 70, 0, 7)
    texts += texts[:20] + [t.upper() for t in texts[20:30]] + ["a b", "A  b", "", None, "one\ttwo three four five six"]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t, "en", "s", 1, None, None, None, None) for i, t in enumerate(texts)]
    for k, percent in ((4, 80), (5, 80)):
        want = brute(rows, k, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_groups(table(rows), shingle=k, percent=percent).collect()}
        assert got == want


def test_estimate_is_unbiased(spark):
    rng = np.random.default_rng(3)
    rows, true = [], []
    for j in (0.5, 0.8, 0.95):
        u = np.unique(rng.integers(0, 2**63, 600, dtype=np.uint64))
        c, own = int(len(u) * j), (len(u) - int(len(u) * j)) // 2
        a, b = np.sort(u[:c + own]), np.sort(np.r_[u[:c], u[c + own:]])
        true.append(c / len(u))
        rows.append(([int(x) for x in M.pack_bits(M.minima(a, 256)).view(np.int64)], [int(x) for x in M.pack_bits(M.minima(b, 256)).view(np.int64)]))
    from pyspark.sql import functions as F
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(M.estimate(F.col("a"), F.col("b"), 256).alias("e")).collect()
    assert all(abs(r["e"] - t) < 0.12 for r, t in zip(got, true))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (200, 200)]
    got = {r["node"]: r["label"] for r in M.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 103: 100, 105: 100}


def test_odd_rows(odd, empty):
    got = M.near_groups(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[0][0]["n_shingles"] == 0 and by[0][0]["kept"] and by[2][0]["component_id"] == 2
    same = [r for r in got if r["doc_id"] in (5, 6)]
    assert {r["component_id"] for r in same} == {5} and sum(r["kept"] for r in same) == 1
    assert sorted(r["kept"] for r in by[7]) == [False, True]
    one = [r for r in got if r["n_shingles"] == 1 and r["component_id"] == 3]
    assert len(one) == 2 and sum(r["kept"] for r in one) == 1
    assert M.near_groups(empty).count() == 0
