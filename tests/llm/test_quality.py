"""Quality rules: base counts by hand, estimates against a plain loop."""
import math
import re

import numpy as np
import pytest

from quarry.llm import quality as Q
from tests.conftest import SF01


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = {x for x in tri if tri.count(x) > 1} if len(tri) < 400 else {x for x, c in __import__("collections").Counter(tri).items() if c > 1}
    rep = len({i + j for i, x in enumerate(tri) if x in many for j in range(3)})
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep, len(w) < 50 or 100 * rep > 50 * len(w)


def mcd(x, floor, core=Q.CORE):
    """The same estimate by plain loops: two starts, C-steps, reweighting."""
    f = np.diag(np.square(floor))

    def median(v):
        b = np.sort(np.array([math.floor(y * 1000 + 0.5) for y in v]))
        return b[(len(b) + 1) // 2 - 1] / 1000

    med = np.array([median(x[:, i]) for i in range(Q.P)])
    mad = np.array([median(np.abs(x[:, i] - med[i])) for i in range(Q.P)])

    def d2(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def step(m, c):
        b = np.floor(np.log2(d2(m, c) + 1e-9) * Q.BINS)
        cut = np.sort(b)[math.ceil(core * len(x)) - 1]
        y = x[b <= cut]
        return y.mean(0), np.cov(y.T, bias=True) * Q.consistency(core) + f

    best = None
    for c in (np.diag(np.square(1.4826 * mad)) + f, f):
        m = med
        for _ in range(3):
            m, c = step(m, c)
        if best is None or np.linalg.slogdet(c)[1] < np.linalg.slogdet(best[1])[1]:
            best = m, c
    m, c = best
    while True:
        m2, c2 = step(m, c)
        if np.linalg.slogdet(c)[1] - np.linalg.slogdet(c2)[1] <= Q.STILL:
            break
        m, c = m2, c2
    y = x[d2(m, c) <= Q._quantile(0.975, Q.P)]
    return y.mean(0), np.cov(y.T, bias=True).reshape(Q.P, Q.P) * Q.consistency(0.975) + f


def model(rows, min_group):
    """distance and kept of every row (lang, source, base_failed, x) by plain loops."""
    fit = [r for r in rows if not r[2]]
    count = lambda f: sum(1 for r in fit if f(r))
    known, out = {}, []
    for lang, source, failed, x in rows:
        if count(lambda r: r[:2] == (lang, source)) >= min_group:  # noqa: B023
            key, mine = (lang, source), lambda r: r[:2] == (lang, source)  # noqa: B023, E731
        elif count(lambda r: r[0] == lang) >= min_group:  # noqa: B023
            key, mine = (lang,), lambda r: r[0] == lang  # noqa: B023, E731
        else:
            key, mine = (), lambda r: True
        if key not in known:
            known[key] = mcd(np.array([r[3] for r in fit if mine(r)]), Q.FLOOR) if any(map(mine, fit)) else None
        if known[key] is None:
            out.append((None, not failed))
            continue
        m, c = known[key]
        d = float(np.sqrt(max(0.0, (x - m) @ np.linalg.inv(c) @ (x - m))))
        out.append((d, not failed and d <= Q.CUTOFF))
    return out


def test_base_counts(odd, empty):
    got = Q.quality(odd).collect()
    assert len(got) == odd.count()
    text = {r["doc_id"]: r["text"] for r in odd.where("doc_id is not null").collect()}
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(text[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"])
    assert Q.quality(empty).count() == 0 and Q.passing(empty).count() == 0
    assert Q.passing(odd).columns == odd.columns


def test_repeat_words_examples():
    for t in ("a b c a b c", "a a a a", "a b c d", "a b", "x y z q x y z x y z"):
        assert Q.repeat_words(t.encode().split()) == base(t)[4]


def test_consistency_factors():
    rng = np.random.default_rng(0)
    d = (rng.standard_normal((200_000, Q.P)) ** 2).sum(1)
    assert abs(np.mean(d <= Q._quantile(0.75, Q.P)) - 0.75) < 0.005
    inner = d[d <= Q._quantile(0.75, Q.P)]
    assert abs(Q.consistency(0.75) * inner.mean() / Q.P - 1) < 0.01


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet")


@pytest.mark.parametrize("min_group", [30, Q.MIN_GROUP])
def test_equals_plain_loops(documents, min_group):
    """Groups of their own, whole languages, and distances and verdicts of every row."""
    stats = Q.measured(documents).collect()
    by = {r["doc_id"]: r for r in Q.quality(documents, min_group=min_group).collect()}
    rows = [(r["lang"], r["source"], r["base_failed"], np.array([r[f"x{i}"] for i in range(Q.P)])) for r in stats]
    for r, (d, kept) in zip(stats, model(rows, min_group)):
        got = by[r["doc_id"]]
        assert math.isclose(got["distance"], d, rel_tol=0.02, abs_tol=0.02), r["doc_id"]
        assert got["kept"] == kept or abs(d - Q.CUTOFF) < 0.3
    assert len(by) == len(stats)


def test_small_tables_and_large_groups(table):
    """A table of under 50 documents is judged by its own estimate, a pair of 50
    and more by the pair's, rare pairs by their language's."""
    rng = np.random.RandomState(3)
    words = [f"w{i}" for i in range(400)]

    def doc(i, lang, source, odd=False):
        t = " ".join(words[j] for j in rng.randint(0, 400, 60 + i % 30))
        return (i, t.replace(" ", " #$%& ") if odd else t, lang, source)

    schema = "doc_id long, text string, lang string, source string"
    small = [doc(i, None if i % 3 else "en", "s") for i in range(44)] + [doc(44, "en", "t", True)]
    large = [doc(i, "en", "big") for i in range(60)] + [doc(100 + i, "en", f"s{i % 9}") for i in range(30)] + [doc(200, "fr", None), doc(201, "en", "s1", True)]
    for data, bad in ((small, 44), (large, 201)):
        docs = table(data, schema)
        stats = Q.measured(docs).collect()
        rows = [(r["lang"], r["source"], r["base_failed"], np.array([r[f"x{i}"] for i in range(Q.P)])) for r in stats]
        got = {r["doc_id"]: r for r in Q.quality(docs).collect()}
        for r, (d, kept) in zip(stats, model(rows, Q.MIN_GROUP)):
            assert math.isclose(got[r["doc_id"]]["distance"], d, rel_tol=0.02, abs_tol=0.02) and got[r["doc_id"]]["kept"] == kept
        assert [k for k, r in got.items() if not r["kept"]] == [bad]
    assert [r["distance"] for r in Q.quality(table([(1, "too short", "en", "s")], schema)).collect()] == [None]


def test_labels(spark, documents):
    """Held-out labels: junk goes, clean documents stay."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in Q.quality(documents).collect()}
    clean = [got[d] for d, q in labels.items() if q == 1 and not got[d]["base_failed"]]
    junk = [got[d] for d, q in labels.items() if q == 0]
    assert sum(r["kept"] for r in clean) / len(clean) > 0.99
    assert sum(not r["kept"] for r in junk) / len(junk) > 0.95
