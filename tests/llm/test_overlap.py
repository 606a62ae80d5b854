"""T-occurrence search against all pairs, DivideSkip's merge against counts, odd tables."""
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import overlap as O


def _set(text, k=5):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).split() if text else []
    return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({" ".join(w)} if w else set())


def _links(texts, percent=80, k=5):
    sets = [_set(t, k) for t in texts]
    return sets, {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j]
                  and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}


def _components(n, links):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for i in range(n):
        if i not in out:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = i
                    todo += near[x]
    return out


def _family(r, base, copies, edits):
    out = [base]
    for _ in range(copies):
        w = list(r.choice(out) if r.random() < .3 else base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"x{r.randrange(10 ** 6)}"
        out.append(w)
    return out


def _corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for size in (6, 12, 40, 90, 200, 400):
        for _ in range(3):
            texts += _family(r, [word() for _ in range(size)], 9, max(1, size // 25))
    texts += [[word() for _ in range(r.randrange(5, 120))] + passage + [word() for _ in range(r.randrange(40))] for _ in range(60)]
    texts += [[word() for _ in range(r.randrange(1, 6))] for _ in range(40)] + [["same"] * 30, ["same"] * 50, ["One", "two"], ["one", "TWO"]]
    texts += _family(r, [word() for _ in range(120)], 60, 6)  # about the threshold
    texts = [" ".join(t) for t in texts]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, percent", [(1, 80), (2, 80), (3, 60), (4, 95)])
def test_groups_equal_all_pairs(table, seed, percent):
    texts = _corpus(seed)
    sets, links = _links(texts, percent)
    got = O.overlap_groups(table([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), percent=percent).collect()
    want = _components(len(texts), links)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in want}
    assert len(links) > 100


def test_join_gives_every_link(table):
    texts = _corpus(5)
    sets, links = _links(texts)
    pairs, members = O.jaccard_join(table([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    docs = defaultdict(list)
    for m in members.collect():
        docs[m.node].append(m.doc_id)
    got = {}
    for p in pairs.collect():
        assert p.node_a < p.node_b
        for x in docs[p.node_a]:
            for y in docs[p.node_b]:
                got[min(x, y), max(x, y)] = p.shared
    inside = {(x, y) for d in docs.values() for x in d for y in d if x < y and sets[x]}
    assert set(got) | inside == links
    assert all(k == len(sets[a] & sets[b]) for (a, b), k in got.items())


def test_merge_skip_counts():
    r = random.Random(2)
    for _ in range(2000):
        lists = [sorted(r.sample(range(40), r.randrange(0, 20))) for _ in range(r.randrange(1, 9))]
        for t in range(1, len(lists) + 1):
            counts = Counter(x for s in lists for x in s)
            assert O.merge_skip(lists, t) == sorted((x, c) for x, c in counts.items() if c >= t)


def test_probes():
    r = np.random.RandomState(1)
    for _ in range(300):
        a, b = (np.unique(r.randint(0, 50, r.randint(1, 30))).astype(np.uint64) for _ in range(2))
        assert O.probes(a, b) == len(set(a) & set(b))


def test_heads_hold_the_first_common_items():
    """The first x common items of two linked sets lie in both heads."""
    r = random.Random(3)
    for _ in range(3000):
        percent, n = r.choice([50, 80, 90]), r.randrange(1, 90)
        a = set(r.sample(range(1000), n))
        b = set(r.sample(sorted(a), max(1, n - r.randrange(n // 5 + 1)))) | set(r.sample(range(1000, 1100), r.randrange(n // 6 + 1)))
        if 100 * len(a & b) < percent * len(a | b):
            continue
        small = min(len(a), len(b))
        order = {x: r.random() for x in a | b}
        for extra in (O.SURVEY, O.SEARCH):
            heads = [set(sorted(s, key=order.get)[:O.head_size(len(s), percent, extra)]) for s in (a, b)]
            assert len(heads[0] & heads[1]) >= max(1, small // extra)


def test_bitmaps_bound_the_difference():
    r = np.random.RandomState(2)
    for n in (1, 5, 80, 900, 5000):
        pool = r.randint(0, 1 << 62, 2 * n).astype(np.uint64) * np.uint64(3)
        a, b = (np.unique(r.choice(pool, n)) for _ in range(2))
        x, y = O.bitmap(a), O.bitmap(b)
        assert len(x) == O.BITS // 64
        differ = sum(bin(int(i) & (1 << 64) - 1).count("1") for i in x ^ y)
        short = sum(bin(int(i) & (1 << 64) - 1).count("1") for i in O.folded(x) ^ O.folded(y))
        assert short <= differ <= len(set(a) ^ set(b))


def test_odd_rows(odd, empty):
    rows = odd.collect()
    got = O.overlap_groups(odd)
    assert got.columns == ["uid", "doc_id", "n_shingles", "component_id"]
    out = got.collect()
    assert sorted((r.doc_id, r.n_shingles) for r in out if r.doc_id is not None) == sorted(
        (r.doc_id, len(_set(r.text))) for r in rows if r.doc_id is not None)
    assert len(out) == len(rows)
    by = {r.doc_id: r.component_id for r in out}
    assert by[5] == by[6] == 5 and by[0] == 0 and by[1] == 1 and by[7] == 7
    assert O.overlap_groups(empty).count() == 0
    pairs, members = O.jaccard_join(empty)
    assert pairs.count() == 0 and members.count() == 0


def test_blocks_of_lists_change_nothing(table, monkeypatch):
    texts = _corpus(6)[:250]
    _, links = _links(texts)
    monkeypatch.setattr(O, "LIST", 3)
    got = O.overlap_groups(table([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == _components(len(texts), links)


def test_lists_meet_like_a_plain_loop(monkeypatch):
    """Cells over several batches and slices of pairs; every pair of two labels once."""
    import pyarrow as pa
    monkeypatch.setattr(O, "PAIRS", 50)
    r = np.random.RandomState(5)
    rows, want = [], set()
    for item in range(12):
        blocks = 4 if item % 3 == 0 else 1
        own = [(int(x), int(r.randint(8, 13)), int(r.randint(0, 4)), int(r.randint(0, 3)), r.randint(0, 2, 8)) for x in r.choice(500, 30, replace=False)]
        for node, n, label, t, mark in own:
            for other in range(blocks):
                b = node % blocks
                rows.append((item, min(b, other), max(b, other), b, node, n, label, t, node % 8, mark))
        for q, nq, lq, t, mq in own:
            for o, no, lo, _, mo in own:
                most = (nq + no - sum(int(x ^ y).bit_count() for x, y in zip(mq, mo))) // 2
                if t and lq != lo and o > q and min(nq, no) * 100 >= max(nq, no) * 80 and 100 * most >= 80 * (nq + no - most):
                    want.add((item, q, o % 8, t, o))
    rows.sort(key=lambda x: (x[0], x[1], x[2], x[6]))
    names = ["item", "lo", "hi", "part", "node", "n", "label", "t", "blk", "mark"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    whole = pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)
    got = [(q, blk, t, o) for b in O._meet(80)([whole.slice(i, 37) for i in range(0, len(rows), 37)])
           for q, blk, t, held in zip(*(b.column(c).to_pylist() for c in ("q", "blk", "t", "held"))) for o in held]
    assert want and sorted(got) == sorted(x[1:] for x in want)
