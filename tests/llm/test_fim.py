"""Fill-in-middle: cuts by chunks against plain string slices; round trips; odd tables."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import fim


def _plain(doc_id, text):
    """The contract, on a Python string."""
    h1, h2, h3, h4 = fim.draws(doc_id)
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, m, z = text[:lo], text[lo:hi], text[hi:]
    if h4 % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{z}<P>{a}<M>{m}"
    return n, "psm", lo, hi - lo, f"<P>{a}<S>{z}<M>{m}"


def _texts():
    r = random.Random(4)
    alphabet = "abc é🙂\n漢<PSM>́"
    for n in [*range(1, 12), 63, 64, 65, 66, 127, 500, 4095, 4096, 4097, 20_000]:
        yield "".join(r.choice(alphabet) for _ in range(n))
    yield "a" * 30_000
    yield "🙂" * 9_000
    passage = "".join(r.choice("abcdefgh ") for _ in range(6_000))
    for _ in range(8):
        yield "".join(r.choice("xyz ") for _ in range(r.randrange(400))) + passage + "end"


def test_equals_slices():
    memo = fim.Summaries()
    for i, t in enumerate(_texts()):
        t = t.replace("<P>", "<p>").replace("<S>", "<s>").replace("<M>", "<m>") if i % 2 else t
        n, form, p, m, out = fim.transform(i, t.encode(), memo, fim.SEED, 90, 20)
        assert (n, form, p, m, out.decode()) == _plain(i, t)
    assert memo.hits > 50  # the passage that texts share is summarised once


def test_every_code_point_is_found():
    for t in _texts():
        c = fim.Chunked(t.encode(), fim.Summaries())
        for k in {0, 1, len(t) // 3, len(t) // 2, len(t) - 1, len(t), *(c.before)}:
            assert c.byte(k) == len(t[:k].encode())
        assert c.points == len(t)


def test_rolling_hash_and_borders():
    data = np.frombuffer(("the quick brown fox " * 900).encode(), np.uint8)
    h = fim.rolling(data)
    for i in (0, 1, 31, 32, 500):
        v = 0
        for x in data[max(0, i - 40):i + 1]:
            v = (2 * v + int(fim._GEAR[x])) & 0xFFFFFFFF
        assert int(h[i]) == v
    at = fim.borders(data)
    assert at[0] == 0 and at[-1] == len(data) and all(0 < b - a <= fim.LARGEST for a, b in zip(at, at[1:]))


def test_marks_across_chunk_borders():
    """A mark is seen wherever the chunks' borders fall."""
    r = random.Random(7)
    body = "".join(r.choice("abcdefgh ") for _ in range(3_000))
    for b in fim.borders(np.frombuffer(body.encode(), np.uint8))[1:-1]:
        for shift in (0, 1, 2, 3):
            t = body[:b - shift] + "<S>" + body[b - shift:]
            assert fim.Chunked(t.encode(), fim.Summaries()).marked
            assert not fim.Chunked(t.replace("<S>", "<S <S").encode(), fim.Summaries()).marked


def test_small_cache_changes_nothing():
    for t in _texts():
        a = fim.transform(5, t.encode(), fim.Summaries(), 1, 90, 20)
        memo = fim.Summaries(limit=0)
        assert [fim.transform(5, t.encode(), memo, 1, 90, 20) for _ in range(2)] == [a, a]


def test_odd_rows(odd, empty):
    got = fim.fill_in_middle(odd).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted([(r.doc_id, *_plain(r.doc_id, r.text or "")) for r in odd.collect()], key=repr)
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=repr) == want
    assert sorted(r.back for r in got) == sorted((r.text or "") for r in odd.collect())
    assert fim.fill_in_middle(empty).count() == 0


@pytest.mark.parametrize("moved, spm, forms", [(0, 50, {"plain"}), (100, 0, {"psm"}), (100, 100, {"spm"})])
def test_rates(table, moved, spm, forms):
    rows = table([(i, f"some words in text {i}") for i in range(50)], "doc_id long, text string")
    out = fim.fill_in_middle(rows, moved_percent=moved, spm_percent=spm)
    assert {r.form for r in out.collect()} == forms
