"""Packing: exact cover, the tokenizer's ids, little padding."""
import random
import zlib

import numpy as np
import pytest

from quarry.llm import packing as P
from tests.conftest import SF001


@pytest.fixture(scope="module")
def slow():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def verify(docs, slow, capacity):
    rows = docs.select("doc_id", "text").collect()
    want = sorted(tuple([*slow(r["text"]), P.END_ID]) for r in rows)
    pieces = P.pack(docs, capacity=capacity, keep_ids=True).collect()
    by_seq, total = {}, 0
    for p in pieces:
        ids = np.array(p["ids"], "<u4")
        assert p["length"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids.tobytes())
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        total += p["length"]
    for s in by_seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    starts = {}
    for p in pieces:
        starts.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["ids"]))
    assert total == sum(map(len, want))
    if len({r["doc_id"] for r in rows}) == len(rows):
        got = []
        for (_, n), s in starts.items():
            ids = [i for _, x in sorted(s) for i in x]
            assert len(ids) == n and all(a % (capacity // 2) == 0 for a, _ in s)
            got.append(tuple(ids))
        assert sorted(got) == want
    return len(by_seq) * capacity, total


def test_documents(spark, slow):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    room, used = verify(docs, slow, 1024)
    assert room - used < 1024
    room, used = verify(docs, slow, 64)
    assert room - used < 64


def test_odd_rows(odd, empty, slow):
    verify(odd, slow, 1024)
    assert P.pack(empty).count() == 0


def test_ids_equal_the_tokenizer(slow):
    rng = random.Random(1)
    encode = P.encoder()
    alphabet = ["a", "é", "🙂", " ", "\n", " ", "　", "'s", "1", "\x00", "ß", "ſ", "<|endoftext|>", "۳", "Ⅷ", "́", "中", "_", "\t"]
    for _ in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(14)))
        assert encode(t) == slow(t), repr(t)


def test_best_fill():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        cap = rng.randrange(0, 60)
        totals = {0}
        for n, c in counts.items():
            totals = {t + k * n for t in totals for k in range(c + 1) if t + k * n <= cap}
        used = P.best_fill(sorted(counts, reverse=True), counts, cap)
        assert sum(n * q for n, q in used.items()) == max(totals) and all(q <= counts[n] for n, q in used.items())


def test_plan_covers_histogram():
    rng = random.Random(3)
    hist = {n: rng.randrange(1, 3000) for n in rng.sample(range(1, 1024), 600)}
    rows = P.plan_windows(hist, 1024)
    seen, fill = {}, {}
    for n, lo, hi, q, window, at in rows:
        assert (hi - lo) % q == 0 and at + q * n <= 1024
        seen.setdefault(n, []).append((lo, hi))
        fill[window] = (fill.get(window, (0, 0))[0] + n * q, (hi - lo) // q)
    for n, c in hist.items():
        spans = sorted(seen[n])
        assert spans[0][0] == 0 and spans[-1][1] == c and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    windows, used = sum(k for _, k in fill.values()), sum(n * c for n, c in hist.items())
    assert used == sum(f * k for f, k in fill.values())
    # lengths over 512 need a window each; few windows more than the lower bound
    assert windows <= 1.005 * max(used / 1024, sum(c for n, c in hist.items() if n > 512)) and len(rows) < 60_000


def test_sequences(odd):
    got = P.sequences(P.pack(odd, capacity=16, keep_ids=True), capacity=16).collect()
    for r in got:
        assert len(r["input_ids"]) == (r["n_tokens"] if r["n_tokens"] & (r["n_tokens"] - 1) == 0 else 16)


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "\u3000" * 300_000, "a b" + " " * 20_000 + "c", (" " * 9_998 + "x") * 5])
def test_long_white_space(slow, text):
    """Runs that the fast encoder can't take, and runs just below them."""
    assert P.encoder()(text) == slow(text)
