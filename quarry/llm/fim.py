"""Fill-in-middle rewriting by content-defined chunk memoization.

A text is cut at two places, given in code points, into prefix, middle and
suffix, which are put in another order behind marks (``<P>``, ``<S>``,
``<M>``).  To place the cuts, and to learn whether a mark occurs in the text:

1. A rolling hash over the last 32 bytes (gear hash; computed for all places at
   once by doubling the window) cuts the text into chunks where its low bits
   are zero, so that equal passages of different documents give equal chunks.
2. Each task keeps the chunks it has met, by their content, in a cache of
   bounded size: a chunk's summary (its code points, whether a mark lies inside,
   and its last bytes) is computed once and found again by content, so that a
   hash collision can't hand out another chunk's summary.
3. Chunk counts are summed; the sums locate the chunk that holds a cut, and only
   that chunk is read to find the byte.  The ends of neighbouring chunks show
   marks that lie across a border.

A chunk may begin inside a character: it counts the characters that begin in it.

Scale.  One pass over the texts, no shuffle.  Beside a batch of texts a task
holds at most ``CACHE_BYTES`` of chunks; the cache changes the time, never a
result.

Defined cases: a null or empty text gives form plain and an empty output; a null
id is hashed as an empty string; repeated rows give the same output; an empty
table gives an empty result.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MARKS = (b"<P>", b"<S>", b"<M>")
SEED = 1
MOVED_PERCENT = 90  # of texts that can be cut
SPM_PERCENT = 20  # of these: suffix first
WINDOW = 32  # bytes, the width of the hash
SMALLEST, MASK_BITS, LARGEST = 64, 9, 4096  # bytes; a cut about every 2^9 bytes behind the smallest size
CACHE_BYTES = 32 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_GEAR = np.random.RandomState(20).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the last ``WINDOW`` bytes at every place."""
    h = _GEAR[data]
    w = 1
    with np.errstate(over="ignore"):
        while w < WINDOW:
            h[w:] += h[:-w] << np.uint32(w)  # the right side is computed before it is added
            w *= 2
    return h


def borders(data: np.ndarray) -> list[int]:
    """0, the ends of all chunks but the last, and the length."""
    n = len(data)
    out = [0]
    if n > SMALLEST:
        # the high bits depend on the whole window
        for c in (np.flatnonzero(rolling(data) >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist():
            while c - out[-1] > LARGEST:
                out.append(out[-1] + LARGEST)
            if c - out[-1] >= SMALLEST and c < n:
                out.append(c)
    while n - out[-1] > LARGEST:
        out.append(out[-1] + LARGEST)
    out.append(n)
    return out


def _starts(chunk: bytes) -> np.ndarray:
    """Whether a character begins at each byte."""
    return (np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80


class Summaries:
    """Summaries of chunks by content: (code points, a mark inside)."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.held, self.known, self.hits = limit, 0, {}, 0

    def of(self, chunk: bytes) -> tuple[int, bool]:
        got = self.known.get(chunk)
        if got is not None:
            self.hits += 1
            return got
        got = int(np.count_nonzero(_starts(chunk))), any(m in chunk for m in MARKS)
        if self.held > self.limit:
            self.known, self.held = {}, 0
        self.known[chunk] = got
        self.held += len(chunk) + 100
        return got


class Chunked:
    """A text by its chunks: code points, marks, and the byte of a code point."""

    def __init__(self, text: bytes, memo: Summaries):
        self.text, self.at = text, borders(np.frombuffer(text, np.uint8))
        self.before, self.marked, edge = [0], False, b""
        for a, b in zip(self.at, self.at[1:]):
            chunk = text[a:b]
            points, marked = memo.of(chunk)
            self.marked = self.marked or marked or any(m in edge + chunk[:2] for m in MARKS)
            self.before.append(self.before[-1] + points)
            edge = (edge + chunk[-2:])[-2:]

    @property
    def points(self) -> int:
        return self.before[-1]

    def byte(self, point: int) -> int:
        if point >= self.points:
            return len(self.text)
        i = bisect_right(self.before, point) - 1
        inside = np.flatnonzero(_starts(self.text[self.at[i]:self.at[i + 1]]))
        return self.at[i] + int(inside[point - self.before[i]])


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers for a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in range(0, 32, 8)]


def transform(doc_id: int | None, text: bytes, memo: Summaries, seed: int, moved: int, spm: int) -> tuple:
    """n, form, prefix_chars, middle_chars, output (bytes) of one text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    c = Chunked(text, memo)
    n = c.points
    if not n or c.marked or h3 % 100 >= moved:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = c.byte(lo), c.byte(hi)
    p, s, m = MARKS
    if h4 % 100 < spm:
        return n, "spm", lo, hi - lo, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", lo, hi - lo, b"".join((p, text[:a], s, text[b:], m, text[a:b]))


def _rewrite(seed: int, moved: int, spm: int):
    def fn(batches):
        memo = Summaries()
        for batch in batches:
            doc, text = batch.column("doc_id"), batch.column("text")
            for i in range(0, batch.num_rows, 128):
                ids = doc[i:i + 128]
                got = [transform(d, t, memo, seed, moved, spm) for d, t in zip(ids.to_pylist(), text[i:i + 128].to_pylist())]
                n, form, prefix, middle, out = zip(*got)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(out, pa.binary())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return fn


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   moved_percent: int = MOVED_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (code points), form (plain, psm, spm), prefix_chars,
    middle_chars (null if plain), output for every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    raw = src.mapInArrow(_rewrite(seed, moved_percent, spm_percent), SCHEMA.replace("output string", "output binary"))
    return raw.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    part = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))
