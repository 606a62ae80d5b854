"""Packing by minimum bin slack.

Documents are tokenised where they are read and cut into pieces of
``capacity`` tokens; only the remainder of a document (shorter than that, cut
again if longer than half) has to be packed.  What matters for packing is the number of remainders of each
length, a table of fewer than ``capacity`` rows whatever the corpus.  On that
table the slack of one window after the other is minimised: the longest
remaining length is set, then a subset-sum dynamic programme over a bitset
(bit s: total s can be reached with the lengths left, each at most as often as
it is left) finds the fullest window; back-tracking through the layers gives
the counts.  The pattern is repeated while all its lengths last, so there are
only some thousand patterns.  Pieces then find their window by their rank
among the remainders of their length.

``pack_groups`` packs documents that have an order: each of their groups (a
stretch of the order) gets windows of its own, and ``sequence_id`` follows the
groups.

Scale.  Tokens never move: shuffled are (partition, length) counts and one row
of integers a piece.  The driver sees the length histogram only.  With
groups, each group's histogram is planned in a task of its own and its pieces
are ranked there, so groups should be of bounded size.

Defined cases: a null text is empty and gives the single end id; repeated rows
and null ids are packed like others; an empty table gives an empty result.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import with_uid, written

CAPACITY = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
LONG_SPACE = 10_000
_LONG_RUN = re.compile(rf"(?<!\s)\s{{{LONG_SPACE}}}")  # entered at the start of a run only

_LOADED: dict[str, tuple] = {}


def encoder(vocabulary: str = VOCABULARY):
    """text -> ids of ``<vocabulary>.json`` without added special tokens.

    The .tiktoken file holds the same vocabulary and gives the same ids some
    five times faster; its recursion overflows on long runs of white space.  So
    texts with a run of ``LONG_SPACE`` white-space characters, and those with the
    special token's own string, which has an id, go through the .json tokenizer."""
    if vocabulary not in _LOADED:
        import base64

        import public_tokenizers as P
        import tiktoken
        with open(P.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(vocabulary, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _LOADED[vocabulary] = (fast, P.path(f"{vocabulary}.json"), [])
    fast, slow_path, slow = _LOADED[vocabulary]

    def encode(text: str) -> list[int]:
        if SPECIAL in text or _LONG_RUN.search(text):
            if not slow:
                from tokenizers import Tokenizer
                slow.append(Tokenizer.from_file(slow_path))
            return slow[0].encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Whole windows, then a remainder; one longer than half a window is cut
    there, so that it needs no partner of one exact length."""
    half = capacity // 2
    edges = [*range(0, n, capacity)]
    if half and n - edges[-1] > half and n - edges[-1] < capacity:
        edges.append(edges[-1] + half)
    return list(zip(edges, [*edges[1:], n]))


PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
         "part long, nth long, ids array<int>")


def _cut(capacity: int, vocabulary: str, keep_ids: bool):
    def fn(batches):
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in batches:
            doc, text = b.column("doc_id").to_pylist(), b.column("text")
            for i in range(0, b.num_rows, 128):
                rows = []
                for d, t in zip(doc[i:i + 128], text[i:i + 128].to_pylist()):
                    ids = np.array([*encode(t or ""), END_ID], "<u4")
                    for s, e in cuts(len(ids), capacity):
                        p = ids[s:e]
                        rows.append((d, s, len(p), zlib.crc32(p.tobytes()), len(ids), part, seen[len(p)],
                                     p.astype(np.int32) if keep_ids else None))
                        seen[len(p)] += 1
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.list_(pa.int32()))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", "ids"])
    return fn


def best_fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of lengths with the largest total up to ``capacity``."""
    mask, reach, layers = (1 << (capacity + 1)) - 1, 1, []
    for n in lengths:
        layers.append((n, reach))
        left, take = min(counts[n], capacity // n), 1
        while left > 0:
            step = min(take, left)
            reach |= (reach << (step * n)) & mask
            left -= step
            take *= 2
        if reach >> capacity & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for n, before in reversed(layers):
        q = 0
        while not before >> at & 1:
            at -= n
            q += 1
        if q:
            used[n] = q
    return used


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple]:
    """Rows (length, first rank, end rank, pieces of it in a window, first
    window, offset in the window) for remainders counted by length."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    start = dict.fromkeys(counts, 0)
    rows, window = [], 0
    while counts:
        top = max(counts)
        counts[top] -= 1
        lengths = sorted((n for n, c in counts.items() if c and n <= capacity - top), reverse=True)
        used = best_fill(lengths, counts, capacity - top)
        counts[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(counts[n] // q for n, q in used.items())
        offset = 0
        for n, q in sorted(used.items(), reverse=True):
            rows.append((n, start[n], start[n] + times * q, q, window, offset))
            offset += n * q
            start[n] += times * q
            counts[n] -= times * q
            if not counts[n]:
                del counts[n]
        window += times
    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and
    (``keep_ids``) the ids of every piece."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = written(src.mapInArrow(_cut(capacity, vocabulary, keep_ids), PIECE), "pieces")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    whole = (pieces.where(F.col("length") == capacity)
             .withColumn("sequence_id", (F.col("part") * F.lit(1 << 32) + F.col("nth")) * 2 + 1)
             .withColumn("offset", F.lit(0).cast("long")))
    rest = pieces.where(F.col("length") < capacity)
    per_part = rest.groupBy("part", "length").agg(F.count("*").alias("c"))
    # fewer than ``capacity`` rows
    histogram = {r["length"]: r["c"] for r in per_part.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    rows = plan_windows(histogram, capacity)
    if not rows:
        return whole.select(*out)
    layout = spark.createDataFrame(rows, "length long, lo long, hi long, q long, window long, at long")
    from pyspark.sql import Window
    # one row for each partition and length
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", "length", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("base"))
    ranked = rest.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = (ranked.join(F.broadcast(layout), "length").where("rank >= lo and rank < hi")
              .withColumn("sequence_id", (F.col("window") + F.expr("(rank - lo) div q")) * 2)
              .withColumn("offset", F.expr("at + (rank - lo) % q * length")))
    return whole.select(*out).unionByName(placed.select(*out))


LAYOUT = "grp long, length long, lo long, hi long, q long, window long, at long"
GROUP_BITS = 36  # of a sequence_id below the group's number


def _cut_rows(capacity: int, vocabulary: str):
    """Pieces with the row number of their document; no ids."""
    def fn(batches):
        encode = encoder(vocabulary)
        for b in batches:
            uid, doc, text = b.column("uid").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")
            for i in range(0, b.num_rows, 128):
                rows = []
                for u, d, t in zip(uid[i:i + 128], doc[i:i + 128], text[i:i + 128].to_pylist()):
                    ids = np.array([*encode(t or ""), END_ID], "<u4")
                    rows += [(u, d, s, e - s, zlib.crc32(ids[s:e].tobytes()), len(ids)) for s, e in cuts(len(ids), capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 names=["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return fn


def pack_groups(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack`` with windows filled within each group; ``groups`` has uid (the
    number that ``with_uid`` gives the rows of ``docs``) and grp, from 0 on,
    for every row.  The group is ``sequence_id`` shifted by ``GROUP_BITS``."""
    from pyspark.sql import Window
    src = with_uid(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    cut = src.mapInArrow(_cut_rows(capacity, vocabulary), "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = written(written(cut, "cut").join(groups.select("uid", "grp"), "uid"), "pieces")

    def plan(key, pdf):
        import pandas as pd
        rows = plan_windows(dict(zip(pdf["length"].tolist(), pdf["c"].tolist())), capacity)
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["grp", "length", "lo", "hi", "q", "window", "at"])

    rest = F.col("length") < capacity
    layout = written(pieces.where(rest).groupBy("grp", "length").agg(F.count("*").alias("c")).groupBy("grp").applyInPandas(plan, LAYOUT), "layout")
    rank = F.row_number().over(Window.partitionBy("grp", "length").orderBy("uid", "start")) - 1
    ranked = pieces.withColumn("rank", rank.cast("long"))
    first = F.shiftleft(F.col("grp").cast("long"), GROUP_BITS)
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = ranked.where(~rest).withColumn("sequence_id", first + F.col("rank") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    placed = (ranked.where(rest).join(layout.hint("merge"), ["grp", "length"]).where("rank >= lo and rank < hi")
              .withColumn("sequence_id", first + (F.col("window") + F.expr("(rank - lo) div q")) * 2)
              .withColumn("offset", F.expr("at + (rank - lo) % q * length")))
    return whole.select(*out).unionByName(placed.select(*out))


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """sequence_id, input_ids, n_tokens from ``pack(..., keep_ids=True)``:
    padded to ``capacity`` unless the tokens number a power of two."""
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    got = pieces.groupBy("sequence_id").agg(ids.alias("ids"))
    n = F.size("ids")
    pad = F.when(F.bit_count(n) == 1, F.lit(0)).otherwise(F.lit(capacity) - n)
    return got.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), pad)).alias("input_ids"),
                      n.cast("long").alias("n_tokens"))
