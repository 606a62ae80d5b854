"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Each text gives the set of its distinct ``shingle``-word windows (words are
   runs without ASCII white space, A-Z lower-cased; fewer words give one
   window).  Texts with the same set are one class at once.
2. ``bands`` bucket keys of ``rows`` minima each; of ``lanes`` minima the
   lowest ``BITS`` bits are kept, 16 to a 64-bit word.
3. Members of a bucket are first compared with its most central member only.
   The classes found are contracted, buckets of one class are done.  A member
   of the others needs enough items that some other open set has too (else no
   intersection is large enough).  While many pairs of different classes are
   left, members meet four, sixteen, ... pivots; then all pairs of different
   classes are compared, each in the first bucket they share.  So no bucket is
   cut short, and a group of copies never meets all with all.  A pair reaches
   step 4 if the share of equal b-bit minima, corrected for chance collisions,
   is within four standard errors of the threshold.
4. Pairs are confirmed on their full sets; classes are connected components.

At similarity 0.8 the chance that a pair shares none of 30 bands of 5 is 7e-6,
and 3e-5 that the estimate falls short.

Scale.  Set signatures (about 0.3 KB a document) and bucket keys are shuffled;
texts never are.  Exact copies collapse before bucketing, sets are rebuilt only
for documents in confirmed-size candidate pairs.

Defined cases: null, empty and wordless texts have an empty set, link with
nothing and stay; repeated rows are copies (the first of equal ids stays); an
empty table gives an empty result.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import sized, with_uid, written

BITS = 4
LANES = 16  # lanes of BITS bits in one 64-bit word
BANDS, ROWS = 30, 5
LANES_KEPT = 384  # minima of which the low bits are kept
EACH = 64  # signature comparisons that a bucket member may take before more pivots are tried


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _constants(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word windows of each text."""
    mult = _constants(k, 11) | np.uint64(1)
    known: dict[bytes, int] = {}
    out, digest = [], xxhash.xxh64_intdigest
    for t in texts:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        if not w:
            out.append(np.empty(0, np.uint64))
            continue
        if len(known) > 1_000_000:  # only a cache of hashes
            known.clear()
        h = np.empty(len(w), np.uint64)
        for i, x in enumerate(w):
            v = known.get(x)
            if v is None:
                v = known[x] = digest(x)
            h[i] = v
        m = len(w) - k + 1
        with np.errstate(over="ignore"):
            if m <= 0:
                s = np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=7)], np.uint64)
            else:
                s = np.zeros(m, np.uint64)
                for j in range(k):
                    s += h[j:j + m] * mult[j]
                s = _mix(s)
        out.append(np.unique(s))
    return out


def minima(s: np.ndarray, n: int) -> np.ndarray:
    """n minima of the set under n multiply-add permutations of 32 bits."""
    a = (_constants(n, 23) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    b = (_constants(n, 37) >> np.uint64(32)).astype(np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 256):
            c = x[i:i + 256, None] * a[None, :]
            c += b
            np.minimum(best, c.min(axis=0), out=best)
    return best.astype(np.uint64)


def band_keys(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    mult = _constants(bands * rows, 53) | np.uint64(1)
    with np.errstate(over="ignore"):
        return _mix((_mix(m) * mult).reshape(bands, rows).sum(axis=1, dtype=np.uint64))


def pack_bits(m: np.ndarray) -> np.ndarray:
    """Low BITS bits of each minimum, LANES to a word (the rest zero)."""
    low = _mix(m) & np.uint64((1 << BITS) - 1)
    words = -(-len(m) // LANES)
    low = np.concatenate([low, np.zeros(words * LANES - len(m), np.uint64)]).reshape(words, LANES)
    return (low << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def _sign(k: int, bands: int, rows: int, lanes: int):
    def fn(batches):
        for b in batches:
            uid, doc, texts = b.column("uid"), b.column("doc_id"), b.column("text")
            for i in range(0, b.num_rows, 256):
                sets = shingle_sets(texts[i:i + 256].to_pylist(), k)
                sig, key, cell = [], [], []
                for s in sets:
                    m = minima(s, max(lanes, bands * rows))
                    sig.append(pack_bits(m[:lanes]).view(np.int64))
                    cell.append(band_keys(m[:bands * rows], bands, rows).view(np.int64))
                    key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                yield pa.RecordBatch.from_arrays(
                    [uid[i:i + 256], doc[i:i + 256], pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()),
                     pa.array(sig, pa.list_(pa.int64())), pa.array(cell, pa.list_(pa.int64()))],
                    names=["uid", "doc_id", "n", "key", "sig", "cells"])
    return fn


def _sets(k: int):
    def fn(batches):
        for b in batches:
            node, texts = b.column("node"), b.column("text")
            for i in range(0, b.num_rows, 256):
                sets = shingle_sets(texts[i:i + 256].to_pylist(), k)
                yield pa.RecordBatch.from_arrays(
                    [node[i:i + 256], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["node", "items"])
    return fn


def estimate(a, b, lanes: int):
    """Similarity from two packed signatures: equal lanes by bit counts, less
    the 2^-BITS of unequal minima that agree by chance."""
    ones = int("1" * LANES, 16)
    differ = F.lit(0)
    for i in range(-(-lanes // LANES)):
        x = a[i].bitwiseXOR(b[i])
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        y = y.bitwiseOR(F.shiftrightunsigned(y, 2)).bitwiseAND(F.lit(ones))
        differ = differ + F.bit_count(y)
    chance = 1 / (1 << BITS)
    return ((F.lit(1.0) - differ / F.lit(lanes)) - chance) / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) of every node in an edge.

    Every label hooks to the smallest label next to it, chains of hooks are
    halved until they end at a root, and only edges between different labels
    go on, so the labels at least halve each time.  Tables that are small
    enough are broadcast, larger ones shuffled."""
    edge = written(edges.toDF("u", "v").where("u <> v").distinct(), "edges")
    label = written(edge.select(F.col("u").alias("node")).union(edge.select("v")).distinct()
                    .withColumn("label", F.col("node")), "labels")
    while True:
        at = lambda x: sized(label.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")), 16)  # noqa: B023, E731
        edge = written(edge.select("u", "v").join(at("u"), "u").join(at("v"), "v").where("lu <> lv"), "edges")
        hook = written(edge.groupBy(F.greatest("lu", "lv").alias("hi")).agg(F.min(F.least("lu", "lv")).alias("lo")), "hooks")
        if hook.isEmpty():
            return label
        while True:
            up = sized(hook.select(F.col("hi").alias("lo"), F.col("lo").alias("next")), 16)
            far = written(hook.join(up, "lo", "left"), "hooks")
            hook = far.select("hi", F.coalesce("next", "lo").alias("lo"))
            if far.where("next is not null").isEmpty():
                break
        label = written(label.join(sized(hook.withColumnRenamed("hi", "label"), 16), "label", "left")
                        .select("node", F.coalesce("lo", "label").alias("label")), "labels")


def _unshared(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, alone: how many of a set's items no other set of ``nodes`` has."""
    items = sets.join(sized(nodes, 16), "node").select("node", F.explode("items").alias("item"))
    once = items.groupBy("item").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    return once.groupBy("node").agg(F.count("*").alias("alone"))


def _classes(src: DataFrame, nodes: DataFrame, shingle: int, percent: int, lanes: int) -> DataFrame | None:
    """node, label of all nodes in a link (None without any pair to test)."""
    cells = nodes.select("node", F.posexplode("cells").alias("band", "cell")).select("node", "band", F.xxhash64("band", "cell").alias("cell"))
    full = written(cells.groupBy("cell").agg(F.count("*").alias("c")).where("c > 1"), "cells")
    shared = written(cells.join(full.hint("merge"), "cell"), "shared")
    # centrality of a node: the sizes of its buckets
    weight = shared.groupBy("node").agg(F.sum("c").alias("score"))
    member = written(shared.join(nodes.select("node", "n", "sig").join(weight, "node"), "node")
                     .select("cell", "band", "node", "score", "n", "sig"), "members")
    size = member.count()
    if not size:
        return None
    used = written(member.select("node").distinct(), "used")
    wanted = src.join(sized(used.withColumnRenamed("node", "uid"), 16), "uid", "left_semi")
    sets = written(wanted.select(F.col("uid").alias("node"), "text").mapInArrow(_sets(shingle), "node long, items array<long>"), "sets")
    most = full.agg(F.max("c")).first()[0]
    p = percent / 100
    near = p - 4 * (p * (1 - p) / lanes) ** 0.5

    def pairs_of(now: DataFrame, pivot: DataFrame, everyone: bool) -> DataFrame:
        fields = ("node", "n", "sig", "label", "e", *(["cells"] if everyone else []))
        a = pivot.select("cell", *[F.col(c).alias(f"{c}_a") for c in fields])
        b = now.select("cell", "band", *[F.col(c).alias(f"{c}_b") for c in fields])
        common = F.least("e_a", "e_b")  # no intersection is larger
        hit = ((F.col("label_a") < F.col("label_b")) if everyone else (F.col("label_a") != F.col("label_b")))
        hit = (hit & (common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent)
               & (estimate(F.col("sig_a"), F.col("sig_b"), lanes) >= near))
        if everyone:  # once, in the first bucket that the two share
            same = F.zip_with("cells_a", "cells_b", lambda x, y: x == y)
            hit = hit & (F.array_position(same, True) == F.col("band") + 1)
        return written(b.join(a, "cell").where(hit).select(
            F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("label_a").alias("la"), F.col("label_b").alias("lb")).distinct(), "pairs")

    def links_of(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a")
                .join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b"))
        k = F.size(F.array_intersect("ia", "ib"))
        return written(both.where(k * 100 >= (F.size("ia") + F.size("ib") - k) * percent).select("la", "lb"), "links")

    def central(now: DataFrame, slots: int) -> DataFrame:
        slot = F.pmod(F.xxhash64("node", F.lit(slots)), F.lit(slots))
        return (now.groupBy("cell", slot.alias("slot"))
                .agg(F.max_by(F.struct("node", "n", "sig", "label", "e"), F.struct("score", -F.col("node"))).alias("x"))
                .select("cell", "x.*"))

    first = member.withColumn("label", F.col("node")).withColumn("e", F.col("n"))
    label, alone, slots = components(links_of(pairs_of(first, central(first, 1), False))), None, 4
    while True:
        now = member.join(sized(label, 16), "node", "left").withColumn("label", F.coalesce("label", "node"))
        span = now.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("cell")
        now = written(now.join(sized(written(span, "span"), 8), "cell"), "open")
        if alone is None:
            alone = written(_unshared(sets, written(now.select("node").distinct(), "open-nodes")), "alone")
        # items that no other open set has can't be in an intersection
        now = now.join(sized(alone, 16), "node", "left").withColumn("e", F.col("n") - F.coalesce("alone", F.lit(0)))
        now = written(now.where(F.col("e") * 100 >= F.col("n") * percent).drop("alone"), "open")
        left = now.groupBy("cell", "label").agg(F.count("*").alias("k")).groupBy("cell").agg(
            ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("x")).agg(F.sum("x")).first()[0] or 0
        if not left:
            return label
        last = left <= EACH * size or slots >= most
        if last:
            now = now.join(nodes.select("node", "cells"), "node")
        pairs = pairs_of(now, now if last else central(now, slots), last)
        merged = components(links_of(pairs))
        moved = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
        known = label.unionByName(merged.select("node", F.col("node").alias("label")).join(sized(label.select("node"), 16), "node", "left_anti"))
        label = written(known.join(sized(moved, 16), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        if last:
            return label
        slots *= 4


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                percent: int = 80, bands: int = BANDS, rows: int = ROWS, lanes: int = LANES_KEPT) -> DataFrame:
    """uid, doc_id, n_shingles, component_id, kept for every row of ``docs``.
    Two sets are linked if 100 * intersection >= percent * union."""
    src = with_uid(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    signed = written(src.mapInArrow(_sign(shingle, bands, rows, lanes),
                                    "uid long, doc_id long, n long, key binary, sig array<long>, cells array<long>"), "sig")
    # copies: equal sets are one node, the smallest row of the class
    nodes = written(signed.where("n > 0").groupBy("key")
                    .agg(F.min("uid").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig"),
                         F.first("cells").alias("cells")), "nodes")
    label = _classes(src, nodes, shingle, percent, lanes)
    # back to rows: row -> class node -> component
    row = signed.where("n > 0").select("uid", "doc_id", "n", "key").join(nodes.select("key", "node"), "key").drop("key")
    if label is not None:
        row = row.join(label, "node", "left").withColumn("node", F.coalesce("label", "node")).drop("label")
    # written, so that the join has two plain sides and a large component is split
    top = written(row.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "uid")).alias("top")), "tops")
    grouped = (row.join(top.hint("merge"), "node")
               .select("uid", "doc_id", F.col("n").alias("n_shingles"), F.col("top.doc_id").alias("component_id"),
                       (F.col("uid") == F.col("top.uid")).alias("kept")))
    alone = signed.where("n = 0").select("uid", "doc_id", F.col("n").alias("n_shingles"),
                                         F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return grouped.unionByName(alone)
