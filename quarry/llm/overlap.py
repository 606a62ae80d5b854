"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Texts are sets of hashed ``shingle``-word windows (A-Z lower-cased; fewer words
give one window), put in one global order, that of the hashes.

1. Texts with the same set are one node.  Partners of a set of n items share at
   least T = ceil(percent * n / 100) of them, so of two linked sets the first x
   common items (x of the smaller) lie in the heads of both, a head being the
   first n - T + x items.  Short heads (x = n div 20) tell which nodes occur in x
   lists of more than one node; the others, most texts that merely share a
   passage too, leave here.  The nodes left get longer heads (x = n div 5).
2. Inverted lists hold the nodes by the items of their heads.  Lists of one node
   go, then nodes in fewer than x lists.
3. Search.  For every node, the nodes that occur in at least x of its lists are
   wanted.  DivideSkip: its L longest lists (L by the paper's rule, below x) are
   set aside; the short ones are gathered, and a heap merge that skips what can't
   reach x - L occurrences gives the candidates.  The long lists are never read:
   whether they hold a candidate, and how many items beyond the heads are shared,
   is found by binary probes of the node's items in the candidate's sorted set.
   Parity bitmaps bound the overlap from above (of the items that only one set
   has, each toggles one bit): a short one goes with the lists, so that a node
   gathers only what can reach the required overlap, a long one is asked before
   sets are fetched.  Pairs with the required overlap remain.
4. ``overlap_groups`` needs classes only, so nodes that are joined already need
   not find each other.  First every node is compared with one hub, the node that
   most of its lists hold as their most central member (the lists of a group of
   near copies have the same one).  Then lists of one class are closed, nodes that
   share less than T of all their items with nodes of other classes leave, and the
   search runs for the rest: a node meets members of other classes only.  Classes
   are the connected components.  ``jaccard_join`` searches all at once and returns
   every pair of nodes, with the membership of the rows.

Scale.  Short heads (a quarter of the items) are shuffled as numbers, texts are
read twice; full sets move for pairs that the bitmaps leave.  A list is cut by its nodes
into blocks of about ``LIST`` entries, two of which meet in a task, and a node's lists
are merged block by block, so a list of a third of all rows is in no one place.  Texts that are near
to, but not within, the threshold of many others still cost a merge each.

Defined cases: null, empty and wordless texts have an empty set and link with
nothing; repeated rows are copies; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.common import forget, sized, with_uid, written
from quarry.llm.minhash import components, shingle_sets

SURVEY, SEARCH = 20, 5  # heads are longer by n div this than one common item needs
LIST = 1024
MU = 0.1  # weight of a probe in the rule for the long lists
BITS, SHORT_BITS = 1024, 512  # of the bitmaps
PAIRS = 1 << 17  # compared at once


def least_overlap(n, percent: int):
    """Items that a set of n shares at least with any set it is linked to."""
    return -(-n * percent // 100)


def head_size(n: int, percent: int, extra: int) -> int:
    return min(n, n - least_overlap(n, percent) + max(1, n // extra))


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parities of the items by bit: the maps of two sets differ in no more bits
    than the sets differ in items."""
    at = (s >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def folded(bits: np.ndarray) -> np.ndarray:
    """The same of ``SHORT_BITS``: bits that meet are added."""
    return np.bitwise_xor.reduce(bits.reshape(-1, SHORT_BITS // 64), axis=0)


def _heads(k: int, percent: int):
    def fn(batches):
        for b in batches:
            uid, doc, texts = b.column("uid"), b.column("doc_id"), b.column("text")
            for i in range(0, b.num_rows, 256):
                sets = shingle_sets(texts[i:i + 256].to_pylist(), k)
                yield pa.RecordBatch.from_arrays(
                    [uid[i:i + 256], doc[i:i + 256], pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.array([s[:head_size(len(s), percent, SURVEY)].view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["uid", "doc_id", "n", "key", "head"])
    return fn


def _full(k: int, percent: int):
    def fn(batches):
        for b in batches:
            node, texts = b.column("node"), b.column("text")
            for i in range(0, b.num_rows, 256):
                sets = shingle_sets(texts[i:i + 256].to_pylist(), k)
                yield pa.RecordBatch.from_arrays(
                    [node[i:i + 256], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
                     pa.array([s[:head_size(len(s), percent, SEARCH)].view(np.int64) for s in sets], pa.list_(pa.int64())),
                     pa.array([bitmap(s) for s in sets], pa.list_(pa.int64())),
                     pa.array([folded(bitmap(s)) for s in sets], pa.list_(pa.int64()))],
                    names=["node", "n", "items", "head", "bits", "mark"])
    return fn


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _met(rows: pa.Table, percent: int):
    """q, blk, t, held of whole cells of ``_meet``: the nodes of other labels that
    asked nodes can be linked to, by the bitmaps, a block of nodes for each row."""
    col = lambda c: rows.column(c).to_numpy()
    item, lo, hi, part, node, n, label, t, blk = map(col, ("item", "lo", "hi", "part", "node", "n", "label", "t", "blk"))
    mark = rows.column("mark").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
    ends = lambda starts: np.repeat(np.append(starts[1:], len(node)), np.diff(np.append(starts, len(node))))
    cell = _starts(item, lo, hi)
    of = np.repeat(cell, np.diff(np.append(cell, len(node))))
    after = ends(_starts(item, lo, hi, label))  # the classes behind a row's own
    count = ends(cell) - after
    total = np.append(0, np.cumsum(count))
    for at in range(0, total[-1], PAIRS):
        pair = np.arange(at, min(at + PAIRS, total[-1]))
        x = np.searchsorted(total, pair, side="right") - 1
        y = after[x] + pair - total[x]
        q, o = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
        ok = (t[q] > 0) & ((part[q] != part[o]) | (lo[q] == hi[q])) & (n[o] * 100 >= n[q] * percent) & (n[q] * 100 >= n[o] * percent)
        q, o = q[ok], o[ok]
        most = (n[q] + n[o] - np.bitwise_count(mark[q] ^ mark[o]).sum(axis=1, dtype=np.int64)) // 2
        ok = 100 * most >= percent * (n[q] + n[o] - most)
        q, o = q[ok], o[ok]
        if len(q):
            order = np.lexsort((node[o], blk[o], node[q], of[q]))
            q, o = q[order], o[order]
            first = _starts(of[q], node[q], blk[o])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(q)), pa.int32()), pa.array(node[o]))
            yield pa.RecordBatch.from_arrays([pa.array(node[q[first]]), pa.array(blk[o[first]]), pa.array(t[q[first]]), lists], names=["q", "blk", "t", "held"])


def _meet(percent: int):
    """Rows sorted by cell (item, lo, hi) and label, taken as they come, cells whole."""
    def fn(batches):
        rest = None
        for b in batches:
            rows = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b]).combine_chunks()
            last = _starts(*(rows.column(c).to_numpy() for c in ("item", "lo", "hi")))[-1] if rows.num_rows else 0
            rest = rows.slice(last)
            if last:
                yield from _met(rows.slice(0, last), percent)
        if rest is not None and rest.num_rows:
            yield from _met(rest, percent)
    return fn


def merge_skip(lists: list[list[int]], t: int) -> list[tuple[int, int]]:
    """(value, occurrences) of the values that at least t of the sorted lists hold."""
    out, at = [], [0] * len(lists)
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= t:
        low, popped = heap[0][0], []
        while heap and heap[0][0] == low:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= t:
            out.append((low, len(popped)))
            floor = low + 1
        else:
            # fewer than t lists hold what is smaller than the next head
            while heap and len(popped) < t - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            floor = max(low + 1, heap[0][0])
        for i in popped:
            at[i] = bisect_left(lists[i], floor, at[i])
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))
    return out


def _merge(batches):
    for b in batches:
        for i in range(0, b.num_rows, 256):
            a, d = [], []
            for node, t, lists in zip(*(b.column(c)[i:i + 256].to_pylist() for c in ("node", "t", "lists"))):
                for other, _ in merge_skip(lists, t):
                    a.append(node)
                    d.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(d, pa.int64())], names=["a", "b"])


def probes(a: np.ndarray, b: np.ndarray) -> int:
    """How many items of the smaller sorted set are found in the larger one."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


def _probe(percent: int):
    def fn(batches):
        for b in batches:
            keep, shared = [], []
            for i, (x, y) in enumerate(zip(b.column("ia"), b.column("ib"))):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                t = np.frombuffer(y.as_buffer(), np.uint64)
                k = probes(s, t)
                if 100 * k >= percent * (len(s) + len(t) - k):
                    keep.append(i)
                    shared.append(k)
            got = b.select(["a", "b"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column("a"), got.column("b"), pa.array(shared, pa.int64())], names=["a", "b", "shared"])
    return fn


def _needed(n: Column, percent: int, extra: int) -> Column:
    """Lists that a set of n shares at least with any set it is linked to."""
    smallest = F.floor((n * percent + 99) / 100)
    return F.greatest(F.lit(1), F.floor(smallest / extra)).cast("int")


def _room(na: Column, nb: Column, a: Column, b: Column, bits: int, percent: int) -> Column:
    """Whether two sets with these bitmaps can have the required overlap."""
    differ = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(bits // 64)), F.lit(0))
    most = F.floor((na + nb - differ) / 2)
    return 100 * most >= percent * (na + nb - most)


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps leave room for the required overlap."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"x{x}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(_room(F.col("na"), F.col("nb"), F.col("xa"), F.col("xb"), BITS, percent)).select("a", "b"))


def search(posts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, shared of linked nodes of different labels (a < b): every node of
    ``posts`` (item, node, n, label) against all of them."""
    lists = written(posts.groupBy("item").agg(F.count("*").alias("len")), "lists")
    longest = lists.agg(F.max("len")).first()[0]
    if not longest:
        return posts.sparkSession.createDataFrame([], "a long, b long, shared long")
    blocks = 1 << (-(-longest // LIST) - 1).bit_length()
    # divide: a node's lists by length (a set's own items, so a bounded window)
    own = Window.partitionBy("node")
    t = _needed(F.col("n"), percent, SEARCH)
    aside = F.least(t - 1, F.floor(t / (MU * F.log2(F.max("len").over(own)) + 1)))
    ranked = (posts.join(lists, "item")
              .select("item", "node", "n", "label", "len", (t - aside).cast("int").alias("t"), aside.alias("aside"),
                      F.row_number().over(own.orderBy(F.desc("len"), "item")).alias("rank")))
    # a list of several blocks is met two blocks at a time
    parts = F.when(F.col("len") > LIST, F.pow(F.lit(2.0), F.ceil(F.log2(F.col("len") / LIST)))).otherwise(1).cast("int")
    spot = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    asked = (ranked.select("item", "node", "n", "label", F.when(F.col("rank") > F.col("aside"), F.col("t")).otherwise(0).alias("t"),
                           parts.alias("parts"), spot(parts).alias("part"), spot(F.lit(blocks)).alias("blk"))
             .join(sized(sets.select("node", "mark"), 120), "node"))
    cells = (asked.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("item", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"), "part", "node", "n", "label", "t", "blk", "mark")
             .repartition("item", "lo", "hi").sortWithinPartitions("item", "lo", "hi", "label"))
    met = cells.mapInArrow(_meet(percent), "q long, blk int, t int, held array<long>")
    # one node's lists within one block of nodes
    gathered = (met.groupBy("q", "blk").agg(F.first("t").alias("t"), F.collect_list("held").alias("lists"))
                .where(F.size("lists") >= F.col("t")).select(F.col("q").alias("node"), "t", "lists"))
    return linked(gathered.mapInArrow(_merge, "a long, b long"), sets, percent)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, shared of the pairs with the required overlap."""
    pairs = written(_possible(pairs, sets, percent), "pairs")
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b"))
    return written(both.mapInArrow(_probe(percent), "a long, b long, shared long"), "links")


def _enough(posts: DataFrame, percent: int, extra: int) -> DataFrame:
    """Nodes in as many of the lists as a link needs."""
    per = posts.groupBy("node").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    return written(per.where(F.col("c") >= _needed(F.col("n"), percent, extra)).select("node"), "alive")


def _several(posts: DataFrame, by: str) -> DataFrame:
    """Rows of the lists that hold more than one value of ``by``."""
    span = posts.groupBy("item").agg(F.min(by).alias("lo"), F.max(by).alias("hi")).where("lo < hi").select("item")
    return written(posts.join(written(span, "span").hint("shuffle_hash"), "item"), "posts")


def _open(posts: DataFrame, percent: int, by: str) -> DataFrame:
    """Lists of more than one ``by``, and of these the nodes in enough lists."""
    now = _several(posts, by)
    out = written(now.join(sized(_enough(now, percent, SEARCH), 16), "node"), "open")
    forget(now)
    return out


def _listed(heads: DataFrame) -> DataFrame:
    """item, node, n of the items that more than one node has."""
    posts = heads.select(F.explode("head").alias("item"), "node", "n")
    common = written(posts.groupBy("item").agg(F.count("*").alias("c")).where("c > 1").select("item"), "common")
    return posts.join(common.hint("shuffle_hash"), "item")


def _prepared(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int):
    """(membership of rows, open posts, full sets of their nodes)."""
    src = with_uid(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    signed = written(src.mapInArrow(_heads(shingle, percent), "uid long, doc_id long, n long, key binary, head array<long>"), "heads")
    nodes = written(signed.where("n > 0").groupBy("key").agg(F.min("uid").alias("node")), "nodes")
    some = signed.where("n > 0").select("uid", "doc_id", "n", "key").join(nodes, "key").select("uid", "doc_id", "n", "node")
    rows = written(some.unionByName(signed.where("n = 0").select("uid", "doc_id", "n", F.col("uid").alias("node"))), "rows")
    heads = signed.select(F.col("uid").alias("node"), "n", "head").join(sized(nodes.select("node"), 16), "node")
    short = written(_listed(heads).select("node", "n"), "short")  # one row a list
    used = _enough(short, percent, SURVEY)
    forget(signed, short)
    sets = written(src.join(sized(used.withColumnRenamed("node", "uid"), 16), "uid", "left_semi").select(F.col("uid").alias("node"), "text")
                   .mapInArrow(_full(shingle, percent), "node long, n long, items binary, head array<long>, bits array<long>, mark array<long>"), "sets")
    posts = written(_listed(sets), "posts")
    now = _open(posts, percent, "node")
    forget(posts)
    return rows, now, sets


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                 percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(links, members): node_a, node_b (a < b), shared of every two nodes with
    100 * intersection >= percent * union, and uid, doc_id, n_shingles, node of
    every row (rows of one node have equal sets)."""
    rows, now, sets = _prepared(docs, id_col, text_col, shingle, percent)
    links = search(now.withColumn("label", F.col("node")), sets, percent)
    return links.toDF("node_a", "node_b", "shared"), rows.withColumnRenamed("n", "n_shingles")


def _hubs(now: DataFrame) -> DataFrame:
    """a, b: every node with the node that most of its lists have as their hub,
    the member that lies in most and longest lists."""
    weight = now.groupBy("item").agg(F.count("*").alias("c"))
    score = written(now.join(weight, "item").groupBy("node").agg(F.sum("c").alias("score")), "scores")
    hub = written(now.select("item", "node").join(sized(score, 24), "node").groupBy("item").agg(
        F.max_by("node", F.struct("score", -F.col("node"))).alias("hub")), "hubs")
    held = now.select("item", "node").join(hub, "item").where("hub <> node").groupBy("node", "hub").agg(F.count("*").alias("c"))
    return held.groupBy("node").agg(F.max_by("hub", F.struct("c", -F.col("hub"))).alias("b")).select(F.col("node").alias("a"), "b")


def _items(batches):
    for b in batches:
        for i in range(0, b.num_rows, 64):
            part = b.slice(i, 64)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("items")]
            at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            rows = [part.column(c).take(at) for c in ("node", "n", "label")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), *rows], names=["item", "node", "n", "label"])


def _relabelled(now: DataFrame, label: DataFrame) -> DataFrame:
    return now.join(sized(label, 16), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _labels(now: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, label of the nodes in links."""
    label = components(linked(_hubs(now), sets, percent).select("a", "b"))
    left = _open(_relabelled(now, label), percent, "label")
    # of all its items a node must share enough with nodes of other classes
    nodes = written(left.select("node", "label").distinct(), "left")
    whole = sets.select("node", "n", "items").join(sized(nodes, 24), "node").mapInArrow(_items, "item long, node long, n long, label long")
    span = written(whole.groupBy("item").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("item"), "span")
    shared = whole.select("item", "node", "n").join(span.hint("shuffle_hash"), "item")
    near = _enough(shared, percent, 1)
    rest = _open(left.join(sized(near, 16), "node"), percent, "label")
    forget(left)
    links = search(rest, sets, percent)
    at = lambda x: label.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    classes = (links.join(at("a"), "a", "left").join(at("b"), "b", "left")
               .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    merged = components(classes)
    moved = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
    known = label.unionByName(merged.select("node", F.col("node").alias("label")).join(sized(label.select("node"), 16), "node", "left_anti"))
    return written(known.join(sized(moved, 16), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def overlap_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """uid, doc_id, n_shingles, component_id (smallest id reachable by links)
    of every row of ``docs``."""
    rows, now, sets = _prepared(docs, id_col, text_col, shingle, percent)
    label = _labels(now, sets, percent)
    rows = rows.join(sized(label, 16), "node", "left").withColumn("node", F.coalesce("label", "node")).drop("label")
    least = written(rows.groupBy("node").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.join(least.hint("merge"), "node").select("uid", "doc_id", F.col("n").alias("n_shingles"), "component_id")
