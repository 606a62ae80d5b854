"""k-nearest-neighbour joins (J1, J3, J5, J8, J9) and the IVF index.

``knn_join(questions, corpus, k)`` returns one row per (question, hit):
``(q_id, rank, c_id, d2)`` with ``d2`` the squared L2 distance in double,
``rank`` 1..k without gaps, ties broken by the corpus id.  Fewer than k rows
come back when fewer candidates exist (no padding, Q2).

Three physical plans, chosen by measured size, never by hope:

* ``index_broadcast``  - the corpus side is small (e.g. IVF centroids): it is
  shipped once to every task as a broadcast variable after its byte size is
  checked; the question side streams through ``mapInPandas`` in Arrow
  batches.  No shuffle at all.
* ``query_broadcast``  - the question side is small and checked: the corpus
  streams through ``mapInPandas``, each task keeps a running top-k per
  question, and only ``(question, hit, d2)`` triples (questions x tasks x k)
  are shuffled to the final per-question window.  The corpus is never moved.
* ``grid``             - neither side fits: each side is hash-dealt into blocks
  of bounded size (inside a key, if there are equality keys), a task packs the
  vectors of a block into one row, and each cell ``(keys, qblock, vblock)`` is a
  bounded ``cogroup``.  The number of blocks comes from counts (per key), so a
  hot key (one filter value or one IVF list holding a third of the rows) is
  split into many cells instead of landing in one task.  A side is copied once
  for every block of the other: no more than ``MIN_BLOCKS`` times while it fits
  in that many blocks of ``BLOCK_BYTES``, so small blocks asked for do not
  multiply the shuffle.
* ``pivot``            - neither side fits and there is no key: vectors are
  assigned to their nearest pivot, a question first meets the lists that hold
  its first k vectors, then only those whose lower bound (distance to the
  pivot less the list's radius) does not pass its k-th distance.  Both steps
  are the keyed grid on the list; the result is exact.  Some questions are
  asked first; where the bounds would leave them more than ``PIVOT_SHARE`` of
  the vectors to meet, the plain grid of blocks is taken, exact as well.

A forced broadcast plan over the size limit raises; ``streamed`` takes the query
broadcast where the questions fit and else the plan without a broadcast.

Inside a task q.x - |x|^2 / 2 as a matrix product in single precision
pre-selects, slice by slice, every candidate within a rounding bound of the
k-th value so far (exact ties kept), then the exact d2 = sum((q - x)^2) in
double orders them, so ties are broken by id exactly as the SQL oracle does.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from quarry.session import cut, spread

DEFAULT_BROADCAST_BYTES = 64 << 20
MAX_PRUNE_KEYS = 10_000
MAX_BLOCK_ELEMENTS = 2 << 20  # of a slice of products: 8 MB
MAX_PIVOTS = 512
PIVOT_SHARE, PIVOT_ASKED = 0.25, 256
BLOCK_BYTES = 32 << 20  # of a block of vectors in a cell
MIN_BLOCKS = 8


# --------------------------------------------------------------------------- #
# numpy kernels (run inside Spark tasks)
# --------------------------------------------------------------------------- #

def _stack(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0), dtype=np.float64)
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.to_numpy()])


def _distinct(cids: np.ndarray, X: np.ndarray, kmax: int):
    """The rows without those that cannot be a hit: of equal vectors the
    ``kmax`` smallest ids."""
    if len(X) <= kmax or not X.shape[1]:
        return cids, X
    raw = np.ascontiguousarray(X).view(np.dtype((np.void, X.itemsize * X.shape[1]))).ravel()
    one, of = np.unique(raw, return_inverse=True)
    if len(one) == len(X):
        return cids, X
    order = np.lexsort((cids, of))
    of = of[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    at = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    keep = np.sort(order[at < kmax])
    return cids[keep], X[keep]


def _exact(Q: np.ndarray, rows: np.ndarray, X: np.ndarray, cols: np.ndarray, slab: int = 1 << 16) -> np.ndarray:
    """d2 of the pairs (Q[rows], X[cols]) in double."""
    out = np.empty(len(rows))
    for a in range(0, len(rows), slab):
        diff = Q[rows[a:a + slab]].astype(np.float64) - X[cols[a:a + slab]].astype(np.float64)
        out[a:a + slab] = np.einsum("ij,ij->i", diff, diff)
    return out


def topk_block(qids: np.ndarray, Q: np.ndarray, ks: np.ndarray,
               cids: np.ndarray, X: np.ndarray, step: int = 512) -> pd.DataFrame:
    """Exact top-k of every question in ``Q`` over the rows of ``X``.

    Returns a frame (qid, cid, d2, _k) with at most ks[i] rows per question,
    ordered by (d2, cid) inside each question.  The matrix product only
    pre-selects: q.x - |x|^2 / 2 falls as d2 rises, and every row of a slice
    that comes within a rounding bound of the question's k-th hit so far is
    kept, then the exact d2 decides with the id as tie-break.  Vectors that are
    not finite are no hits and have none.
    """
    finite = np.isfinite(X).all(axis=1)
    if not finite.all():
        cids, X = cids[finite], X[finite]
    if len(Q) == 0 or len(X) == 0:
        return pd.DataFrame({"qid": qids[:0], "cid": cids[:0], "d2": np.zeros(0),
                             "_k": np.zeros(0, dtype=np.int32)})
    kmax = int(min(int(ks.max()), len(X)))
    cids, X = _distinct(cids, X, kmax)
    nc, dim = X.shape
    kmax = min(kmax, nc)
    xn = np.einsum("ij,ij->i", X, X, dtype=np.float64)
    qn_all = np.einsum("ij,ij->i", Q, Q, dtype=np.float64)
    top = max(xn.max(), np.nanmax(qn_all, initial=0.0, where=np.isfinite(qn_all)))
    work = np.float32 if top < 1e30 else np.float64
    # rounding of a product of dim + 1 terms: a few units of |q| |x| + |x|^2
    unit = 4.0 * (dim + 8) * float(np.finfo(work).eps)
    A = np.empty((nc, dim + 1), work)
    A[:, :dim], A[:, dim] = X, -0.5 * xn
    by_id = np.empty(nc, np.int64)  # ties by the place of the id
    by_id[np.argsort(pd.Series(cids), kind="stable")] = np.arange(nc)
    head = min(nc, max(1024, 4 * kmax))
    slice_rows = 1024
    step = max(1, min(step, MAX_BLOCK_ELEMENTS // max(head, slice_rows)))
    bounds = [0, *range(head, nc, slice_rows), nc]
    out_q, out_c, out_d = [], [], []
    for s in range(0, len(Q), step):
        Qs, qn = Q[s:s + step], qn_all[s:s + step]
        n = len(Qs)
        Qa = np.ones((n, dim + 1), work)
        Qa[:, :dim] = Qs
        d2, pos = np.full((n, kmax), np.inf), np.full((n, kmax), -1)
        for a, b in zip(bounds, bounds[1:]):
            near = Qa @ A[a:b].T
            most = xn[a:b].max()
            # and of d2 itself, whose ties in double are ties
            err = unit * (np.sqrt(qn * most) + most) + (dim + 8) * 1e-15 * (qn + most) + 1e-30
            if a == 0:
                kth = np.partition(near, len(near[0]) - kmax, axis=1)[:, len(near[0]) - kmax]
                floor = kth.astype(np.float64) - 2 * err
            else:
                floor = (qn - d2[:, -1]) / 2 - err
            # rounded down, so that no row at the bound is lost
            hit = np.flatnonzero(near >= np.nextafter(floor.astype(work), work(-np.inf))[:, None])
            if not len(hit):
                continue
            rows, cols = np.divmod(hit, b - a)
            cols = cols + a
            some = np.unique(rows)
            held = np.repeat(some, kmax), pos[some].ravel(), d2[some].ravel()
            known = held[1] >= 0
            rows, cols, dist = (np.concatenate(x) for x in zip((held[0][known], held[1][known], held[2][known]),
                                                               (rows, cols, _exact(Qs, rows, X, cols))))
            order = np.lexsort((by_id[cols], dist, rows))
            rows, cols, dist = rows[order], cols[order], dist[order]
            first = np.searchsorted(rows, rows)
            at = np.arange(len(rows)) - first
            keep = at < kmax
            rows, cols, dist, at = rows[keep], cols[keep], dist[keep], at[keep]
            d2[rows, at], pos[rows, at] = dist, cols
        take = (pos >= 0) & (np.arange(kmax)[None, :] < np.asarray(ks[s:s + step])[:, None])
        rows, at = np.nonzero(take)
        out_q.append(rows + s)
        out_c.append(pos[rows, at])
        out_d.append(d2[rows, at])
    of = np.concatenate(out_q)
    return pd.DataFrame({"qid": qids[of], "cid": cids[np.concatenate(out_c)],
                         "d2": np.concatenate(out_d), "_k": np.asarray(ks)[of].astype(np.int32)})


def _merge_topk(frames: list[pd.DataFrame], once: bool = False) -> pd.DataFrame:
    df = pd.concat(frames, ignore_index=True)
    if once:  # a vector that is in several lists
        df = df.drop_duplicates(["qid", "cid"])
    df = df.sort_values(["qid", "d2", "cid"], kind="mergesort")
    df["_r"] = df.groupby("qid", sort=False).cumcount()
    df = df[df["_r"] < df["_k"]]
    return df.drop(columns="_r")


# --------------------------------------------------------------------------- #
# helpers
# --------------------------------------------------------------------------- #

def _key_tuple(pdf: pd.DataFrame, on: Sequence[str]):
    if not on:
        return [((), pdf)]
    return list(pdf.groupby(list(on), sort=False, dropna=False))


def _norm_key(k, on):
    if not on:
        return ()
    return k if isinstance(k, tuple) else (k,)


def _vector_dim(df: DataFrame, vec: str) -> int:
    row = df.select(F.size(vec).alias("d")).where(F.col(vec).isNotNull()).limit(1).collect()
    return int(row[0]["d"]) if row else 0


def _ranked(pairs: DataFrame, q_id: str, c_id: str, per_row_k: bool, kmax: int) -> DataFrame:
    w = Window.partitionBy(q_id).orderBy(F.col("d2"), F.col(c_id))
    out = pairs.withColumn("rank", F.row_number().over(w))
    # constant bound first so Catalyst inserts WindowGroupLimit (partial+final)
    out = out.where(F.col("rank") <= F.lit(kmax))
    if per_row_k:
        out = out.where(F.col("rank") <= F.col("_k"))
    return out.select(q_id, "rank", c_id, "d2")


def _fits(df: DataFrame, dim: int, broadcast_bytes: int) -> bool:
    """Counted rows times the width of a row: vector, id and keys."""
    keys = 64 * (len(df.columns) - 1)
    return df.count() * (dim * 8 + keys) <= broadcast_bytes


def choose_strategy(q: DataFrame, c: DataFrame, c_vec: str, broadcast_bytes: int,
                    allow_index_broadcast: bool = True, on: Sequence[str] = ()) -> str:
    """Pick the plan from measured row counts and vector width."""
    dim = _vector_dim(c, c_vec) or 1
    if allow_index_broadcast and _fits(c, dim, broadcast_bytes):
        return "index_broadcast"
    if _fits(q, dim, broadcast_bytes):
        return "query_broadcast"
    return "grid" if on else "pivot"


# --------------------------------------------------------------------------- #
# public entry point
# --------------------------------------------------------------------------- #

def knn_join(questions: DataFrame, corpus: DataFrame, k: int = 3, *,
             q_id: str = "qid", q_vec: str = "q_vec",
             c_id: str = "cid", c_vec: str = "embedding",
             k_col: str | None = None, on: Sequence[str] = (),
             strategy: str = "auto", broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
             q_block: int = 2048, c_block: int = 16384,
             unique_questions: bool = True, once: bool = False) -> DataFrame:
    """Exact kNN join by squared L2.

    ``k_col``: per-question k (NULL means ``k``), J9.  ``on``: columns that
    must be equal on both sides (metadata equality filters, IVF list id), J5.
    ``unique_questions=False`` when a question id repeats (one row per probed
    IVF list): the top-k is then merged over all rows of the id.  ``once``: a
    corpus id may come in several lists and is one hit.
    Constant filters are plain ``where`` clauses on the inputs, which Catalyst
    pushes into the Parquet scan.
    """
    assert q_id != c_id, "question and corpus ids need distinct names"
    spark = questions.sparkSession
    # fresh names for the equality columns on both sides: both inputs may
    # come from the same table (a self-join), keep their lineage apart
    q_on = [F.col(k).alias(f"_on{i}") for i, k in enumerate(on)]
    c_on = [F.col(k).alias(f"_on{i}") for i, k in enumerate(on)]
    on = [f"_on{i}" for i in range(len(on))]
    if k_col is not None:
        q = questions.select(q_id, q_vec, *q_on, F.coalesce(F.col(k_col).cast("int"), F.lit(k)).alias("_k"))
        kmax = q.agg(F.max("_k")).first()[0] or k
    else:
        q = questions.select(q_id, q_vec, *q_on, F.lit(k).cast("int").alias("_k"))
        kmax = k
    q = q.where(F.col(q_vec).isNotNull() & (F.col("_k") > 0))
    c = corpus.select(c_id, c_vec, *c_on).where(F.col(c_vec).isNotNull())
    for col in on:
        # equality semantics as in SQL: a NULL filter value matches nothing,
        # the same in every physical plan
        q = q.where(F.col(col).isNotNull())
        c = c.where(F.col(col).isNotNull())
    qtype = questions.schema[q_id].dataType
    ctype = corpus.schema[c_id].dataType

    if strategy == "auto":
        strategy = choose_strategy(q, c, c_vec, broadcast_bytes, unique_questions, on)
    elif strategy == "streamed":
        strategy = choose_strategy(q, c, c_vec, broadcast_bytes, False, on)
    elif strategy in ("index_broadcast", "query_broadcast"):
        side = c if strategy == "index_broadcast" else q
        if not _fits(side, _vector_dim(c, c_vec) or 1, broadcast_bytes):
            raise ValueError(f"{strategy}: the side to broadcast is larger than {broadcast_bytes} bytes")
    elif strategy == "grid" and not on:
        strategy = "pivot"

    if strategy == "index_broadcast":
        return _index_broadcast(spark, q, c, q_id, q_vec, c_id, c_vec, on, qtype, ctype)
    if strategy == "query_broadcast":
        pairs = _query_broadcast(spark, q, c, q_id, q_vec, c_id, c_vec, on, qtype, ctype, once)
    elif strategy == "pivot":
        pairs = _pivot(q, c, q_id, q_vec, c_id, c_vec, int(kmax), q_block, c_block)
    elif strategy == "grid":
        pairs = _grid(q, c, q_id, q_vec, c_id, c_vec, on, qtype, ctype, q_block, c_block)
    else:
        raise ValueError(strategy)
    if once:
        pairs = pairs.dropDuplicates([q_id, c_id])
    # the per-question k travels with the pairs (column _k), no join back
    return _ranked(pairs, q_id, c_id, k_col is not None, int(kmax))


def _pairs_schema(q_id, c_id, qtype, ctype) -> T.StructType:
    return T.StructType([T.StructField(q_id, qtype), T.StructField(c_id, ctype),
                         T.StructField("d2", T.DoubleType()), T.StructField("_k", T.IntegerType())])


def _index_broadcast(spark, q, c, q_id, q_vec, c_id, c_vec, on, qtype, ctype):
    idx = c.toPandas()  # size checked by the caller
    groups = {}
    for key, g in _key_tuple(idx, on):
        groups[_norm_key(key, on)] = (g[c_id].to_numpy(), _stack(g[c_vec]))
    bc = spark.sparkContext.broadcast(groups)
    schema = T.StructType([T.StructField(q_id, qtype), T.StructField(c_id, ctype),
                           T.StructField("d2", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def run(it):
        index = bc.value
        for pdf in it:
            frames = []
            for key, g in _key_tuple(pdf, on):
                hit = index.get(_norm_key(key, on))
                if hit is None:
                    continue
                cids, X = hit
                r = topk_block(g[q_id].to_numpy(), _stack(g[q_vec]), g["_k"].to_numpy(), cids, X)
                frames.append(r)
            if frames:
                r = pd.concat(frames, ignore_index=True)
                r["rank"] = (r.groupby("qid", sort=False).cumcount() + 1).astype(np.int32)
                yield r.drop(columns="_k").rename(columns={"qid": q_id, "cid": c_id})

    if spread(q) is not q:  # few partitions; rows of a question stay together
        q = q.repartition(spark.sparkContext.defaultParallelism, q_id)
    out = q.mapInPandas(run, schema)
    return out.select(q_id, "rank", c_id, "d2")


def _query_broadcast(spark, q, c, q_id, q_vec, c_id, c_vec, on, qtype, ctype, once=False):
    qp = q.toPandas()  # size checked by the caller
    groups = {}
    for key, g in _key_tuple(qp, on):
        groups[_norm_key(key, on)] = (g[q_id].to_numpy(), _stack(g[q_vec]), g["_k"].to_numpy())
    bc = spark.sparkContext.broadcast(groups)
    if len(on) == 1 and 0 < len(groups) <= MAX_PRUNE_KEYS:
        # read only the keys some question asks for: a static IN filter that
        # prunes partitions (vectors are written partitioned by IVF list)
        c = c.where(F.col(on[0]).isin([k[0] for k in groups]))

    def run(it):
        qs = bc.value
        frames = []
        for pdf in it:
            for key, g in _key_tuple(pdf, on):
                hit = qs.get(_norm_key(key, on))
                if hit is None:
                    continue
                qids, Q, ks = hit
                frames.append(topk_block(qids, Q, ks, g[c_id].to_numpy(), _stack(g[c_vec])))
            if sum(len(f) for f in frames) > 4 * sum(len(v[0]) for v in qs.values()) * 8:
                frames = [_merge_topk(frames, once)]
        if frames:
            # running top-k of this task: at most (questions x k) rows leave it
            yield _merge_topk(frames, once).rename(columns={"qid": q_id, "cid": c_id})

    # with ``once`` the rows of an id stay where they are
    return (c if once else spread(c)).mapInPandas(run, _pairs_schema(q_id, c_id, qtype, ctype))


def _float_type(df: DataFrame, vec: str):
    """The numpy type that holds the vectors as they are."""
    return np.float32 if df.schema[vec].dataType.elementType == T.FloatType() else np.float64


def _packed(df: DataFrame, keys: Sequence[str], i: str, vec: str, k: str | None = None) -> DataFrame:
    """(keys, _ids, _vecs[, _ks]): the vectors of a batch that share the keys
    as one row; nothing is moved."""
    dtype = _float_type(df, vec)
    keys, rest = list(keys), [i] + ([k] if k else [])
    names = ["_ids", "_ks"][:len(rest)]
    schema = T.StructType([*[df.schema[x] for x in keys], *[T.StructField(n, T.ArrayType(df.schema[x].dataType)) for n, x in zip(names, rest)],
                           T.StructField("_vecs", T.BinaryType())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            of = b.select(keys).to_pandas().groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(of, kind="stable")
            starts = np.flatnonzero(np.diff(of[order], prepend=-1))
            ends = np.append(starts[1:], len(of))
            b = b.take(pa.array(order))
            lengths = pc.unique(pc.list_value_length(b.column(vec))).to_pylist()
            if len(lengths) != 1:
                raise ValueError(f"vectors of different lengths: {lengths}")
            flat = b.column(vec).flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
            offsets = pa.array(np.append(starts, len(of)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(x).take(pa.array(starts)) for x in keys], *[pa.ListArray.from_arrays(offsets, b.column(x)) for x in rest],
                 pa.array([flat[x * lengths[0]:y * lengths[0]].tobytes() for x, y in zip(starts, ends)], pa.binary())], names=schema.names)

    return df.select(*keys, *rest, vec).mapInArrow(run, schema)


def _unpacked(pdf: pd.DataFrame, dtype):
    """(ids, vectors) of the packed rows of a cell."""
    ids = np.concatenate(list(pdf["_ids"]))
    raw = b"".join(pdf["_vecs"])
    return ids, np.frombuffer(raw, dtype).reshape(len(ids), -1) if raw else np.zeros((len(ids), 0), dtype)


def _blocks(n, asked: int, dim: int):
    """The number of blocks for ``n`` rows (a column or a number)."""
    most = max(1024, BLOCK_BYTES // (8 * max(1, dim)))
    if isinstance(n, int):
        return max(1, min(-(-n // asked), max(MIN_BLOCKS, -(-n // most))))
    least = F.greatest(F.lit(MIN_BLOCKS), F.ceil(n / most))
    return F.greatest(F.lit(1), F.least(F.ceil(n / asked), least)).cast("int")


def _grid(q, c, q_id, q_vec, c_id, c_vec, on, qtype, ctype, q_block, c_block):
    dim = _vector_dim(c, c_vec) or 1
    if on:
        qn = q.groupBy(*on).agg(F.count("*").alias("_nq"))
        cn = c.groupBy(*on).agg(F.count("*").alias("_nc"))
        stats = qn.join(cn, on).select(*on, _blocks(F.col("_nq"), q_block, dim).alias("_B"), _blocks(F.col("_nc"), c_block, dim).alias("_S"))
        qx, cx = q.join(stats, on), c.join(stats, on)
    else:
        n_blocks = [F.lit(_blocks(side.count(), block, dim)).alias(n) for side, block, n in ((q, q_block, "_B"), (c, c_block, "_S"))]
        qx, cx = q.select("*", *n_blocks), c.select("*", *n_blocks)
    # questions: own qblock, replicated over the vector blocks of their key
    qx = (_packed(qx.withColumn("_qb", F.pmod(F.xxhash64(F.col(q_id)), F.col("_B")).cast("int")), [*on, "_S", "_qb"], q_id, q_vec, "_k")
          .withColumn("_vb", F.explode(F.sequence(F.lit(0), F.col("_S") - 1))).drop("_S"))
    # vectors: own vblock, replicated over the question blocks of their key
    cx = (_packed(cx.withColumn("_vb", F.pmod(F.xxhash64(F.col(c_id)), F.col("_S")).cast("int")), [*on, "_B", "_vb"], c_id, c_vec)
          .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_B") - 1))).drop("_B"))
    keys = on + ["_qb", "_vb"]
    q_type, c_type = _float_type(q, q_vec), _float_type(c, c_vec)

    def cell(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame({q_id: [], c_id: [], "d2": np.zeros(0), "_k": np.zeros(0, dtype=np.int32)})
        qids, Q = _unpacked(qpdf, q_type)
        r = topk_block(qids, Q, np.concatenate(list(qpdf["_ks"])), *_unpacked(cpdf, c_type))
        return r.rename(columns={"qid": q_id, "cid": c_id})

    return (qx.groupBy(*keys).cogroup(cx.groupBy(*keys))
              .applyInPandas(cell, _pairs_schema(q_id, c_id, qtype, ctype)))


def _pivot(q, c, q_id, q_vec, c_id, c_vec, kmax, q_block, c_block):
    """Exact kNN without keys by pivot bounds; (q_id, c_id, d2, _k) pairs that
    hold every question's k nearest.  The plain grid of blocks where bounds
    prune too little."""
    spark = c.sparkSession
    n_lists = max(1, min(MAX_PIVOTS, math.ceil(math.sqrt(c.count()))))
    # any vectors do as pivots, the bounds make the result exact
    rows = c.orderBy(F.xxhash64(c_id), c_id).limit(n_lists).select(c_vec).collect()
    pivots = spark.createDataFrame([(i, [float(x) for x in r[0]]) for i, r in enumerate(rows)], "_list int, _pivot array<double>")
    if not rows:
        return q.select(q_id, F.lit(None).cast(c.schema[c_id].dataType).alias(c_id), F.lit(0.0).alias("d2"), "_k").where(F.lit(False))

    def to_pivots(df, i, v, k):
        return knn_join(df.select(i, v), pivots, k, q_id=i, q_vec=v, c_id="_list", c_vec="_pivot", strategy="index_broadcast")

    near = to_pivots(c, c_id, c_vec, 1).select(c_id, "_list", F.sqrt("d2").alias("_d"))
    listed = cut(c.join(near, c_id))
    lists = listed.groupBy("_list").agg(F.count("*").alias("_n"), F.max("_d").alias("_radius"))
    order = Window.partitionBy(q_id).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # n_lists rows a question
    bound = F.greatest(F.lit(0.0), F.sqrt("d2") - F.col("_radius"))
    # how much is left to meet, by some questions; both plans are exact
    asked = q.orderBy(F.xxhash64(q_id), q_id).limit(PIVOT_ASKED).select(F.monotonically_increasing_id().alias("_ask"), q_vec)
    asked = cut(asked)
    kth = (knn_join(asked, c, kmax, q_id="_ask", q_vec=q_vec, c_id=c_id, c_vec=c_vec, strategy="query_broadcast")
           .groupBy("_ask").agg(F.sqrt(F.max("d2")).alias("_kth")))
    met = (to_pivots(asked, "_ask", q_vec, n_lists).join(F.broadcast(lists), "_list").join(kth, "_ask")
           .where(bound <= F.col("_kth")).agg(F.sum("_n")).first()[0] or 0)
    if met > PIVOT_SHARE * asked.count() * listed.count():
        return _grid(q, c, q_id, q_vec, c_id, c_vec, [], q.schema[q_id].dataType, c.schema[c_id].dataType, q_block, c_block)
    plan = cut(to_pivots(q, q_id, q_vec, n_lists).join(F.broadcast(lists), "_list")
               .withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
               .select(q_id, "_list", "_before", bound.alias("_low")).join(q.select(q_id, "_k"), q_id))
    first = F.col("_before") < F.col("_k")

    def meet(probes):
        qx = q.join(probes.select(q_id, "_list"), q_id)
        return knn_join(qx, listed.select(c_id, c_vec, "_list"), kmax, q_id=q_id, q_vec=q_vec, c_id=c_id, c_vec=c_vec, k_col="_k",
                        on=["_list"], strategy="grid", q_block=q_block, c_block=c_block, unique_questions=False)

    got = cut(meet(plan.where(first)).join(q.select(q_id, "_k"), q_id))
    kth = got.where(F.col("rank") == F.col("_k")).select(q_id, F.sqrt("d2").alias("_kth"))
    slack = 1e-6  # rounding of the square roots; wider bounds only cost work
    more = plan.where(~first).join(kth, q_id, "left").where(F.col("_kth").isNull() | (F.col("_low") <= F.col("_kth") * (1 + slack) + slack))
    rest = meet(more).join(q.select(q_id, "_k"), q_id)
    return got.unionByName(rest).select(q_id, c_id, "d2", "_k")


def with_scores(hits: DataFrame, min_score: float | None = None) -> DataFrame:
    """The compatibility score ``1 - d2`` (what an L2 index reports as
    '1 - distance', i.e. 2 cos - 1 on unit vectors, Q3) and the cosine.

    J8 ``min_score``: keep hits with score >= min_score.  Scores fall with
    rank, so the kept ranks stay 1..n without gaps."""
    out = hits.withColumn("score", 1 - F.col("d2")).withColumn("cosine", 1 - F.col("d2") / 2)
    return out if min_score is None else out.where(F.col("score") >= F.lit(float(min_score)))


# --------------------------------------------------------------------------- #
# IVF: approximate kNN as an equi-join on list ids
# --------------------------------------------------------------------------- #

def kmeans_centroids(corpus: DataFrame, n_lists: int, c_vec: str = "embedding", seed: int = 7, max_iter: int = 20) -> DataFrame:
    """(list_id INT, centroid ARRAY<DOUBLE>) trained on every vector with
    ``pyspark.ml`` KMeans."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    train = corpus.select(array_to_vector(F.col(c_vec).cast("array<double>")).alias("features"))
    model = KMeans(k=n_lists, seed=seed, maxIter=max_iter, featuresCol="features").fit(train)
    return corpus.sparkSession.createDataFrame(
        [(i, list(map(float, v))) for i, v in enumerate(model.clusterCenters())],
        T.StructType([T.StructField("list_id", T.IntegerType()), T.StructField("centroid", T.ArrayType(T.DoubleType()))]))


def assign_lists(corpus: DataFrame, centroids: DataFrame, *, c_id: str = "cid", c_vec: str = "embedding", spill: int = 1) -> DataFrame:
    """The corpus with ``list_id``: every vector in its ``spill`` nearest lists
    (more than one finds neighbours behind the border of a list; search such a
    table with ``once=True``)."""
    near = knn_join(corpus.select(c_id, c_vec), centroids, spill, q_id=c_id, q_vec=c_vec, c_id="list_id", c_vec="centroid",
                    strategy="index_broadcast")
    return corpus.join(near.select(c_id, "list_id"), c_id)


def build_ivf(corpus: DataFrame, n_lists: int, *, c_id: str = "cid", c_vec: str = "embedding",
              seed: int = 7, max_iter: int = 20, spill: int = 1):
    """Train ``n_lists`` centroids and assign every corpus vector to its nearest
    ``spill``.  Returns ``(centroids, assigned)``; both cover every vector."""
    centroids = kmeans_centroids(corpus, n_lists, c_vec, seed, max_iter)
    return centroids, assign_lists(corpus, centroids, c_id=c_id, c_vec=c_vec, spill=spill)


def coarse_groups(centroids: DataFrame, n_groups: int | None = None, steps: int = 10) -> tuple[DataFrame, DataFrame]:
    """A second level over the centroids: (groups(group_id, center), centroids
    with group_id), about the root of their number of groups.  Centroids are a
    model of bounded size (they come from the driver), so they are grouped there."""
    spark = centroids.sparkSession
    rows = centroids.select("list_id", "centroid").orderBy("list_id").collect()
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], float).reshape(len(rows), -1)
    n_groups = min(len(ids), n_groups or max(1, math.ceil(math.sqrt(len(ids)))))
    center = x[np.linspace(0, len(ids) - 1, n_groups).astype(int)] if ids else x
    of = np.zeros(len(ids), int)
    for _ in range(steps if ids else 0):
        of = np.argmin((x * x).sum(1)[:, None] - 2 * x @ center.T + (center * center).sum(1)[None], axis=1)
        used = np.unique(of)
        center = np.stack([x[of == g].mean(axis=0) for g in used])
        of = np.searchsorted(used, of)
    groups = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(center)], "group_id int, center array<double>")
    return groups, spark.createDataFrame([(i, [float(v) for v in c], int(g)) for i, c, g in zip(ids, x, of)],
                                         "list_id int, centroid array<double>, group_id int")


def probe_lists(questions: DataFrame, groups: DataFrame, centroids: DataFrame, nprobe: int, n_groups: int, *, q_id: str = "qid",
                q_vec: str = "q_vec") -> DataFrame:
    """(q_id, list_id, rank): the ``nprobe`` nearest lists within the ``n_groups``
    nearest groups of each question; lists of other groups are never ranked."""
    dim = _vector_dim(groups, "center") or 1
    plan = lambda table, other: "index_broadcast" if _fits(table, dim, DEFAULT_BROADCAST_BYTES) else other
    near = knn_join(questions.select(q_id, q_vec), groups, n_groups, q_id=q_id, q_vec=q_vec, c_id="group_id", c_vec="center",
                    strategy=plan(groups, "auto")).select(q_id, "group_id")
    found = knn_join(questions.select(q_id, q_vec).join(near, q_id), centroids, nprobe, q_id=q_id, q_vec=q_vec, c_id="list_id",
                     c_vec="centroid", on=["group_id"], strategy=plan(centroids, "grid"), unique_questions=False)
    w = Window.partitionBy(q_id).orderBy("d2", "list_id")
    return found.select(q_id, "list_id", F.row_number().over(w).alias("rank")).where(F.col("rank") <= nprobe)


def ivf_knn_join(questions: DataFrame, centroids: DataFrame, assigned: DataFrame, k: int = 3,
                 nprobe: int = 1, *, q_id: str = "qid", q_vec: str = "q_vec",
                 c_id: str = "cid", c_vec: str = "embedding", strategy: str = "auto", groups: DataFrame | None = None,
                 n_groups: int | None = None, **kw) -> DataFrame:
    """Probe the ``nprobe`` nearest lists of each question, then an exact top-k
    inside them as a join on ``list_id`` (hot lists are split by the grid plan).

    Lists are found in two levels: the nearest groups of centroids first
    (``n_groups``; default: as many as hold twice ``nprobe`` lists on average),
    then lists within those groups.  Lists are fetched on demand: questions whose
    lists hold fewer than k vectors (after their filters) probe twice as many
    groups and lists, until they have k or all lists.  ``nprobe`` >= the number of
    lists is exact.  ``groups``: of centroids that have ``group_id`` already."""
    on = list(kw.pop("on", ()))
    k_col = kw.get("k_col")
    if groups is None:
        groups, centroids = coarse_groups(centroids)
    groups, centroids = cut(groups), cut(centroids)
    all_lists, all_groups = centroids.count(), groups.count()
    per_group = max(1, all_lists // max(1, all_groups))
    g = all_groups if nprobe >= all_lists else min(all_groups, n_groups or -(-2 * nprobe // per_group))
    held = cut(assigned.groupBy("list_id", *on).agg(F.count("*").alias("_held")))
    want = F.coalesce(F.col(k_col).cast("int"), F.lit(k)) if k_col else F.lit(k)
    # a vector that is in several lists is one hit: lists that hold k vectors may hold fewer different ones
    copies = (assigned.groupBy(c_id).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1) if kw.get("once") else 1
    asked = questions.select(q_id, q_vec, *([k_col] if k_col else []), *on)
    rest, chosen, n = asked, None, nprobe
    while True:
        probes = cut(probe_lists(rest, groups, centroids, n, g, q_id=q_id, q_vec=q_vec).select(q_id, "list_id"))
        at = rest.drop(q_vec).join(probes, q_id).join(held, ["list_id", *on], "left")
        if n >= all_lists and g >= all_groups:
            chosen = probes if chosen is None else chosen.unionByName(probes)
            break
        full = cut(at.groupBy(q_id).agg(F.sum("_held").alias("_sum"), F.first(want).alias("_want"))
                   .where(F.col("_sum") >= copies * F.col("_want")).select(q_id))
        done = probes.join(full, q_id, "left_semi")
        chosen = done if chosen is None else chosen.unionByName(done)
        rest = cut(rest.join(full, q_id, "left_anti"))
        if rest.isEmpty():
            break
        n, g = min(all_lists, 2 * n), min(all_groups, 2 * g)
    qx = asked.join(chosen, q_id)
    on_cols = ["list_id", *on]
    # one row per (question, probed list); the final window merges the lists
    return knn_join(qx, assigned.select(c_id, c_vec, *on_cols), k, q_id=q_id, q_vec=q_vec,
                    c_id=c_id, c_vec=c_vec, on=on_cols, strategy=strategy,
                    unique_questions=False, **kw)
