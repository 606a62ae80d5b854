"""Exact dedup by deterministic block naming (Karp, Miller, Rosenberg).

Every text is cut into blocks of ``block`` bytes.  All blocks of the table are
sorted; equal blocks are neighbours and get one integer name (the place of the
first of them in the order).  Then the names at positions 2i and 2i+1 of a
document are paired, all pairs are sorted and named in the same way, and so on
until each document has one name.  Two documents have the same
(level, name) exactly when their texts are equal: names stand for contents,
no hash is involved, so nothing can collide.

Scale.  One shuffle carries the text (the sort of the blocks); later levels
carry integers and halve each time.  The sort key ends with the row and the
position, so a block that a third of all rows share is cut over many
partitions; its runs are joined again through the first and last blocks of
each partition.

Defined cases: a null text counts as empty; empty texts are equal; repeated
rows and null ids are rows like others (of rows equal in text and id, the last
one in scan order stays); an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.common import with_uid, written

BLOCK = 1024


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def _runs(keys: list[str], carried: list[str], schema: pa.Schema):
    """mapInArrow function over sorted partitions: numbers the runs of equal
    keys; after the rows come the runs (``edge`` rows) that may go on in
    another partition: those of the first and of the last ``h``."""

    def fn(batches):
        part = TaskContext.get().partitionId()
        run, last, first_h, last_h = -1, None, None, None
        first, tail = [], []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            h, cols = np.asarray(_column(t, "h")), [_column(t, k) for k in keys]
            new = np.zeros(b.num_rows, bool)
            for c in cols:
                new[1:] |= np.asarray(pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False), bool)
            new[0] = tuple(c[0].as_py() for c in cols) != last
            last = tuple(c[-1].as_py() for c in cols)
            runs = run + np.cumsum(new)
            run = int(runs[-1])
            at = lambda i: (int(runs[i]), tuple(c[int(i)].as_py() for c in cols))  # noqa: B023, E731
            first_h = h[0] if first_h is None else first_h
            first += [at(i) for i in np.flatnonzero(new & (h == first_h))]
            if h[-1] != last_h:
                last_h, tail = h[-1], []
            tail += [at(i) for i in np.flatnonzero(new & (h == last_h))]
            out = [_column(t, c) for c in carried] + [pa.array([part] * b.num_rows, pa.int64()), pa.array(runs, pa.int64())]
            out += [pa.nulls(b.num_rows, f.type) for f in schema][len(out):]
            yield pa.RecordBatch.from_arrays(out, schema=schema)
        edges = list(dict(first + tail).items())
        if edges:
            n, nc = len(edges), len(carried)
            out = [pa.nulls(n, f.type) for f in schema][:nc]
            out += [pa.array([part] * n, pa.int64()), pa.array([r for r, _ in edges], pa.int64())]
            out += [pa.array([k[i] for _, k in edges], schema.field(nc + 2 + i).type) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return fn


def name_rows(df: DataFrame, keys: list[str], tie: list[str], carried: list[str], tag: str) -> DataFrame:
    """``carried`` plus ``name``: an integer that is equal for rows with equal
    keys and different for others.  The result is a written table.

    The order is by a hash of the keys, then the keys themselves: the bounds of
    the sort that pass through the driver are three integers a partition."""
    spark_schema = StructType([*(StructField(c, df.schema[c].dataType) for c in carried),
                               StructField("part", LongType()), StructField("run", LongType()),
                               *(StructField(f"edge_{k}", df.schema[k].dataType) for k in keys)])
    schema = to_arrow_schema(spark_schema)
    ordered = (df.withColumn("h", F.xxhash64(*keys)).repartitionByRange("h", *tie)
               .sortWithinPartitions("h", *keys, *tie))
    runs = written(ordered.mapInArrow(_runs(keys, carried, schema), spark_schema), tag)
    is_edge = F.col(carried[0]).isNull()
    at = F.col("part") * F.lit(1 << 32) + F.col("run")
    # edge runs with equal keys are one run
    edges = runs.where(is_edge).withColumn("at", at)
    same = edges.groupBy(*[f"edge_{k}" for k in keys]).agg(F.min("at").alias("name"))
    alias = (edges.join(same, [edges[f"edge_{k}"].eqNullSafe(same[f"edge_{k}"]) for k in keys])
             .select("at", "name").where("at <> name").distinct())
    rows = runs.where(~is_edge).withColumn("at", at)
    # two rows for each partition of the sort (more only where hashes collide)
    return (rows.join(F.broadcast(alias), "at", "left")
            .select(*carried, F.coalesce("name", "at").alias("name")))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """uid, doc_id, text_sha256, level, name: one row per document; equal
    (level, name) means equal text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = with_uid(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")))
    raw = F.encode("text", "UTF-8")
    last = F.greatest(F.expr(f"(octet_length(text) - 1) div {block}"), F.lit(0)).cast("int")
    cut = base.select("uid", "doc_id", raw.alias("raw"), F.sha2(raw, 256).alias("sha"), last.alias("last"))
    blocks = (cut.select("uid", "doc_id", "raw", "sha", "last", F.explode(F.sequence(F.lit(0), "last")).alias("pos"))
              .select("uid", F.when(F.col("pos") == 0, F.col("doc_id")).alias("doc_id"),
                      F.when(F.col("pos") == 0, F.col("sha")).alias("sha"),
                      F.col("pos").cast("long").alias("pos"), (F.col("last") + 1).cast("long").alias("n"),
                      F.expr(f"substring(raw, pos * {block} + 1, {block})").alias("block")))
    carried = ["uid", "doc_id", "sha", "pos", "n"]
    level = name_rows(blocks, ["block"], ["uid", "pos"], carried, "names0")
    done, k = [], 0
    longest = level.agg(F.max("n")).first()[0] or 1
    while True:
        done.append(level.where("n = 1").select("uid", "doc_id", F.col("sha").alias("text_sha256"),
                                                F.lit(k).alias("level"), "name"))
        if longest <= 1:
            break
        k += 1
        longest = (longest + 1) // 2
        odd = F.col("pos") % 2 == 1
        pairs = (level.where("n > 1").groupBy("uid", F.expr("pos div 2").alias("pos"))
                 .agg(F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"),
                      F.expr("(max(n) + 1) div 2").alias("n"),
                      F.max(F.when(~odd, F.col("name"))).alias("a"),
                      F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("b")))
        level = name_rows(pairs, ["a", "b"], ["uid", "pos"], carried, f"names{k}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """uid, doc_id, keep_id, group_size, kept, text_sha256 for every row; the
    row with the largest id of each group of equal texts stays."""
    ids = identities(docs, id_col, text_col, block)
    # written, so that the join below has two plain sides and can split a group
    # of copies that fills more than its share of a partition
    groups = written(ids.groupBy("level", "name")
                     .agg(F.max(F.struct("doc_id", "uid")).alias("top"), F.count("*").alias("group_size")), "copies")
    return (ids.join(groups.hint("merge"), ["level", "name"])
            .select("uid", "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
                    (F.col("uid") == F.col("top.uid")).alias("kept"), "text_sha256"))
