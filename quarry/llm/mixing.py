"""Mixing sources to target weights by Pfair scheduling.

Every source's documents, in a fixed pseudo-random order, are cut into blocks
of ``block_docs``.  A source of weight a (of a total Q) may place its block k
no earlier than slot floor(k * Q / a) and must have placed it before slot
ceil((k + 1) * Q / a).  Among the released blocks the earliest deadline goes
first, one block a slot.  With integer weights the schedule repeats every Q
slots, so it is computed for one period (a fold over Q slots) and block k of a
source takes its slot from period k div a.  At every slot each source has
placed its share of blocks to within less than one block, until the first
source runs out; from there its slots stay empty, the others keep theirs, and
``mixed`` is false.

Scale.  No sort over a whole source: documents are ranked in hash-range
buckets of about ``bucket_docs`` rows, whose counts give the offsets; buckets
that hold far more (one id, or none, in many rows) are cut further by hash, id
and row number.  The period has about ``period`` slots or as many as there are
sources, whatever the corpus; its fold looks at every source in each slot, so
some thousand sources take it minutes.

Defined cases: a null source is a source of its own; weights of sources that
have no documents are left out; sources without a given weight get 1; ties in the hash go by id, then scan order; an empty table
gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.common import fresh, sized, stored, with_uid, written

BLOCK_DOCS = 16
PERIOD = 1000
BUCKET_DOCS = 5_000
GROUP_DOCS = 4_096


def root_weights(counts: DataFrame, period: int = PERIOD) -> DataFrame:
    """source, weight: shares by the square root of the source's size (flatter
    than the corpus), as integers that sum to about ``period``."""
    root = counts.withColumn("r", F.floor(F.sqrt("n")))
    total = root.agg(F.sum("r")).first()[0] or 1
    return root.select("source", F.greatest(F.lit(1), F.expr(f"{period} * r div {total}")).alias("weight"))


def period_schedule(weights: DataFrame) -> DataFrame:
    """source, weight, q (sum of weights), j, slot for one period: earliest
    deadline first over the released blocks."""
    row = weights.groupBy().agg(
        F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("no"), "source", F.col("weight").cast("long").alias("a")))).alias("s"),
        F.sum("weight").cast("long").alias("q")).where("q > 0")
    pick = F.expr("""
      aggregate(sequence(0L, q - 1),
        named_struct('done', array_repeat(0L, size(s)), 'out', cast(array() as array<struct<i:int,j:bigint>>)),
        (st, t) -> element_at(transform(
          array(array_min(filter(
            transform(s, (x, i) -> named_struct('d', ((st.done[i] + 1) * q + x.a - 1) div x.a, 'i', i,
                                                'j', st.done[i], 'r', st.done[i] * q div x.a, 'a', x.a)),
            x -> x.j < x.a and x.r <= t))),
          b -> named_struct('done', transform(st.done, (n, i) -> if(i = b.i, n + 1, n)),
                            'out', concat(st.out, array(named_struct('i', b.i, 'j', b.j))))), 1),
        st -> st.out)""")
    return (row.select("s", "q", F.posexplode(pick).alias("slot", "b"))
            .select(F.expr("s[b.i].source").alias("source"), F.expr("s[b.i].a").alias("weight"), "q",
                    F.col("b.j").alias("j"), F.col("slot").cast("long").alias("slot")))


def schedule(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: DataFrame | None = None,
             block_docs: int = BLOCK_DOCS, period: int = PERIOD, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """uid, doc_id, source, block, release, deadline, slot, place (in the
    block), mixed for every document.  ``weights``: source, weight (integers)."""
    base = with_uid(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = base.withColumn("h", order)
    total = docs.count()
    buckets = max(1, -(-total // bucket_docs))
    keyed = keyed.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets, 32))
    # equal ids share a hash: an overfull bucket is cut by hash, id and stretches of rows
    full = written(keyed.groupBy("bucket").agg(F.count("*").alias("c")).where(F.col("c") > 4 * bucket_docs).select("bucket", F.lit(True).alias("cut")), "full")
    keyed = (keyed.join(sized(full, 16), "bucket", "left")
             .select("uid", "doc_id", "source", "h", "bucket", F.when(F.col("cut"), F.col("h")).alias("s1"),
                     F.when(F.col("cut"), F.col("doc_id")).alias("s2"), F.when(F.col("cut"), F.expr(f"uid div {bucket_docs}")).alias("s3")))
    cell = ["bucket", "s1", "s2", "s3"]
    per = keyed.groupBy("source", *cell).agg(F.count("*").alias("c"))
    before = Window.partitionBy("source").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    offset = per.select("source", *cell, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    sizes = written(per.groupBy("source").agg(F.sum("c").alias("n")), "sizes")
    if weights is None:
        weights = root_weights(sizes, period)
    else:
        weights = sizes.select(F.col("source").alias("s0")).join(weights, F.col("s0").eqNullSafe(F.col("source")), "left").select(
            F.col("s0").alias("source"), F.greatest(F.lit(1), F.coalesce("weight", F.lit(1))).cast("long").alias("weight"))
    plan = written(period_schedule(weights), "period")
    within = Window.partitionBy("source", *cell).orderBy("h", "doc_id", "uid")
    same = F.col("d.bucket") == F.col("o.bucket")
    for c in ("source", "s1", "s2", "s3"):
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"o.{c}"))
    ranked = (keyed.withColumn("k", F.row_number().over(within) - 1).alias("d")
              .join(offset.alias("o"), same)
              .select("uid", "doc_id", "d.source", (F.col("k") + F.col("first")).alias("rank")))
    # the slot at which the first source has no block left
    share = plan.select(F.col("source").alias("ps"), "weight", "q", "j", "slot")
    stop = (sizes.withColumn("blocks", F.expr(f"(n + {block_docs - 1}) div {block_docs}"))
            .join(share, F.col("source").eqNullSafe(F.col("ps"))).where("blocks % weight = j")
            .agg(F.min(F.expr("blocks div weight * q + slot"))).first()[0])
    a_q = share.select("ps", "weight", "q").distinct()
    blocks = (ranked.withColumn("block", F.expr(f"rank div {block_docs}")).withColumn("place", F.expr(f"rank % {block_docs}"))
              .join(sized(a_q, 64), F.col("source").eqNullSafe(F.col("ps"))).drop("ps"))
    slots = share.select(F.col("ps"), F.col("j"), F.col("slot").alias("in_period"))
    return (blocks.withColumn("jj", F.expr("block % weight"))
            .join(sized(slots, 64), F.col("source").eqNullSafe(F.col("ps")) & (F.col("jj") == F.col("j")))
            .withColumn("slot", F.expr("block div weight * q + in_period"))
            .select("uid", "doc_id", "source", "block", F.expr("block * q div weight").alias("release"),
                    F.expr("((block + 1) * q + weight - 1) div weight").alias("deadline"), "slot", "place",
                    (F.col("slot") < F.lit(stop or 0)).alias("mixed")))


def slot_groups(docs: DataFrame, group_docs: int = GROUP_DOCS, block_docs: int = BLOCK_DOCS, **options) -> DataFrame:
    """uid, grp, mixed for every document: stretches of the mixed order of
    about ``group_docs`` documents, numbered in its order.  At the border of
    two groups each source has its share to within less than one block, until
    the first source runs out."""
    step = max(1, group_docs // block_docs)
    plan = written(schedule(docs, block_docs=block_docs, **options).select(
        "uid", "mixed", F.expr(f"slot div {step}").alias("stretch")), "slots")
    # one row for each stretch of slots; sparse ones (sources have run out) are joined
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    per = plan.groupBy("stretch").agg(F.count("*").alias("c"))
    number = written(per.withColumn("first", F.coalesce(F.sum("c").over(before), F.lit(0)))
                     .select("stretch", F.expr(f"first div {step * block_docs}").alias("grp")), "stretches")
    return plan.join(sized(number, 32), "stretch").select("uid", "grp", "mixed")


def interleave(docs: DataFrame, **options) -> DataFrame:
    """All rows and columns of ``docs``, in mixed order: partitions and the
    rows in them (so the written files, too) follow (slot, place)."""
    docs, uid = stored(docs), fresh(docs, "q_uid")
    slot, place = fresh(docs, "q_slot"), fresh(docs, "q_place")
    plan = schedule(docs, **options).select(F.col("uid").alias(uid), F.col("slot").alias(slot), F.col("place").alias(place))
    return (with_uid(docs, uid).join(plan, uid).repartitionByRange(slot, place)
            .sortWithinPartitions(slot, place).select(*docs.columns))
