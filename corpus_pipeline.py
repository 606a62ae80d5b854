"""A corpus pipeline of the operators in ``quarry/llm``.

    documents -> quality rules -> line dedup -> near-duplicate documents
              -> mixing sources to target weights -> packing

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared scratch folder and gives the next stage what it
reads back.  All stages but the last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.common import fresh, sized, with_uid, written
from quarry.llm.lines import dedup_lines
from quarry.llm.minhash import near_groups
from quarry.llm.mixing import interleave, slot_groups
from quarry.llm.packing import pack_groups
from quarry.llm.quality import passing
from quarry.session import ensure_checkpoint_dir, ship_package
from quarry.sources.tables import load_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language and source go."""
    return passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or nearly equal to an earlier one go from the texts; a
    document that loses its last line goes."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or
    more, chained) the document with the smallest id stays."""
    uid = fresh(docs, "q_uid")
    gone = written(near_groups(docs).where("not kept").select(F.col("uid").alias(uid)), "copies")
    return with_uid(docs, uid).join(sized(gone, 16), uid, "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered so that sources interleave by their weights."""
    return interleave(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per token piece: document, place in it, sequence and offset.
    Windows are filled within stretches of the mixed order, which depends on
    ids and sources only, and the sequences follow it."""
    return pack_groups(docs, slot_groups(docs))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("mixing", mixing), ("packing", packing)]

# The quality verdict (iterated estimates) and the tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
