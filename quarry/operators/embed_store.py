"""Embeddings kept between runs.

    store(text_key, embedding), in ``BUCKETS`` hash buckets of text_key, sorted

Distinct texts (by md5) are looked up in the store; only those it lacks go through
the embedder, and their vectors are appended.  The store is a bucketed table, so
the join with it reads its files in place: the asked keys are shuffled to its
buckets, the stored vectors are not.  The table is registered in the session under
a name made from its path; its files are all that has to be kept.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators.embed import Embedder, embed, truncate_words
from quarry.session import scratch_path

BUCKETS = 16


def _name(path: str) -> str:
    return "quarry_embeddings_" + hashlib.md5(path.encode()).hexdigest()[:16]


def store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> str:
    """The name of the table over the files at ``path`` (made if there are none)."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} (text_key STRING, embedding ARRAY<FLOAT>) USING parquet "
                  f"CLUSTERED BY (text_key) SORTED BY (text_key) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def embed_stored(df: DataFrame, text_col: str, embedder: Embedder, dim: int, path: str, *, out: str = "embedding",
                 max_words: int | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """``df`` with ``out``, and how many texts had to be embedded.  A null text
    gets the vector of the empty text."""
    spark = df.sparkSession
    text = F.coalesce(truncate_words(text_col, max_words) if max_words else F.col(text_col), F.lit(""))
    asked = df.select(F.md5(text).alias("text_key"), text.alias("text")).dropDuplicates(["text_key"])
    name = store(spark, path, buckets)
    known = spark.table(name).select("text_key")
    new_at = scratch_path(spark, "new-embeddings")
    embed(asked.join(known, "text_key", "left_anti"), "text", embedder, dim, "embedding", dedupe=False).select(
        "text_key", "embedding").write.parquet(new_at)
    new = spark.read.parquet(new_at)
    n_new = new.count()
    if n_new:
        new.repartition(buckets, "text_key").write.mode("append").bucketBy(buckets, "text_key").sortBy("text_key").format("parquet").saveAsTable(name)
    keyed = df.withColumn("_text_key", F.md5(text))
    held = spark.table(name).select(F.col("text_key").alias("_text_key"), F.col("embedding").alias(out))
    return keyed.join(held.hint("merge"), "_text_key", "left").drop("_text_key"), n_new


