"""Incremental ingest - new files in a folder are loaded, chunked,
embedded and appended to the index by its one writer, with statistics and
metadata like a batch build.  The file source remembers which files it has
seen (exactly once per file); a micro-batch writes a batch of the index that
is named by the stream's checkpoint and its number, so a replay replaces
itself and nothing else."""
from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession, functions as F

from quarry.operators.embed import DEFAULT_DIM
from quarry.operators.index import build_and_write_index
from quarry.session import listing
from quarry.sources.html import html_to_text
from quarry.streaming.common import run_available_now


def run_ingest(spark: SparkSession, folder: str, index_path: str, checkpoint: str, *,
               size: int = 256, overlap: int = 20, dim: int = DEFAULT_DIM, glob: str = "*.txt"):
    with listing(spark):
        files = (spark.readStream.format("binaryFile")
                 .schema("path string, modificationTime timestamp, length long, content binary")
                 .option("pathGlobFilter", glob)
                 .option("recursiveFileLookup", "true").load(folder))
    docs = files.select(F.col("path").alias("source"),
                        F.element_at(F.split("path", "/"), -1).alias("filename"),
                        F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("file_type"),
                        F.when(F.lower(F.col("path")).endswith(".html"), html_to_text(F.col("content").cast("string")))
                         .otherwise(F.col("content").cast("string")).alias("text"))

    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def write(batch, batch_id):
        build_and_write_index(batch, index_path, mode="append", batch=f"stream-{stream}-{batch_id}", id_cols=("source",),
                              size=size, overlap=overlap, dim=dim)

    with listing(spark):
        return run_available_now(docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))
