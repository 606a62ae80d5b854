"""Measure a batch plan per stage and log it.

Spark runs a whole plan lazily, so a per-question time does not exist in a
batch job; what can be measured honestly is the wall time of each stage
when it is materialised.  ``timed`` runs one stage to completion (written
through a reliable checkpoint, so later stages read it instead of
recomputing) and records (stage, rows, ms).  ``with_metrics`` wraps any
``DataFrame -> DataFrame`` batch function and appends its stage times to a
query-log table folder."""
from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.session import cut


class StageTimer:
    def __init__(self, spark: SparkSession, batch_id: str):
        self.spark, self.batch_id, self.rows = spark, batch_id, []

    def timed(self, stage: str, df: DataFrame) -> DataFrame:
        t = time.perf_counter()
        out = cut(df)
        n = out.count()
        self.rows.append((self.batch_id, stage, n, (time.perf_counter() - t) * 1000.0))
        return out

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "batch_id string, stage string, rows long, ms double")


def with_metrics(fn: Callable[[DataFrame, StageTimer], DataFrame], log_path: str) -> Callable[[DataFrame, str], DataFrame]:
    """Wrap ``fn(questions, timer)``; every call appends the stage table to
    ``log_path`` and adds a 'total' row."""
    def run(questions: DataFrame, batch_id: str) -> DataFrame:
        timer = StageTimer(questions.sparkSession, batch_id)
        t = time.perf_counter()
        out = timer.timed("result", fn(questions, timer))
        timer.rows.append((batch_id, "total", out.count(), (time.perf_counter() - t) * 1000.0))
        timer.table().write.mode("append").parquet(log_path)
        return out
    return run


def stage_shares(log: DataFrame) -> DataFrame:
    """M6 on a stage log: mean ms per stage and its share of the total."""
    total = log.where(F.col("stage") == "total").select(F.sum("ms")).scalar()
    return (log.where(F.col("stage") != "total").groupBy("stage")
               .agg(F.avg("ms").alias("avg_ms"), (F.sum("ms") / total).alias("share")))
