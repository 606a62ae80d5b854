"""T4: live metrics over a request-log stream.

Tumbling (or sliding) event-time windows with a watermark; the output is
written in update mode through ``foreachBatch`` as (batch_id, rows); the
current value of a window is its row from the latest batch that updated it.
State for windows older than the watermark is dropped; rows that come later
than that are counted by ``quarry.streaming.common.late_rows``.  Event times are
wall-clock TIMESTAMP_NTZ read as UTC instants (``quarry.functions.time``),
so windows do not move with the session time zone."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarry.functions.time import ntz_to_instant
from quarry.streaming.common import batch_sink, idempotent_batch_writer, run_available_now


def windowed_counters(stream: DataFrame, ts_col: str = "ts", window: str = "1 hour", slide: str | None = None,
                      watermark: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    s = stream.withColumn("_ts", ntz_to_instant(ts_col)).withWatermark("_ts", watermark)
    failed = F.col("event_type") == "error"
    return s.groupBy(F.window("_ts", window, slide) if slide else F.window("_ts", window), *by).agg(
        F.count("*").alias("requests"), F.count_if(failed).alias("failures"),
        F.sum("value").alias("sum_ms"), F.max("value").alias("max_ms"))


def session_counters(stream: DataFrame, user_col: str = "user_id", ts_col: str = "ts", gap: str = "30 minutes",
                     watermark: str = "1 hour") -> DataFrame:
    """Per-user sessions (gap-based) with request counts."""
    s = stream.withColumn("_ts", ntz_to_instant(ts_col)).withWatermark("_ts", watermark)
    return s.groupBy(F.session_window("_ts", gap), user_col).agg(F.count("*").alias("requests"))


def run_windowed(spark: SparkSession, agg: DataFrame, key_cols: list[str], mode: str = "update") -> DataFrame:
    """``mode='append'`` for session windows: a session is emitted once the
    watermark closes it."""
    sink, ckpt = batch_sink(spark, "metrics")
    w = (agg.writeStream.outputMode(mode).foreachBatch(idempotent_batch_writer(sink))
         .option("checkpointLocation", ckpt))
    run_available_now(w)
    out = spark.read.parquet(sink)
    latest = Window.partitionBy(*key_cols).orderBy(F.col("batch_id").desc())
    return out.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r", "batch_id")
