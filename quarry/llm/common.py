"""Helpers shared by the operators.

Row identity.  ``doc_id`` may repeat or be null, so operators that must find
a row again number rows with ``with_uid``.  The number is the rank of the
row's file among the table's files and the row's place in that file, so it is
the same in every scan, however the files are split, on however many cores.
A frame that is no plain scan of a table is written first (``stored``);
operators that number the same rows twice store them once.
"""
from __future__ import annotations

import gc

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from quarry.session import remove_path, scratch_path

ASCII_SPACE = " \t\n\x0b\x0c\r"


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


FILE_ROWS = 1 << 36  # more than a file can hold
_PLAIN = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def _is_scan(df: DataFrame) -> bool:
    """Whether rows come from the files of one table, filtered at most."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in _PLAIN:
        if node.children().isEmpty():
            try:
                df.select("_metadata.row_index")
            except AnalysisException:
                return False
            return True
        node = node.children().head()
    return False


def stored(df: DataFrame) -> DataFrame:
    """``df`` if it is a scan of a table, else a written copy."""
    return df if _is_scan(df) else written(df, "rows")


def with_uid(df: DataFrame, name: str = "uid") -> DataFrame:
    df = stored(df)
    path, row = fresh(df, "q_path"), fresh(df, "q_row")
    # one name for each file of the table
    files = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect())
    at = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    if len(files) < 2:
        return at.withColumn(name, F.col(row)).drop(path, row)
    number = fresh(at, "q_file")
    rank = df.sparkSession.createDataFrame(list(zip(files, range(len(files)))), f"{path} string, {number} long")
    rank = F.broadcast(rank) if sum(map(len, files)) < 16 << 20 else rank
    return (at.join(rank, path).withColumn(name, F.col(number) * FILE_ROWS + F.col(row)).drop(path, row, number)
            .select(*df.columns, name))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: the plan above starts
    from stored rows, so a lost executor costs one re-read, not a re-run."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and nothing will read again, and let
    the driver drop finished plans, with which Spark removes their shuffle files."""
    for t in tables:
        remove_path(t.sparkSession, t.written_at)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def small(df: DataFrame, limit_bytes: int, row_bytes: int) -> bool:
    """Whether a written table is proven to fit a broadcast of that size."""
    return df.count() * row_bytes <= limit_bytes


def sized(df: DataFrame, row_bytes: int, limit_bytes: int = 16 << 20) -> DataFrame:
    """Mark a written table for broadcast if its counted rows fit the limit;
    beyond it the join shuffles."""
    return F.broadcast(df) if small(df, limit_bytes, row_bytes) else df.hint("merge")


