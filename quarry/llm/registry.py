"""Driver queries of this subpackage (own tables, merged by the entry file)."""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.session import ensure_checkpoint_dir, ship_package

SparkFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, SparkFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: SparkFn) -> SparkFn:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir.rstrip("/"))
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco
