"""Registered driver queries: a Spark plan and an equivalent DuckDB SQL text.

Each query reads whole supplied tables (or tables Spark derives from them).
Doubles are rounded to 6 places on both sides; every rank is tie-broken by an
id.  Queries without an SQL form (recursive chunking, KMeans) register no SQL.
"""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SparkFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, SparkFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: SparkFn) -> SparkFn:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from quarry.session import ensure_checkpoint_dir, ship_package
            ship_package(spark)
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir.rstrip("/"))
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco
