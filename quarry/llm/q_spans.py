"""Queries op3 and op5."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import pii, secrets
from quarry.llm.registry import register
from quarry.llm.spans import digest
from quarry.sources.tables import load_table


@register("op3_secrets")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(load_table(spark, sf_dir, "documents"))
    return digest(found, secrets.BASE, secrets.ADDED)


@register("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(load_table(spark, sf_dir, "documents"))
    return digest(found, pii.BASE, pii.ADDED)
