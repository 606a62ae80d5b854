"""Query op9."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.extract import extract, train
from quarry.llm.registry import register
from quarry.sources.tables import load_table


@register("op9_html")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load_table(spark, sf_dir, "pages")
    return extract(pages, train(pages)).withColumn("n_chars", F.char_length("text").cast("long"))
