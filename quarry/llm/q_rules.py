"""Query op2."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.quality import quality
from quarry.llm.registry import register
from quarry.sources.tables import load_table


@register("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                "base_failed", "kept", "distance")
