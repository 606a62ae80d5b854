"""All queries of this subpackage: importing it fills the registry."""
import corpus_pipeline
from quarry.llm import q_chat, q_dedup, q_fim, q_lines, q_mix, q_pages, q_repair, q_rules, q_spans  # noqa: F401
from quarry.llm.registry import ORACLE, QUERIES  # noqa: F401

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
