"""Text expressions shared by the embedder, BM25 and the extractive answerer."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Token boundary = any run of characters that are not a letter
# or a digit; tokens are lower-cased.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
WHITESPACE = r"\s+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes all leading/trailing whitespace, not
    only spaces as ``trim`` does (F5)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def tokens(c) -> Column:
    """Lower-cased word tokens, empty strings removed (``array_remove`` is
    code-generated; a lambda filter is interpreted and costs more than the
    split)."""
    return F.array_remove(F.split(F.lower(_c(c)), TOKEN_SPLIT, -1), "")


def word_slice(c, n: int) -> Column:
    """First ``n`` whitespace-separated words of a stripped text."""
    return F.array_join(F.slice(F.split(py_strip(c), WHITESPACE, -1), 1, n), " ")
