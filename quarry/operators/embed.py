"""Embedding.

* ``normalize`` / ``truncate``: E3 / E4 as column expressions.
* ``hash_embed``: the built-in deterministic embedder (E5): lower-case word
  tokens, bucket = first 8 hex digits of md5(token) mod dim, sign = +1 when
  the 9th hex digit is 0-7 else -1, summed per text, then L2-normalised;
  row-local in Arrow batches, no shuffle.
* ``embed``: a plug-in embedder (``pd.Series[str] -> 2-D array``) run as an
  iterator Pandas UDF in Arrow batches (E1), optionally embedding each
  distinct text once (E2: dedupe by md5, embed, join back).
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from quarry.functions.text import tokens
from quarry.functions.vectors import norm
from quarry.session import pieces, spread

DEFAULT_DIM = 64


def normalize(df: DataFrame, vec: str, out: str | None = None) -> DataFrame:
    """E3 with the norm computed once per row (a column), not once per
    element inside the lambda."""
    v = F.col(vec).cast("array<double>")
    return (df.withColumn("_norm", norm(vec))
              .withColumn(out or vec, F.when(F.col("_norm") == 0, v)
                          .otherwise(F.transform(v, lambda x: x / F.col("_norm"))))
              .drop("_norm"))


def truncate(df: DataFrame, vec: str, dims: int, out: str | None = None) -> DataFrame:
    """First ``dims`` components, re-normalised."""
    return normalize(df.withColumn("_trunc", F.slice(F.col(vec).cast("array<double>"), 1, dims)),
                     "_trunc", out or vec).drop("_trunc")


def truncate_words(text_col, max_words: int = 128):
    """Input truncation to the first ``max_words`` words (E4; words stand in
    for model tokens)."""
    return F.array_join(F.slice(F.split(F.col(text_col) if isinstance(text_col, str) else text_col,
                                        r"\s+", -1), 1, max_words), " ")


def token_buckets(df: DataFrame, id_col: str, text_col: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """(id, token, bucket, sign) per token occurrence; row-local, no shuffle."""
    t = df.select(id_col, F.explode(tokens(text_col)).alias("token"))
    h = F.md5(F.col("token"))
    return t.select(
        id_col, "token",
        (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dim).cast("int").alias("bucket"),
        F.when(F.substring(h, 9, 1) < "8", F.lit(1)).otherwise(F.lit(-1)).alias("sign"))


def _signed_sums(id_type: T.StructField, dim: int, out: str):
    """mapInArrow function over (id, tokens): every distinct token of a batch
    is hashed once, the signs are summed by (text, bucket)."""
    def run(batches):
        for b in (piece for whole in batches for piece in pieces(whole, 1)):
            words = b.column(1)
            n = np.asarray(pc.fill_null(pc.list_value_length(words), 0))
            coded = words.flatten().dictionary_encode()
            h = [hashlib.md5(w.encode()).hexdigest() for w in coded.dictionary.to_pylist()]
            bucket = np.array([int(x[:8], 16) % dim for x in h], np.int64)
            sign = np.array([1.0 if x[8] < "8" else -1.0 for x in h])
            code, row = np.asarray(coded.indices), np.repeat(np.arange(len(n)), n)
            m = np.bincount(row * dim + bucket[code], sign[code], len(n) * dim).reshape(len(n), dim) if len(code) else np.zeros((len(n), dim))
            size = np.sqrt((m * m).sum(axis=1, keepdims=True))
            m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)[n > 0]
            keep = pa.array(n > 0)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * dim, pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array(n[n > 0].astype(np.int64)), vec],
                                             names=[id_type.name, "n_tokens", out])
    return run


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = DEFAULT_DIM,
               out: str = "embedding", short_texts: bool = False) -> DataFrame:
    """Signed feature hashing embedder; returns (id, n_tokens, embedding).
    Row-local: tokens are split in the JVM, summed by bucket in Arrow batches;
    nothing is shuffled.  Texts without tokens get no row.  (``short_texts``
    is kept for callers; there is one plan for all lengths.)"""
    src = spread(df.select(id_col, tokens(text_col).alias("_t")))
    field = src.schema[id_col]
    schema = T.StructType([field, T.StructField("n_tokens", T.LongType()), T.StructField(out, T.ArrayType(T.DoubleType()))])
    return src.mapInArrow(_signed_sums(field, dim, out), schema)


Embedder = Callable[[pd.Series], np.ndarray]


def embed(df: DataFrame, text_col: str, embedder: Embedder, dim: int, out: str = "embedding",
          dedupe: bool = True, normalize_output: bool = True, max_words: int | None = None) -> DataFrame:
    """Run a plug-in embedder over ``text_col`` in Arrow batches.

    With ``dedupe`` every distinct text is embedded once (E2): distinct on
    ``md5(text)``, embed, equi-join back.  The batch size is Spark's
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            m = np.asarray(embedder(texts.fillna("")), dtype=np.float32)
            if normalize_output:
                n = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.where(n > 0, m / np.where(n > 0, n, 1), m)
            yield pd.Series(list(m))

    # The model sees at most ``max_words`` words of each text
    model_input = truncate_words(text_col, max_words) if max_words else F.col(text_col)
    if not dedupe:
        return df.withColumn(out, _run(model_input))
    keyed = df.withColumn("_tkey", F.md5(model_input))
    uniq = keyed.select("_tkey", model_input.alias("_model_in")).dropDuplicates(["_tkey"])
    vecs = uniq.select("_tkey", _run(F.col("_model_in")).alias(out))
    return keyed.join(vecs, "_tkey").drop("_tkey")
