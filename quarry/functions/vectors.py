"""Vector expressions on ARRAY<FLOAT|DOUBLE> columns.

All arithmetic is done in double.  These stay JVM-side (higher-order
functions); the hot kNN path uses Arrow batches instead, see
``quarry.operators.knn``.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double_array(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(to_double_array(a), to_double_array(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sq_l2(a, b) -> Column:
    """Squared Euclidean distance, summed in order in double."""
    return F.aggregate(F.zip_with(to_double_array(a), to_double_array(b), lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(to_double_array(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def l2_normalize(v) -> Column:
    """x / |x|; a zero vector stays zero."""
    n = norm(v)
    return F.when(n == 0, to_double_array(v)).otherwise(
        F.transform(to_double_array(v), lambda x: x / n))


def truncate_dims(v, d: int) -> Column:
    """Keep the first ``d`` components, then re-normalise."""
    return l2_normalize(F.slice(to_double_array(v), 1, d))
