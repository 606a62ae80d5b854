"""Time formatting.

Python's ``format(x, '.1f')`` rounds the exact binary value half-to-even;
Java's ``String.format`` (and so Spark's ``format_string``) rounds the
shortest decimal form half-up, which differs on values such as 6.55 or
12.25.  The reference is Python, so these two presentation helpers are small
vectorised Pandas UDFs (Arrow batches, no per-row JVM round trip).
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _either(x: np.ndarray, small: str, large: str) -> pd.Series:
    """Values below 1 times 1000 in one form, others in the other; NaN is NULL."""
    out = np.where(x < 1, np.char.mod(small, x * 1000), np.char.mod(large, x)).astype(object)
    out[np.isnan(x)] = None
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def _fmt_ms(v: pd.Series) -> pd.Series:
    x = v.to_numpy(dtype=np.float64, na_value=np.nan)
    return _either(x, "%.0fμs", "%.1fms")


@F.pandas_udf(T.StringType())
def _fmt_s(v: pd.Series) -> pd.Series:
    x = v.to_numpy(dtype=np.float64, na_value=np.nan)
    return _either(x, "%.2f ms", "%.2f sec")


def format_ms(ms) -> Column:
    """Milliseconds: below 1 ms as whole microseconds ('{:.0f}μs'), else
    '{:.1f}ms'."""
    return _fmt_ms(_c(ms).cast("double"))


def format_seconds(s) -> Column:
    """Seconds: below 1 s as '{:.2f} ms', else '{:.2f} sec'."""
    return _fmt_s(_c(s).cast("double"))
