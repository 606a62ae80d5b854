"""Zone-independent conversions between TIMESTAMP_NTZ (wall clock, as in the
supplied tables) and TIMESTAMP instants (needed by watermarks): the wall
clock is read as UTC through epoch microseconds, so results do not depend
on ``spark.sql.session.timeZone``."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def ntz_micros(c) -> Column:
    return F.timestamp_diff("MICROSECOND", _epoch_ntz(), _c(c).cast("timestamp_ntz"))


def ntz_to_instant(c) -> Column:
    return F.timestamp_micros(ntz_micros(c))


def instant_to_ntz(c) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(c)), _epoch_ntz())
