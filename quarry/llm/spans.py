"""Span scans: a finder runs on each whole text where it is read (no shuffle),
and the spans it returns become columns."""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

Span = tuple[str, int, int, float]  # kind, start, end (code points), score
SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def covers(base: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span lies within one of the base spans.  The ends of those that
    begin up to a place only grow, so the largest of them decides."""
    base = sorted(base)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))

    def inside(a: int, b: int) -> bool:
        i = bisect_right(starts, a)
        return i > 0 and reach[i - 1] >= b
    return inside


def touches(base: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span overlaps one of the base spans."""
    base = sorted(base)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))

    def meets(a: int, b: int) -> bool:
        i = bisect_left(starts, b)  # those that begin before the span's end
        return i > 0 and reach[i - 1] > a
    return meets


def scan(docs: DataFrame, find: Callable[[str], list[Span]], id_col: str, text_col: str) -> DataFrame:
    """doc_id, spans for every row; a null text is empty."""
    def fn(batches):
        for b in batches:
            text = b.column("text")
            for i in range(0, b.num_rows, 256):
                got = [find(t) if t else [] for t in text[i:i + 256].to_pylist()]
                rows = [[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in x] for x in got]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:i + 256], pa.array(rows, _ARROW)], names=["doc_id", "spans"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(fn, f"doc_id long, spans {SPANS}")


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """'kind:start:end' of the spans of these kinds, by start, then kind as
    listed, comma-joined."""
    listed = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(F.filter(spans, lambda x: x["kind"].isin(*kinds)),
                        lambda x: F.struct(x["start"].alias("s"), F.array_position(listed, x["kind"]).alias("k"), x["end"].alias("e"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame, base: tuple[str, ...], added: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256, spans, n_<kind> of the
    added kinds, n_spans (all), max_score (0 without spans)."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [count(k) for k in base]
    return found.select("doc_id", *n, F.sha2(joined(F.col("spans"), base), 256).alias("base_sha256"),
                        joined(F.col("spans"), base + added).alias("spans"), *[count(k) for k in added],
                        F.size("spans").cast("long").alias("n_spans"),
                        F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)).alias("max_score"))
