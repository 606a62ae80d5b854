"""Run a registered query in Spark and its SQL in DuckDB and compare.

Mirrors the driver's check: row count, column names (sorted), and an
order-insensitive comparison of the values.
"""
from __future__ import annotations

import math

from quarry.sources.tables import TABLES


def duckdb_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if v is not None and type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def compare(spark, con, name, spark_fn, sql, sf_dir):
    sdf = spark_fn(spark, sf_dir)
    scols = sorted(sdf.columns)
    srows = [tuple(_norm(r[c]) for c in scols) for r in sdf.collect()]
    res = con.execute(sql)
    dcols_raw = [d[0] for d in res.description]
    drows_raw = res.fetchall()
    dcols = sorted(dcols_raw)
    idx = [dcols_raw.index(c) for c in dcols]
    drows = [tuple(_norm(r[i]) for i in idx) for r in drows_raw]
    out = {"name": name, "spark_rows": len(srows), "oracle_rows": len(drows),
           "cols_match": scols == dcols}
    if scols != dcols:
        out["spark_cols"], out["oracle_cols"] = scols, dcols
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    a, b = sorted(srows, key=key), sorted(drows, key=key)
    out["values_match"] = a == b
    if not out["values_match"]:
        sa, sb = set(a), set(b)
        out["only_spark"] = list(sa - sb)[:3]
        out["only_oracle"] = list(sb - sa)[:3]
    return out
