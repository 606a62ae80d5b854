"""Developer check: compare registered queries with their DuckDB SQL.

    python tools_check.py [sf_dir] [name ...]
"""
import json
import sys
import time

from quarry.plans import load_all
from quarry.plans.oracle import compare, duckdb_connect
from quarry.session import local_session

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
reg = load_all()
spark = local_session(8)
con = duckdb_connect(sf)
bad = 0
for n, fn in reg.QUERIES.items():
    if names and n not in names:
        continue
    t = time.time()
    if n not in reg.ORACLE:
        rows = fn(spark, sf).count()
        print(json.dumps({"name": n, "rows_only": rows, "sec": round(time.time() - t, 2)}), flush=True)
        continue
    try:
        r = compare(spark, con, n, fn, reg.ORACLE[n], sf)
    except Exception as e:  # noqa: BLE001
        r = {"name": n, "error": repr(e)[:800]}
    r["sec"] = round(time.time() - t, 2)
    ok = r.get("values_match") and r.get("cols_match") and r["spark_rows"] == r["oracle_rows"]
    bad += not ok
    print(("OK  " if ok else "BAD ") + json.dumps(r, default=str)[:1500], flush=True)
print("mismatches:", bad)
