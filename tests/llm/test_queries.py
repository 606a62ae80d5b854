"""Queries with SQL equal it; the entry file works with and without llm."""
import subprocess
import sys

import pytest

from quarry.llm import queries as Q
from quarry.plans.oracle import compare, duckdb_connect
from tests.conftest import SF001


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_sql(spark, name):
    r = compare(spark, duckdb_connect(SF001), name, Q.QUERIES[name], Q.ORACLE[name], SF001)
    assert r["cols_match"] and r["values_match"] and r["spark_rows"] == r["oracle_rows"], r


def test_all_registered():
    import __spark_entry__ as E
    names = E.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names


def test_entry_without_llm():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("quarry.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as E
q = E.queries()
assert q and "pipeline" not in q and not any(n.startswith("op1_") for n in q)
E.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
