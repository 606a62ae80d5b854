"""Every registered query with SQL equals its DuckDB oracle (the driver's
correctness gate), at sf0.01."""
import pytest

from quarry.plans import load_all
from quarry.plans.oracle import compare, duckdb_connect
from tests.conftest import SF01

REG = load_all()


@pytest.fixture(scope="module")
def con():
    return duckdb_connect(SF01)


@pytest.mark.parametrize("name", sorted(REG.ORACLE))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, REG.QUERIES[name], REG.ORACLE[name], SF01)
    assert r["cols_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


@pytest.mark.parametrize("name", sorted(set(REG.QUERIES) - set(REG.ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert REG.QUERIES[name](spark, SF01).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["qid", "question", "answer", "sources", "from_cache", "served_by"]
