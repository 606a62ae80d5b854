"""Plan shape of every registered query: no cartesian product or nested
loop join; pushdown of constant filters into the Parquet scan."""
import pytest

from quarry.plans import load_all
from tests.conftest import SF001

REG = load_all()


@pytest.mark.parametrize("name", sorted(REG.QUERIES))
def test_no_cross_join(spark, name):
    plan = REG.QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_filters_pushed(spark):
    plan = REG.QUERIES["question_intake"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(role), IsNotNull(text), EqualTo(role,user)]" in plan or \
        "EqualTo(role,user)" in plan
    plan = REG.QUERIES["cache_lookup_union"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(ts," in plan and "GreaterThanOrEqual(ts," in plan


def test_scan_prunes_columns(spark):
    plan = REG.QUERIES["answer_preview"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan
    plan = REG.QUERIES["stage_split"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "event_id" not in plan.split("ReadSchema")[1].split("\n")[0]
