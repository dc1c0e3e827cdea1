import re

import pytest
from compare import difference, duck

from marginalia.llm.registry import ORACLES, QUERIES

NATIVE = {"op2_quality_rules", "op5_url_filters", "op6_sharding"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, name) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_distributed(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Window \[.*\], \[\](,|$)", plan) and "Exchange SinglePartition" not in plan
    if name in NATIVE:
        assert not re.search("Python|Pandas|Arrow", plan)


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
