import re
import subprocess
import sys
from pathlib import Path

import pytest
from compare import difference, duck

from __spark_entry__ import entry
from marginalia.catalog import ORACLES, QUERIES

ROOT = str(Path(__file__).resolve().parent.parent)
PYTHON = {"instruction_chain", "file_instructions", "convert_dispatch", "retry_error", "web_get_messages"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, name) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_distributed(spark, sf_dir, name):
    """No cross or nested-loop joins, no window over everything, Python only at the plug points."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Window \[.*\], \[\](,|$)", plan)
    for line in plan.split("\n"):
        if "Exchange SinglePartition" in line:
            assert name in {"no_match_notice", "wrap_decision", "find_files_notices"}
    assert ("Python" in plan or "ArrowEval" in plan) == (name in PYTHON)


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["doc_id", "path", "out"] and rows.count() > 0


@pytest.mark.parametrize("lost", ["marginalia.llm", "ahocorasick", "corpus_pipeline"])
def test_queries_load_without_the_training_data_operators(lost):
    """In a process of its own, in which one module cannot be imported."""
    code = f"import sys; sys.modules[{lost!r}] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True)
    count, pipeline = done.stdout.split()
    assert int(count) >= len(QUERIES) and pipeline == "False"
