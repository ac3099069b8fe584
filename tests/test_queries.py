import os
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as registry
import check_oracle

from fleetratio.plans.catalogue import QUERIES
from oracle import ORACLE

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return check_oracle.duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(registry.queries()) and set(ORACLE) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    problem, n = check_oracle.compare(spark, con, SF, name)
    assert problem is None
    assert n > 0


@pytest.mark.parametrize("name", ["ratio_multi", "ratio_multi_groups", "expand_multi_raw", "unsampled_expansion", "boot_expand", "reconcile"])
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert bad not in plan


def test_ratio_table_scans_the_records_once(spark):
    plan = registry.queries()["ratio_multi"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_entry(spark):
    assert registry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("absent", ["fleetratio.llm", "xxhash"])
def test_the_rest_works_without_the_text_operators(absent):
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLE))], done.stderr
