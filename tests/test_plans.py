"""
products or nested-loop joins, and Arrow Python only at the intended sites."""

import pytest

from conftest import SF_SMALL

from quarry import registry

QUERIES = registry.queries()
# queries whose plans legitimately contain an Arrow Python node
PYTHON_SITES = {"screen_code"}
FORBIDDEN = ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")
ARROW = ("ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")
# these run their Python stages eagerly (trees, scores are checkpointed)
SKIP_BUILD = {"outliers_isolation", "outliers_isolation_rows", "idle_sessions_stream", "clean_plan_stream",
              "stream_counters"}


def _plan(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP_BUILD))
def test_plan_shape(spark, name):
    plan = _plan(spark, QUERIES[name](spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"
    if name not in PYTHON_SITES:
        for node in ARROW:
            assert node not in plan, f"{name}: unexpected {node}"
