"""Every query that SQL can express returns what the SQL returns, without Python workers or all-pairs joins."""

import pytest

from check_oracle import compare, oracle_connection
from scrubwell.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, connection, name):
    frame = QUERIES[name](spark, SF)
    assert compare(frame, connection, name) is None
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


@pytest.mark.parametrize(
    "name",
    ["eval_regression", "eval_classification", "eval_text", "eval_classification_words", "compare_versions", "compare_text_versions"],
)
def test_models_run(spark, name):
    assert all(r["status"] == "ok" for r in QUERIES[name](spark, SF).collect())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
