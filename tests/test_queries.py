"""Every registered query: its SQL, its plan and the driver contract."""

import pytest
from compare import compare, duck

import __spark_entry__ as contract
from narralake.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
FORBIDDEN = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "FlatMapGroupsInPandas",
)


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, small, name):
    ok, note = compare(spark, con, small, name, QUERIES[name], ORACLES[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream_", "incremental"))))
def test_plan_has_no_pairing_and_no_python(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]


def test_contract(spark):
    assert QUERIES.keys() == ORACLES.keys()
    assert contract.queries().keys() >= QUERIES.keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()
    assert contract.entry(spark).count() > 0
