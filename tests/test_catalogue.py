import pytest

from fathomline.plans.catalogue import ORACLES, QUERIES
from tests.oracle import TESTDATA, rows_of, rows_of_sql

SF = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(ORACLES[name], SF)


def test_queries_without_sql(spark):
    assert sorted(set(QUERIES) - set(ORACLES)) == ["encoded_search"]
    assert QUERIES["encoded_search"](spark, SF).count() == 3 * 40


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 400
    assert set(QUERIES) <= set(entry.queries())


def test_plans(spark):
    plan = QUERIES["dense_filter_in"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "In(label, [1,4,7])" in plan.split("PushedFilters")[1] and "embedding" not in plan.split("ReadSchema")[1]
    assert "WindowGroupLimit" in QUERIES["dense_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
