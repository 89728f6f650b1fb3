"""The rows of the pages stay in many tasks, however small they are when shuffled."""

import pytest

import __spark_entry__ as E


@pytest.mark.parametrize("name", ["h14_repeated_items_customers", "h13_select_path"])
def test_pages_are_not_put_together(spark, name):
    d = E.queries()[name](spark, "/root/testdata/sf0.001")
    d.collect()
    plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "hashpartitioning(page_id" in plan and "REPARTITION_BY_NUM" in plan and "coalesced" not in plan
