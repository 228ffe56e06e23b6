"""Tables that grow, and what is exploded from them, never go through the driver to be broadcast."""

import pytest

from __spark_entry__ import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["walk_edges", "walk_edges_conflict", "stop_areas_macro", "stop_areas_micro", "transfer_edges", "transfer_links", "nearby_stops", "expand_trips"])
def test_plan_has_no_broadcast(spark, name):
    rows = queries()[name](spark, DATA)
    rows.collect()
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()


def test_queries_of_raptor_direct_are_not_broadcast_and_starts_made_twice(spark):
    plan = queries()["raptor_direct"](spark, DATA)._jdf.queryExecution().executedPlan().toString()  # before it runs: what Spark plans by files alone
    assert "BroadcastHashJoin" not in plan
    assert plan.count("FileScan parquet [s_suppkey") == 4  # two scans make the starts: once to board from, once for what is known
