"""What is near a query is moved once, and the waits asked for aren't grouped again."""

import re

from __spark_entry__ import queries
from wayloom.operators import search as se
from wayloom.plans.network import near_stops
from wayloom.sources import bindings as b

DATA = "/root/testdata/sf0.001"


def _exchanges(df, *keys):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    found = [set(re.findall(r"(\w+)#", x)) for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]
    return sum(x == set(keys) for x in found)


def test_candidates_move_once(spark):
    got = se.candidates(near_stops(spark, DATA, name="dist"), b.pattern_stops(spark, DATA), b.patterns(spark, DATA).select("pattern_id", "route_id", "category"), "board")
    assert _exchanges(got, "qid", "pattern_id") == 0
    assert _exchanges(got, "qid") == 1


def test_waits_are_not_grouped_by_pair(spark):
    got = queries()["search_waits"](spark, DATA)
    assert _exchanges(got, "qid", "pattern_id") <= 1  # the pairs asked for, once


def test_waits_of_the_latest_window(spark):
    windows = spark.createDataFrame([(1, 1, "habil", 0, 100, 20, True), (1, 2, "habil", 50, 100, 30, None), (1, 3, "habil", 60, 70, 40, False), (1, 4, "sabado", 60, 99, 50, True), (2, 5, "habil", 0, 60, 10, True)], "pattern_id bigint, window_id int, day_type string, start int, stop int, headway int, active boolean")
    asked = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)], "qid bigint, pattern_id bigint")
    got = se.waits(asked, windows, spark.createDataFrame([(1, 65), (2, 10)], "qid bigint, minute int"), "habil")
    assert {(r.qid, r.pattern_id): (r.wait, r.headway) for r in got.collect()} == {(1, 1): (15, 30), (1, 2): (12, 24), (1, 3): (12, 24), (2, 1): (10, 20), (3, 1): (12, 24)}


def test_candidates_are_not_broadcast(spark):
    rows = queries()["search_direct"](spark, DATA)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "pattern_id" in x]  # the queries' own minutes may be
