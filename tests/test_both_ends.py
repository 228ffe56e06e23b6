"""Both ends of a search meet their patterns in one join, move once, and waits are asked of what can be ridden only."""

import re

from __spark_entry__ import oracle_sql, queries
from wayloom.operators import search as se

DATA = "/root/testdata/sf0.001"


def _world(spark):
    stops = [(p, s, 100 * p + s, s != 2, s != 3) for p in (1, 2) for s in range(1, 13)]
    pattern_stops = spark.createDataFrame(stops, "pattern_id bigint, seq int, stop_id bigint, board boolean, alight boolean")
    patterns = spark.createDataFrame([(1, 7, "local"), (2, 8, "expreso")], "pattern_id bigint, route_id bigint, category string")
    near_o = spark.createDataFrame([(5, 100 + s, 100 * s) for s in range(1, 7)] + [(5, 99, 5)], "qid bigint, stop_id bigint, dist int")
    near_d = spark.createDataFrame([(5, 100 + s, 50 * s) for s in (3, 9, 10, 11, 12)] + [(5, 201, 5)], "qid bigint, stop_id bigint, dist int")
    return near_o, near_d, pattern_stops, patterns, spark.createDataFrame([(5, 480)], "qid bigint, minute int")


def test_ends_are_the_candidates_of_each_side(spark):
    near_o, near_d, ps, pt, q = _world(spark)
    ends = se.both_ends(near_o, near_d, ps, pt, q).cache()
    for side, near, flag in (("_o", near_o, "board"), ("_e", near_d, "alight")):
        rows = lambda df: sorted((r.qid, r.pattern_id, r.route_id, r.category, r.stop_id, r.seq, r.dist) for r in df.collect())
        assert rows(se.end_rows(ends, side)) == rows(se.candidates(near, ps, pt, flag)) != []
    assert {r.pattern_id for r in se.riding(ends).collect()} == {1}
    assert {r.minute for r in ends.collect()} == {480}


def test_without_a_cap_no_candidate_is_left_out(spark):
    near_o, near_d, ps, pt, q = _world(spark)
    found = {r.pattern_id: (sorted(x.seq for x in r._o), sorted(x.seq for x in r._e)) for r in se.both_ends(near_o, near_d, ps, pt, q, cap=None).collect()}
    assert found == {1: ([1, 3, 4, 5, 6], [9, 10, 11, 12]), 2: ([], [1])}
    assert {len(r._o) for r in se.both_ends(near_o, near_d, ps, pt, q).filter("pattern_id = 1").collect()} == {3}


def test_nothing_of_search_direct_moves_by_query_and_pattern_but_what_is_ridden(spark):
    rows = queries()["search_direct"](spark, DATA)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "FileScan parquet [p_partkey" not in plan and not re.search(r"HashAggregate\(keys=\[qid#\w+, pattern_id#\w+\]", plan)  # pairs asked for were made distinct


def test_diverse_topk_leaves_no_candidate_out(spark, monkeypatch):
    caps, real = [], se.both_ends
    monkeypatch.setattr(se, "both_ends", lambda *a: caps.append(a[5]) or real(*a))
    assert queries()["diverse_topk"](spark, DATA).count() > 0
    assert caps == [None]
    assert "900" not in oracle_sql()["diverse_topk"] and "900" in oracle_sql()["search_direct"]
