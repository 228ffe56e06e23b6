"""Pairs of a stop and a line, many times the input, stay where their stop lies."""

import re

import pytest

from __spark_entry__ import queries
from wayloom.operators import matching as mt
from wayloom.operators import spatial as sp

DATA = "/root/testdata/sf0.001"


def _keys(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [set(re.findall(r"(\w+)#", x)) for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]


@pytest.mark.parametrize("name, keys", [("match_candidates", {"stop_id"}), ("lateral_offset", {"stop_id"}), ("match_labels", {"stop_id"}), ("runtime_coverage", {"_cy", "_cx"})])
def test_pairs_are_not_moved_by_stop_or_cell(spark, name, keys):
    found = _keys(queries()[name](spark, DATA))
    assert {"_rx", "_ry"} in found
    assert {"_cy", "_cx"} not in found
    assert name == "runtime_coverage" or keys not in found


def test_course_of_a_segment_gives_the_offset_of_the_whole_line(spark):
    line = spark.createDataFrame([(1, k, 9.9 + 0.001 * (k % 3), -84.0 + 0.0007 * k) for k in range(40)] + [(2, 0, 9.9, -84.0), (2, 1, 9.9, -83.97)], "variant_id bigint, seq int, lat double, lng double")
    stops = spark.createDataFrame([(k, 9.9 + 0.00003 * k, -84.0 + 0.00034 * k) for k in range(70)], "stop_id bigint, lat double, lng double")
    segs = sp.segments(line, "variant_id", "seq").cache()
    variants = spark.createDataFrame([(v, "r", "f", "ida", False) for v in (1, 2)], "variant_id bigint, route_code string, family string, direction string, ambiguous boolean")
    got = mt.candidates(stops, segs, variants, spark.createDataFrame([(0, 1)], "stop_id bigint, variant_id bigint"), lateral=True)
    near = sp.line_join(stops, segs, "variant_id", "stop_id", mt.SNAP_M).join(stops, "stop_id")
    want = {(r.stop_id, r.variant_id): r.lateral_m for r in mt.lateral_offset(near, segs, "variant_id").collect()}
    rows = {(r.stop_id, r.variant_id): r.lateral_m for r in got.collect()}
    assert len(rows) > 40 and (0, 1) in want and (0, 1) not in rows
    assert rows == {k: pytest.approx(v, abs=1e-6) for k, v in want.items() if k != (0, 1)}
