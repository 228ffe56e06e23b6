"""Hand-made cases of the library's operators: ties, gaps, nulls, edges."""

from __future__ import annotations

import json

from wayloom.operators import audit as au
from wayloom.operators import edits as ed
from wayloom.operators import matching as mt
from wayloom.operators import ranking as rk
from wayloom.operators import search as se
from wayloom.operators import spatial as sp
from wayloom.operators import timetable as tt
from wayloom.sources import geojson

STOPS = "stop_id bigint, lat double, lng double"


def _arcs(spark, patterns: dict[int, list[int]]):
    rows = [(p, k + 1, s) for p, line in patterns.items() for k, s in enumerate(line)]
    stops = [(s, 9.8 + s / 100, -83.9) for s in range(1, 8)] + [(8, 9.8 + 1 / 100 + 0.0004, -83.9)]  # 8 is 44 m from 1
    got = tt.arcs(spark.createDataFrame(rows, "pattern_id bigint, seq int, stop_id bigint"), spark.createDataFrame(stops, STOPS)).collect()
    out: dict = {}
    for r in sorted(got, key=lambda r: (r.pattern_id, r.arc, r.pos)):
        out.setdefault((r.pattern_id, r.arc, r.reason), []).append(r.stop_id)
    return out


def test_arcs(spark):
    got = _arcs(spark, {1: [1, 2, 3], 2: [1, 1, 2, 2, 3], 3: [1, 2, 3, 1], 4: [1, 2, 3, 8], 5: [1, 2, 3, 2, 4], 6: [5], 7: [1, 2, 3, 2, 4, 1]})
    assert got == {
        (1, 1, "linear"): [1, 2, 3], (2, 1, "linear"): [1, 2, 3], (3, 1, "loop"): [1, 2, 3], (4, 1, "loop"): [1, 2, 3],
        (5, 1, "revisit"): [1, 2, 3], (5, 2, "revisit"): [3, 2, 4], (7, 1, "loop"): [1, 2, 3, 4],
    }


def test_departures(spark):
    rows = [(1, 10, "habil", 300, 360, 30, True), (2, 11, "habil", 1400, 20, 30, None), (3, 12, "habil", 300, 300, 30, True), (4, 13, "habil", 300, 360, 30, False), (5, 14, "habil", 300, 302, 0, True)]
    got: dict = {}
    for r in tt.departures(spark.createDataFrame(rows, "pattern_id bigint, window_id bigint, day_type string, start int, stop int, headway int, active boolean")).collect():
        got.setdefault(r.pattern_id, []).append(r.departure)
    assert got == {1: [300, 330, 360], 2: [1400, 1430, 1460], 5: [300, 301, 302]}  # over midnight; null flag active; headway at least 1


def test_waits(spark):
    windows = spark.createDataFrame([(1, 10, "habil", 300, 360, 20, None), (1, 11, "habil", 350, 400, 10, True), (1, 12, "habil", 350, 400, 30, True)], "pattern_id bigint, window_id bigint, day_type string, start int, stop int, headway int, active boolean")
    asked = spark.createDataFrame([(q, 1) for q in range(5)], "qid bigint, pattern_id bigint")
    queries = spark.createDataFrame([(0, 300), (1, 349), (2, 350), (3, 400), (4, 299)], "qid bigint, minute int")
    assert {r.qid: r.wait for r in se.waits(asked, windows, queries, "habil").collect()} == {0: 10, 1: 10, 2: 15, 3: 12, 4: 12}  # half-open; ties to the larger id


def test_radius_anywhere(spark):
    points = [(0, 0.0, 179.9995), (1, 60.0, 10.0), (2, -70.0, -20.0), (3, 9.8, -83.9)]
    other = [(10, 0.0, -179.9995), (11, 60.0, 10.0015), (12, -70.0004, -20.002), (13, 9.8, -83.8985), (14, 60.0, 10.01)]
    a, b = spark.createDataFrame(points, "a int, lat double, lng double"), spark.createDataFrame(other, "b int, r_lat double, r_lng double")
    assert {(r.a, r.b) for r in sp.radius_join(a, b, 180).collect()} == {(0, 10), (1, 11), (2, 12), (3, 13)}
    hubs = spark.createDataFrame([(1, 9.8, -83.9, 5000), (2, 9.8, -83.9, 100)], "hub int, r_lat double, r_lng double, radius int")
    ends = spark.createDataFrame([(1, 9.84, -83.9), (2, 9.8, -83.9), (3, 9.9, -83.9)], "q int, lat double, lng double")
    assert {(r.q, r.hub) for r in sp.circle_join(ends, hubs, "radius").collect()} == {(1, 1), (2, 1), (2, 2)}  # 4.4 km from a hub of 5 km


def test_side_of_line(spark):
    pts = spark.createDataFrame([(1, k, 9.8, -83.9 + k / 1000) for k in range(5)], "line bigint, seq int, lat double, lng double")
    segs = sp.segments(pts, "line", "seq").withColumnRenamed("line", "variant_id")
    stops = spark.createDataFrame([(1, 9.8002, -83.898), (2, 9.7998, -83.898), (3, 9.81, -83.898)], STOPS)
    near = sp.line_join(stops, segs, "variant_id", "stop_id", 65)
    got = {r.stop_id: (round(r.fraction, 3), r.lateral_m) for r in mt.lateral_offset(near.join(stops, "stop_id"), segs, "variant_id").collect()}
    assert set(got) == {1, 2} and got[1][0] == 0.5 and 20 < got[1][1] < 25 and -25 < got[2][1] < -20


def test_reasons(spark):
    j = [  # far drop with a near alternative by the same route; a change with a direct one; a short hop
        (1, 1, 1, ["A"], 100, 1500, 0, 10, 0), (1, 2, 1, ["A"], 100, 300, 0, 12, 0), (2, 1, 2, ["A", "B"], 100, 100, 50, 10, 0), (2, 2, 1, ["A"], 200, 200, 0, 20, 0), (3, 1, 1, ["C"], 400, 400, 0, 5, 3),
    ]
    df = spark.createDataFrame([(*x[:4], x[3][0], *x[4:7], x[4] + x[5] + x[6], *x[7:], 800 if x[0] == 3 else 5000) for x in j], "qid bigint, journey_id bigint, n_legs int, routes array<string>, first_route string, origin_walk_m int, final_walk_m int, transfer_walk_m int, total_walk_m int, score int, eta_min int, trip_m int")
    reasons = rk.alternatives(df)
    assert {(r.qid, r.journey_id, r.reason) for r in reasons.collect()} == {(1, 1, "far_drop"), (1, 1, "walk_dominant"), (2, 1, "direct_alternative"), (3, 1, "walk_vs_wait")}
    more = spark.createDataFrame([(3, 1, "hint", 3.0), (3, 1, "cancel-hint", -3.0), (2, 2, "hint", 3.0), (2, 2, "cancel-hint", -1.5)], "qid bigint, journey_id bigint, reason string, points double")
    got = {(r.qid, r.journey_id): (r.rank, r.display_score, r.reasons) for r in rk.ranked(df, reasons.unionByName(more)).collect()}
    assert got[(3, 1)] == (1, 5 + 4.2 + 8, ["walk_vs_wait"]) and got[(2, 2)] == (1, 21.5, ["cancel-hint", "hint"]) and got[(2, 1)][0] == 2 and got[(1, 2)][0] == 1


def test_golden(spark):
    rows = [(1, "Cartago – Paraíso", "x", "y", ["PARAISO"], None, None), (2, "Taras", "Parque", "y", ["zz"], ["taras centro"], None), (3, "Taras", "Parque", "y", ["zz"], ["taras"], ["iglesia"]), (4, None, "x", "y", ["a"], ["b"], None), (5, "Tejar", "x", "y", None, None, None)]
    names = "case_id int, title string, board string, final string, never array<string>, expected array<string>, expected_board array<string>"
    from pyspark.sql import functions as F

    cases = spark.createDataFrame(rows, names).withColumns({c: F.lit(None).cast("array<string>") for c in ("never_board", "never_final", "expected_final")}).withColumn("acceptable", F.array(F.lit("TEJAR")))
    assert {r.case_id: r.status for r in au.judged(cases).collect()} == {1: "forbidden", 2: "pass", 3: "unexpected", 4: "empty", 5: "acceptable"}


def test_edits(spark):
    rows = spark.createDataFrame([(1, k + 1, s) for k, s in enumerate((5, 6, 7, 5))], "pattern_id bigint, seq int, stop_id bigint")
    from pyspark.sql import functions as F

    assert [r.stop_id for r in ed.rotated(rows, F.lit(3)).orderBy("seq").collect()] == [7, 5, 6]  # both ends met and were one stop
    ids = spark.createDataFrame([(x,) for x in (30, -5, 30, 7)], "stop_id bigint")
    assert {r.stop_id: r.dense_id for r in ed.dense_ids(ids, "stop_id").collect()} == {-5: 0, 7: 1, 30: 2}


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"id": "7", "name": "Uno"}, "geometry": {"type": "Point", "coordinates": [-83.9, 9.8]}},
        {"type": "Feature", "properties": {"id": "x"}, "geometry": {"type": "Point", "coordinates": [-83.9, 9.8]}},
        {"type": "Feature", "properties": {"id": "r1"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}},
        {"type": "Feature", "properties": {"id": "r2"}, "geometry": {"type": "MultiLineString", "coordinates": [[[1, 2], [3, 4]], [[5, 6]]]}},
    ]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    rows = geojson.features(spark, str(tmp_path / "a.json"))
    assert [(r.stop_id, r.name, r.lat, r.lng) for r in geojson.stops(rows, "id", "name").collect()] == [(7, "Uno", 9.8, -83.9)]
    assert {(r.route_id, r.part, r.pos, r.lat) for r in geojson.routes(rows, "id").collect()} == {("r1", 1, 1, 2.0), ("r1", 1, 2, 4.0), ("r2", 1, 1, 2.0), ("r2", 1, 2, 4.0), ("r2", 2, 1, 6.0)}


def test_clock_minutes(spark):
    from pyspark.sql import functions as F

    from wayloom.functions.calendar import clock_minutes

    texts = ["05:30", "5:07:59", "25:10:60", "07:08:x", "7", "", "x:10", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", clock_minutes(F.col("t")).alias("m")).orderBy("i").collect()
    assert [r.m for r in rows] == [330, 307, 1511, 428, None, None, None, None]


def test_bearing(spark):
    from wayloom.functions.geo import bearing

    rows = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 1.0), (2, -1.0, 0.0), (3, 0.0, -1.0), (4, None, 1.0)], "i int, lat double, lng double").select("i", bearing(0.0, 0.0, "lat", "lng").alias("b")).orderBy("i").collect()
    assert [r.b for r in rows] == [0.0, 90.0, 180.0, -90.0, None]


def test_arcs_gather_a_pattern_once(spark):
    """The stops of a pattern are sorted and gathered in one aggregate; no window sorts them again, and the arcs aren't gathered from rows."""
    rows = spark.createDataFrame([(1, k, s) for k, s in enumerate([1, 1, 2, 3, 2, 4])] + [(2, 0, 5), (2, 1, 5)], "pattern_id bigint, seq int, stop_id bigint")
    got = tt.arc_lists(rows, spark.createDataFrame([(s, 9.0 + s, -84.0) for s in range(1, 6)], "stop_id bigint, lat double, lng double"))
    assert [(r.pattern_id, r.reason, [[x.stop_id for x in a] for a in r.arcs]) for r in got.collect()] == [(1, "revisit", [[1, 2, 3], [3, 2, 4]])]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Window" not in plan
