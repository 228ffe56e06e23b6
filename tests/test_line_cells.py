"""Lines met with points by cells: every pair in reach, and each segment once a cell."""

import random

from pyspark.sql import functions as F

from wayloom.operators import spatial as sp


def _world(spark, at=60.0 - 0.4):
    rng = random.Random(5)
    ends = [(rng.uniform(at - 0.3, at + 0.3), rng.uniform(-0.8, 0.8)) for _ in range(60)]
    points = spark.createDataFrame([(k, *rng.choice(((x, y), (rng.uniform(at - 0.3, at + 0.3), rng.uniform(-0.8, 0.8))))) for k, (x, y) in enumerate(ends * 5)], "stop_id bigint, lat double, lng double")
    nodes = [(k // 4, k % 4, x, y) for k, (x, y) in enumerate(ends)] + [(90, 0, at, 0.0), (90, 1, at, 0.5), (91, 0, at - 0.2, 0.1), (91, 1, at + 0.2, 0.1)]
    return points, sp.segments(spark.createDataFrame(nodes, "line bigint, seq int, lat double, lng double"), "line", "seq")


def test_line_join_finds_what_all_pairs_find(spark):
    points, segs = _world(spark)
    got = sp.line_join(points, segs, "line", "stop_id", 900)
    want = sp.located(points.crossJoin(segs), ["stop_id", "line"]).filter("away_m <= 900")
    rows = lambda df: sorted((r.stop_id, r.line, round(r.fraction, 9), round(r.away_m, 6)) for r in df.collect())
    a, b = rows(got), rows(want)
    assert len(b) > 200
    assert a == b


def test_a_segment_takes_a_cell_once(spark):
    segs = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 0.1), (2, 0.0, 0.0, -0.1, 2.0), (3, 1.0, 1.0, -1.0, -1.0)], "line int, x1 double, y1 double, x2 double, y2 double")
    cells = sp.covered_cells(segs, 0.01, 0.001, 0.001)
    n = {r.line: (r.n, r.d) for r in cells.groupBy("line").agg(F.count("*").alias("n"), F.count_distinct("_cx", "_cy").alias("d")).collect()}
    assert all(a == b for a, b in n.values())
    # 200 columns, each with the cells of its height and reach
    assert n[1][0] <= 1.4 * 202 and n[2][0] <= 1.4 * 202 and n[3][0] <= 3 * 202
