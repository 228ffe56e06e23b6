"""Displayed scores, doubtful journeys and preferred groups on rows made for each rule."""

from __future__ import annotations

from wayloom.operators import context as cx

COLUMNS = "qid int, o_lat double, o_lng double, d_lat double, d_lng double, a1_lat double, a1_lng double, b2_lat double, b2_lng double, a2_lat double, a2_lng double, z_lat double, z_lng double, routes array<string>, route_ids array<int>, kind string, destination_name string, total_walk_m int, transfer_walk_m int, final_walk_m int, score int, eta_min int"
M = 1 / 111_194.93  # a metre of latitude


def row(qid=1, line=2000, a1=0.0, a2=None, routes=("Taras",), ids=(1,), kind=None, to=None, walk=0, change=0, final=0, score=10, eta=0, known=True):
    """A trip due north of ``line`` metres; a1 and a2 are where the rides end, in metres short of the destination."""
    lat = lambda left: None if left is None else 10 + (line - left) * M
    two = a2 is not None
    end = a2 if two else a1
    at = lambda x: (lat(x), None if x is None else -84.0)
    return (qid, 10.0 if known else None, -84.0, 10 + line * M, -84.0, *at(a1), *(at(a1) if two else (None, None)), *at(a2), *at(end), list(routes) if routes is not None else None, list(ids) if ids is not None else None, kind or ("transfer" if two else "direct"), to, walk, change, final, score, eta)


def scores(spark, *rows):
    out = cx.display_scores(spark.createDataFrame(list(rows), COLUMNS)).collect()
    return [({r.id: r.points for r in x.reasons}, x.display_score) for x in out]


def test_reasons(spark):
    got = scores(
        spark,
        row(a1=0, eta=10),  # at the door
        row(a1=2300),  # away from it, and past it
        row(line=5000, a1=5300),
        row(a1=1900), row(a1=1700), row(a1=1100), row(line=9000, a1=9400),
        row(a1=1000, walk=900), row(line=2000, a1=100, walk=830), row(a1=300, a2=50, change=50), row(a1=900, a2=800, change=60), row(a1=800, a2=580, change=90),
        row(a1=300, a2=50, change=10, routes=("San  José", "x"), to="San José"), row(a1=300, a2=50, change=10, routes=("Limón", "Taras"), to="LIMON centro"),
    )
    assert got[0] == ({}, 24.0)
    assert got[1][0] == {"first-leg-backtrack-high": 28, "final-stop-backtrack-high": 14, "direct-progress-poor": 6}
    assert got[2][0] == {"first-leg-backtrack-high": 18, "final-stop-backtrack-high": 9, "direct-progress-poor": 4}
    assert got[3][0] == {"first-leg-progress-very-low": 18, "final-stop-progress-very-low": 12, "direct-progress-poor": 6}
    assert got[4][0] == {"first-leg-progress-low": 10, "final-stop-progress-very-low": 12, "direct-progress-poor": 6}
    assert got[5][0] == {"final-stop-progress-low": 6}
    assert got[6] == ({}, 10.0)  # no local trip
    assert got[7][0] == {"final-stop-progress-low": 6, "total-walk-high": 8}
    assert got[8][0] == {}  # 0.415 of the line
    assert got[9][0] == {"cleanup-transfer-after-near-destination": 22}
    assert got[10][0] == {"cleanup-transfer-gain-tiny": 16}
    assert got[11][0] == {"cleanup-transfer-gain-limited": 10}
    assert got[12][0] == {}  # two spaces are no hint
    assert got[13][0] == {"interurban-plus-local-cleanup": 18}


def test_unknown_places_and_names(spark):
    got = scores(
        spark,
        row(known=False, routes=("Limón - Quepos",)),  # only names, at the lower points
        row(line=8000, routes=("Limón - Quepos",)), row(a1=None, routes=None, ids=None), row(line=0, a1=0), row(a1=None, walk=None, change=None, score=None, eta=None),
    )
    assert got[0] == ({"strong-interurban-LIMON": 3, "medium-interurban-QUEPOS": 1.5}, 14.5)
    assert got[1][0] == {"strong-interurban-LIMON": 7, "medium-interurban-QUEPOS": 3}
    assert got[2] == ({}, 10.0)
    assert got[3] == ({}, 10.0)  # origin and destination are one place: no ratio
    assert got[4] == ({}, None)
    assert scores(spark) == []


def test_coherent(spark):
    rows = [
        row(1, 9000, a1=300, a2=100, routes=("Limón", "Taras"), change=10),  # the change gains nothing
        row(1, 9000, a1=100),
        row(1, 9000, a1=12_000, a2=3000),  # the wrong way first
        row(2, 9000, a1=6000, routes=("Limón",), final=1500), row(2, 9000, a1=6000, routes=("Limón",), final=1600),  # all are incoherent: all stay
        row(None, 9000, a1=100), row(None, 9000, a1=6000, routes=("Limón",), final=1500),
        row(3, 13_000, a1=20_000, a2=9000),  # too far to judge
    ]
    flagged = cx.doubtful(cx.progress(spark.createDataFrame(rows, COLUMNS)))
    assert sorted((r.qid or 0, r.low_value, r.incoherent) for r in flagged.collect()) == [(0, False, False), (0, False, True), (1, False, False), (1, False, True), (1, True, False), (2, False, True), (2, False, True), (3, False, False)]
    assert sorted((r.qid or 0, r.final_walk_m) for r in cx.coherent(flagged).collect()) == [(0, 0), (1, 0), (2, 1500), (2, 1600), (3, 0)]


def test_preferred(spark):
    candidates = spark.createDataFrame(
        [(1, 7, 8, 40, 0, 1), (1, 7, None, 20, 90, 0), (1, 9, None, None, 0, 2), (2, 7, None, 300, None, 0), (4, 5, 6, 20, 12, 0), (4, 5, None, 20, 60, 1)],
        "qid int, product_route int, preview_route int, priority int, directness int, position int",
    )
    rows = [
        row(1, ids=(7,), score=100),  # the better of two groups: (180 - 20) / 4 and 12 - 10
        row(1, ids=(8,), score=100), row(1, ids=(9,), score=100), row(2, ids=(7,), score=3), row(3, ids=(7,), score=50),
        row(1, a1=1000, a2=100, ids=(3, 7), routes=("a", "b"), score=100), row(1, a1=300, a2=100, ids=(3, 7), routes=("Limón", "b"), score=100),
        row(4, ids=(5,), score=None), row(4, ids=(5,), score=100), row(None, ids=(7,), score=5), row(1, ids=None, routes=None, score=5),
    ]
    got = [(r.boost, r.biased_score) for r in cx.preferred(cx.progress(spark.createDataFrame(rows, COLUMNS).coalesce(1)).withColumn("n", cx.F.monotonically_increasing_id()), candidates).orderBy("n").collect()]
    assert got == [(42, 58), (47, 53), (0, 100), (8, 0), (0, 50), (17, 83), (0, 100), (50, None), (50, 50), (0, 5), (0, 5)]
    assert cx.preferred(cx.progress(spark.createDataFrame([], COLUMNS)), candidates).count() == 0
