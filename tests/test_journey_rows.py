"""Small cases of alerts, journey mapping and journey measures."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from wayloom.operators import alerts as al
from wayloom.operators import itineraries as it
from wayloom.operators import metrics as me


def _fired(etas, thresholds):
    """One evaluation after the other: what was fired stays fired until the eta is far again."""
    out, done, prev = [], set(), None
    for tick, eta in etas:
        if eta is None:
            continue
        at = [t for t in sorted(set(thresholds), reverse=True) if t not in done and eta <= t and (prev is None or prev > t)]
        if at:
            done.add(at[0])
            out.append((tick, at[0], eta))
        elif thresholds and eta > max(thresholds) + 4:
            done = set()
        prev = eta
    return out


def test_alerts_fire_as_in_a_pass_over_the_ticks(spark):
    r = random.Random(5)
    etas = {q: [(t, r.choice((None, *range(18)))) for t in range(80)] for q in range(6)}
    alerts = {i: (i % 7, r.choice(([10, 5, 2], [3, 8], [4], [6, 6, 1, 12], []))) for i in range(30)}
    got = al.threshold_alerts(
        spark.createDataFrame([(q, t, e) for q, rows in etas.items() for t, e in rows], "route_id long, tick long, eta int"),
        spark.createDataFrame([(i, q, th) for i, (q, th) in alerts.items()], "alert_id long, route_id long, thresholds array<int>"),
    ).collect()
    for i, (q, th) in alerts.items():
        assert sorted((x.tick, x.threshold, x.eta) for x in got if x.alert_id == i) == sorted(_fired(etas.get(q, []), th))


def test_walks_by_place_and_duplicates(spark):
    legs = [
        (1, 1, False, None, None, None, 50), (1, 2, True, 7, 1, 2, None), (1, 3, False, None, None, None, 80), (1, 4, True, 7, 3, 4, 999), (1, 5, False, None, None, None, None),
        (2, 1, False, None, None, None, 10), (3, 1, True, 7, 1, 2, None), (4, 1, True, 7, 1, 2, None),
    ]
    context = [(1, 9, 480, 490, 520, 100, 200), (2, 9, 480, 490, 520, 100, 200), (3, 9, 480, 480, 500, 70, 0), (4, 9, 480, 470, 495, 70, 0)]
    got = it.deduplicated(it.mapped(
        spark.createDataFrame(legs, "itinerary_id long, leg int, ride boolean, route_id long, from_stop long, to_stop long, metres int"),
        spark.createDataFrame(context, "itinerary_id long, qid long, asked int, departure int, arrival int, from_m int, to_m int"),
    )).orderBy("rank").collect()
    assert [x.itinerary_id for x in got] == [3, 1]
    last = got[1]
    assert (last.origin_walk_m, last.transfer_walk_m, last.final_walk_m, last.total_walk_m) == (150, 80, 200, 430)
    assert last.route_ids == [7] and last.signature == "7|1-2,3-4|430"
    assert abs(last.score - (30 + 2.5 + 430 / 70 + 12)) < 1e-9 and got[0].score == 21.0


def test_measures_of_unknown_stops_are_null(spark):
    names = [f"{p}_{x}" for p in ("b1", "a1", "b2", "a2") for x in ("lat", "lng")]
    rows = spark.range(2).select(
        F.lit(9.8).alias("o_lat"), F.lit(-83.9).alias("o_lng"), F.when(F.col("id") == 0, 9.9).otherwise(9.8).alias("d_lat"), F.lit(-83.9).alias("d_lng"), *[F.lit(None).cast("double").alias(n) for n in names],
        (F.col("id") == 0).alias("two"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("int").alias("change_m"),
        *[F.lit(None).cast("int").alias(f"{p}_shape_m") for p in ("b1", "a1", "b2", "a2")],
    )
    far, here = me.journey_metrics(rows).orderBy(F.desc("straight_line_m")).collect()
    assert far.straight_line_m == 11119 and far.total_walk_m is None and far.max_shape_stop_distance_m is None and far.final_stop_progress_ratio is None
    assert far.transfer_quality_label == "walk" and far.transfer_quality_score == 0.52 + 0.154 + 0.1 and far.score_adjustment == 80 + 41 and far.quality_flags == []
    assert here.straight_line_m == 0 and here.total_walk_ratio is None and here.score_adjustment == 0 and here.geo_confidence_score == 1.0
