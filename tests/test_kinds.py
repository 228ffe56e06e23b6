"""Rows that only differ by an id are worked on once: alerts of one route and thresholds, vehicles of one text, routes of one code."""

import random

from wayloom.operators import alerts as al
from wayloom.operators import live as lv


def test_alerts_of_a_kind_are_followed_once(spark, monkeypatch):
    sizes = []

    def counted(df, name, put=al.written):
        out = put(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(al, "written", counted)
    etas = spark.createDataFrame([(1, k, e) for k, e in enumerate((9, 4, 1, 16, 5, 1))], "route_id bigint, tick bigint, eta int")
    alerts = spark.createDataFrame([(k, 1, [2, 5]) for k in range(30)] + [(7, 1, [5, 2]), (99, 2, [5])], "alert_id bigint, route_id bigint, thresholds array<int>")
    got = sorted(tuple(r) for r in al.threshold_alerts(etas, alerts).collect())
    assert got == sorted((k, t, th, e) for k in range(30) for t, th, e in ((1, 5, 4), (2, 2, 1), (4, 5, 5), (5, 2, 1)))
    assert max(n for _, n in sizes) <= 8  # it was 120


def test_vehicles_are_met_by_text(spark):
    rng = random.Random(3)
    codes = ["1", "12", "linea-7", "", None, "a b"]
    routes = [(k, rng.choice(codes), rng.choice(["12", "Bus 1", None, "x"]), 100) for k in range(60)] + [(1, "12", "x", 100), (2, "linea-7", None, 100)]
    cars = [(f"d{rng.randrange(40)}", rng.choice(["12", "Bus 12", "1", "ab", "x", "5", "", None, "Linea 7"]), rng.choice(["fresh", "stale", "expired"])) for _ in range(120)]
    key = lambda x: "".join(c for c in (x or "").lower() if c.isalnum())
    want = set()
    for r, code, name, _ in routes:
        met = {(d, f) for d, t, f in cars if f != "expired" and t is not None and (key(t) == str(r) or (key(code) and key(code) in key(t)) or (key(name) and key(name) == key(t)))}
        want |= {(r, x) for x in met}
    got = lv.eta(spark.createDataFrame(routes, "route_id bigint, code string, route_name string, dist_m int"), spark.createDataFrame(cars, "driver_id string, route string, freshness string"))
    for r in got.collect():
        assert (r.matched, r.fresh) == (sum(a == r.route_id for a, _ in want), sum(a == r.route_id and x[1] == "fresh" for a, x in want))


def _widest_join(spark, rows) -> int:
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    rows.collect()
    most, runs = 0, store.executionsList()
    for i in range(before, runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for m in (node.metrics().apply(j) for j in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined():
                    most = max(most, int(values.get(m.accumulatorId()).get().replace(",", "")))
    return most


def test_routes_of_one_code_meet_no_vehicle_each(spark):
    routes = spark.createDataFrame([(k, "77", f"r{k}", 100) for k in range(200)], "route_id bigint, code string, route_name string, dist_m int")
    cars = spark.createDataFrame([(f"d{k}", "Bus 77", "fresh") for k in range(200)], "driver_id string, route string, freshness string")
    out = lv.eta(routes, cars)
    assert 0 < _widest_join(spark, out) <= 400  # it was 40,000
    assert {(r.matched, r.fresh) for r in out.collect()} == {(200, 200)}
