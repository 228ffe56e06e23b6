"""The live state as a stream of files, against the same state as a table."""

from __future__ import annotations

import json
import time

from wayloom.operators import live as lv
from wayloom.streaming import fleet


def test_stream(spark, tmp_path):
    rows = [
        {"arrival": 1, "driver_id": "a", "ts": "2024-01-01T00:00:10Z", "lat": 9.8, "lng": -83.9, "route": "300"},
        {"arrival": 2, "driver_id": "a", "ts": "2024-01-01T00:00:05Z", "lat": 9.9, "lng": -83.9},  # came later, though its time is before
        {"arrival": 3, "driver_id": None, "ts": None, "lat": 9.9, "lng": -83.9},
        {"arrival": 4, "driver_id": "b", "ts": "no time", "lat": 9.7, "lng": -83.9},
        {"arrival": 5, "driver_id": "c", "ts": "2024-01-01T00:00:05Z", "lng": -83.9},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    read = fleet.read_positions(spark, str(tmp_path / "in"))
    out = fleet.write_updates(fleet.tracked(read, expire_s=1), str(tmp_path / "out"), str(tmp_path / "mark")).trigger(processingTime="1 second").start()
    try:
        got = set()
        for _ in range(60):
            time.sleep(1)
            if list((tmp_path / "out").glob("batch=*/_SUCCESS")):
                got = {(r.driver_id, r.arrival, r.route, r.event) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
            if ("a", 2, "Desconocida", "expired") in got and ("b", 4, "Desconocida", "expired") in got:
                break
    finally:
        out.stop()
    updates = {x[:3] for x in got if x[3] == "update"}
    table = lv.latest(lv.cleaned(spark.createDataFrame(rows, fleet.POSITION)))
    assert updates == {(r.driver_id, r.arrival, r.route) for r in table.collect()} == {("a", 2, "Desconocida"), ("b", 4, "Desconocida")}
    assert {x[:3] for x in got if x[3] == "expired"} == updates


def test_ages(spark):
    from pyspark.sql import functions as F

    made = spark.sql("SELECT explode(array(30000, 30001, 120000, 120001)) AS ms").select("ms", (F.timestamp_millis(F.lit(10**12)) - F.make_dt_interval(secs=F.col("ms") / 1000)).alias("last"))
    got = {r.ms: r.freshness for r in lv.aged(made, F.timestamp_millis(F.lit(10**12))).collect()}
    assert got == {30000: "fresh", 30001: "stale", 120000: "stale", 120001: "expired"}


def test_eta_steps(spark):
    routes = spark.createDataFrame([(1, "300", "Cartago", 800), (2, "77", "Taras", 10), (3, "", "Único – X", 160), (4, "999", "none", 0)], "route_id bigint, code string, route_name string, dist_m int")
    live = [("a", "R-300", "fresh"), ("b", "300", "fresh"), ("c", "x300", "fresh"), ("d", "77", "stale"), ("e", "unico x", "fresh"), ("f", "999", "expired")]
    got = {r.route_id: (r.fresh, r.stale, r.wait_min, r.walk_min, r.confidence) for r in lv.eta(routes, spark.createDataFrame(live, "driver_id string, route string, freshness string")).collect()}
    assert got == {1: (3, 0, 2, 10, "alta"), 2: (0, 1, 10, 1, "baja"), 3: (1, 0, 6, 2, "media"), 4: (0, 0, 14, 1, "baja")}
