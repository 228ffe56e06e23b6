"""Queries over vehicle positions, as tables; streaming/fleet.py has the same as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import live as lv
from ..sources import bindings as b
from .registry import query

_LATEST = ", clean AS (SELECT * FROM positions WHERE driver_id IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL), lt AS MATERIALIZED (SELECT driver_id, max(arrival) AS arrival, arg_max(ts, arrival) AS ts, arg_max(coalesce(route, 'Desconocida'), arrival) AS route, arg_max(status, arrival) AS status FROM clean GROUP BY driver_id), nw AS (SELECT max(ts) AS now FROM positions), ag AS MATERIALIZED (SELECT lt.*, (epoch_us(now) - epoch_us(ts)) // 1000 AS age FROM lt, nw)"
_CLASS = "CASE WHEN age <= 3600000 THEN 'fresh' WHEN age <= 43200000 THEN 'stale' ELSE 'expired' END"


def _state(spark, d):
    """Fresh: an hour, expired: half a day, as the test table's events are minutes apart. Now: the last event."""
    p = b.positions(spark, d)
    now = p.agg(F.max("ts").alias("now"))
    return lv.aged(lv.latest(lv.cleaned(p)).crossJoin(F.broadcast(now)), F.col("now"), 3600, 43200)


@query(b.with_tables("positions") + _LATEST + " SELECT driver_id, arrival, status, route FROM lt")
def live_latest(spark, d):
    return lv.latest(lv.cleaned(b.positions(spark, d))).select("driver_id", "arrival", "status", "route")


@query(b.with_tables("positions") + _LATEST + f" SELECT driver_id, CAST(age AS BIGINT) AS age_ms, {_CLASS} AS freshness FROM ag WHERE {_CLASS} <> 'expired'")
def live_fresh(spark, d):
    return _state(spark, d).filter("freshness <> 'expired'").select("driver_id", "age_ms", "freshness")


@query(b.with_tables("positions") + _LATEST + f" SELECT driver_id, CAST(age AS BIGINT) AS age_ms FROM ag WHERE {_CLASS} = 'expired'")
def live_expired(spark, d):
    return _state(spark, d).filter("freshness = 'expired'").select("driver_id", "age_ms")


@query(b.with_tables("positions", "routes") + _LATEST + f""", bus AS (SELECT driver_id, regexp_replace(lower(route), '[^a-z0-9]+', '', 'g') AS text, {_CLASS} AS fr FROM ag WHERE {_CLASS} <> 'expired'),
r AS (SELECT route_id, regexp_replace(lower(code), '[^a-z0-9]+', '', 'g') AS code, regexp_replace(lower(route_name), '[^a-z0-9]+', '', 'g') AS nm, CAST(route_id % 1500 AS INT) AS dist FROM routes),
m AS (SELECT route_id, dist, count(driver_id) AS matched, count(*) FILTER (fr = 'fresh') AS fresh FROM r LEFT JOIN bus ON text = CAST(route_id AS VARCHAR) OR contains(text, code) OR text = nm GROUP BY ALL),
w AS (SELECT *, CASE WHEN fresh >= 3 THEN 2 WHEN fresh = 2 THEN 4 WHEN fresh = 1 THEN 6 WHEN matched > 0 THEN 10 ELSE 14 END AS wait, CAST(greatest(1, floor(dist / 80.0 + 0.5)) AS INT) AS walk FROM m)
SELECT route_id, matched, fresh, matched - fresh AS stale, wait AS wait_min, walk AS walk_min, wait + walk AS eta_min, CASE WHEN fresh >= 2 THEN 'alta' WHEN fresh = 1 THEN 'media' ELSE 'baja' END AS confidence FROM w""")
def live_eta(spark, d):
    routes = b.routes(spark, d).withColumn("dist_m", (F.col("route_id") % 1500).cast("int"))
    return lv.eta(routes, _state(spark, d))
