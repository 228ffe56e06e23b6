"""Queries over edits of patterns and windows, nested output and numbering."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import edits as ed
from ..operators import timetable as tt
from ..sources import bindings as b
from ..sources import geojson
from .network import _LOOPS, _NEAR, M, _int, near_stops
from .registry import query


@query(b.with_tables("pattern_stops") + """, r AS (SELECT pattern_id, stop_id, CASE WHEN seq >= a THEN seq - a + 1 ELSE seq + m - a + 1 END AS s FROM (SELECT *, max(seq) OVER (PARTITION BY pattern_id) AS m, 1 + pattern_id % max(seq) OVER (PARTITION BY pattern_id) AS a FROM pattern_stops)),
q AS (SELECT *, lag(stop_id) OVER (PARTITION BY pattern_id ORDER BY s) AS p FROM r) SELECT pattern_id, CAST(row_number() OVER (PARTITION BY pattern_id ORDER BY s) AS INT) AS seq, stop_id FROM q WHERE p IS NULL OR p <> stop_id""")
def loop_rotate(spark, d):
    ps = b.pattern_stops(spark, d).select("pattern_id", "seq", "stop_id")
    return ed.rotated(ps, 1 + F.col("pattern_id") % F.max("seq").over(W.partitionBy("pattern_id")))


@query(b.with_tables("stops", "pattern_stops") + f""", rs AS (SELECT pattern_id, seq, stop_id, CAST(seq * 400 AS INT) AS cum_m, CAST(seq * 2 AS INT) AS cum_min FROM pattern_stops),
t AS (SELECT pattern_id, (pattern_id * 13) % 180 AS terminal, pattern_id % 2 = 1 AS at_start FROM (SELECT DISTINCT pattern_id FROM rs)),
e AS (SELECT pattern_id, arg_min(stop_id, seq) AS f, arg_max(stop_id, seq) AS l, max(seq) AS top, max(cum_m) AS tm, max(cum_min) AS tmin FROM rs GROUP BY pattern_id),
n AS (SELECT e.*, terminal, at_start, {_int(M('s.lat', 's.lng', 'x.lat', 'x.lng'))} AS m FROM e JOIN t USING (pattern_id) JOIN stops s ON s.stop_id = terminal JOIN stops x ON x.stop_id = CASE WHEN at_start THEN f ELSE l END WHERE NOT EXISTS (SELECT 1 FROM rs WHERE rs.pattern_id = e.pattern_id AND rs.stop_id = terminal)),
k AS (SELECT *, CAST(greatest(1, floor(m / 380.0 + 0.5)) AS INT) AS mi FROM n)
SELECT rs.pattern_id, rs.seq, rs.stop_id, rs.cum_m + coalesce(k.m, 0) AS cum_m, rs.cum_min + coalesce(k.mi, 0) AS cum_min FROM rs LEFT JOIN k ON k.pattern_id = rs.pattern_id AND k.at_start
UNION ALL SELECT pattern_id, CASE WHEN at_start THEN 0 ELSE top + 1 END, terminal, CASE WHEN at_start THEN 0 ELSE tm + m END, CASE WHEN at_start THEN 0 ELSE tmin + mi END FROM k""")
def endpoint_append(spark, d):
    """A terminal before the first stop of patterns with odd ids, and after the last of the others."""
    rows = b.pattern_stops(spark, d).select("pattern_id", "seq", "stop_id", (F.col("seq") * 400).cast("int").alias("cum_m"), (F.col("seq") * 2).cast("int").alias("cum_min"))
    k = F.col("pattern_id")
    return ed.with_terminals(rows, rows.select(k, ((k * 13) % 180).alias("terminal"), (k % 2 == 1).alias("at_start")).distinct(), b.stops(spark, d))


@query(b.with_tables("patterns", "pattern_stops") + """, g AS (SELECT c_custkey AS route_id, 1 + c_custkey % 2 AS low, 2 + c_custkey % 3 AS high FROM customer WHERE c_custkey % 3 <> 0)
SELECT pattern_id, seq, stop_id, board AND NOT EXISTS (SELECT 1 FROM g JOIN patterns p USING (route_id) WHERE p.pattern_id = s.pattern_id AND s.seq BETWEEN low AND high) AS board, alight FROM pattern_stops s""")
def pickup_gate(spark, d):
    k = F.col("c_custkey")
    gates = b.table(spark, d, "customer").filter(k % 3 != 0).select(k.alias("route_id"), (1 + k % 2).alias("low"), (2 + k % 3).alias("high"))
    return ed.gated(b.pattern_stops(spark, d).select("pattern_id", "seq", "stop_id", "board", "alight"), b.patterns(spark, d), gates)


@query(b.with_tables("patterns", "pattern_stops") + """ SELECT pattern_id, stop_id, CAST(CASE WHEN direction = 'vuelta' THEN n - seq + 1 ELSE seq END AS INT) AS seq, n AS n_stops FROM (SELECT *, count(*) OVER (PARTITION BY pattern_id) AS n FROM pattern_stops) JOIN patterns USING (pattern_id)""")
def reverse_order(spark, d):
    rows = b.pattern_stops(spark, d).select("pattern_id", "seq", "stop_id").join(b.patterns(spark, d).select("pattern_id", "direction"), "pattern_id")
    return ed.inverted(rows, F.col("direction") == "vuelta").select("pattern_id", "stop_id", "seq", "n_stops")


@query(b.with_tables("patterns", "pattern_stops") + """, old AS (SELECT pattern_id, count(*) AS n FROM pattern_stops GROUP BY pattern_id), new AS (SELECT pattern_id, count(DISTINCT stop_id) AS n FROM pattern_stops GROUP BY pattern_id)
SELECT pattern_id, n, 'old' AS built FROM old WHERE pattern_id NOT IN (SELECT pattern_id FROM patterns WHERE direction = 'ida') UNION ALL SELECT pattern_id, n, 'new' FROM new WHERE pattern_id IN (SELECT pattern_id FROM patterns WHERE direction = 'ida')""")
def scoped_rebuild(spark, d):
    g = b.pattern_stops(spark, d).groupBy("pattern_id")
    old, new = g.agg(F.count("*").alias("n")).withColumn("built", F.lit("old")), g.agg(F.count_distinct("stop_id").alias("n")).withColumn("built", F.lit("new"))
    return ed.rebuilt(old, new, b.patterns(spark, d).filter("direction = 'ida'").select("pattern_id"), "pattern_id")


@query(b.with_tables("service_windows") + """, c AS (SELECT pattern_id, window_id, day_type, start, stop, headway, active AND NOT (day_type = 'sabado' AND pattern_id % 4 = 1) AS active, CASE WHEN day_type = 'sabado' AND pattern_id % 4 = 1 THEN 'reduced' END AS reason FROM service_windows
UNION ALL SELECT pattern_id, -window_id, day_type, 480, 481, 60, true, NULL FROM service_windows WHERE day_type = 'sabado' AND pattern_id % 4 = 1)
SELECT pattern_id, window_id, active, reason, CASE WHEN coalesce(active, true) THEN floor(((CASE WHEN stop < start THEN stop + 1440 ELSE stop END) - start) / headway)::BIGINT + 1 ELSE 0 END AS departures FROM c""")
def service_correction(spark, d):
    """A reduced Saturday: some windows are switched off, with a reason, and single departures put in their place."""
    sw = b.service_windows(spark, d)
    off = (F.col("day_type") == "sabado") & (F.col("pattern_id") % 4 == 1)
    single = sw.filter(off).select("pattern_id", (-F.col("window_id")).alias("window_id"), "day_type", F.lit(480).alias("start"))
    c = ed.corrected_windows(sw, off, "reduced", single)
    n = tt.departures(c).groupBy("pattern_id", "window_id").agg(F.count("*").alias("departures"))
    return c.join(n, ["pattern_id", "window_id"], "left").select("pattern_id", "window_id", "active", F.get_json_object("note", "$.reason").alias("reason"), F.coalesce("departures", F.lit(0)).alias("departures"))


@query(b.with_tables("stops") + " SELECT CAST((i - 1) // 64 AS BIGINT) AS batch, min(stop_id) AS low, max(stop_id) AS high, count(*) AS n FROM (SELECT stop_id, row_number() OVER (ORDER BY stop_id) AS i FROM stops) GROUP BY ALL")
def stop_batches(spark, d):
    return ed.batches(b.stops(spark, d), "stop_id", 64)


@query(b.with_tables("stops", "pattern_stops") + " SELECT stop_id, row_number() OVER (ORDER BY stop_id) - 1 AS dense_id FROM (SELECT stop_id FROM pattern_stops UNION SELECT stop_id FROM stops WHERE coalesce(active, true))")
def dense_stop_ids(spark, d):
    return ed.dense_ids(b.pattern_stops(spark, d).select("stop_id").unionByName(b.stops(spark, d).filter("coalesce(active, true)").select("stop_id")), "stop_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, to_json({'k': CAST(json_extract_string(props, '$.k') AS INT), 'type': event_type}) AS merged FROM events")
def json_merge(spark, d):
    """A value taken out of JSON, and put back with another; nulls are left out."""
    k = F.get_json_object("props", "$.k").cast("int")
    return b.table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("merged"))


@query(b.with_tables("pattern_stops") + " SELECT pattern_id, CAST(to_json(list({'seq': seq, 'stop': stop_id} ORDER BY seq)) AS VARCHAR) AS stops FROM pattern_stops GROUP BY pattern_id")
def json_stops(spark, d):
    """The stops of a pattern as one JSON array, in order."""
    return b.pattern_stops(spark, d).groupBy("pattern_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", F.col("stop_id").alias("stop"))))).alias("stops"))


@query(b.with_tables("stops", "pattern_stops") + " SELECT pattern_id, CAST(row_number() OVER (PARTITION BY pattern_id ORDER BY seq) AS INT) AS pos, round(lat, 6) AS lat, round(lng, 6) AS lng FROM pattern_stops JOIN stops USING (stop_id)")
def geojson_round_trip(spark, d):
    """Every pattern's line written as GeoJSON and read again as points."""
    pts = b.pattern_stops(spark, d).join(b.stops(spark, d).select("stop_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng")), "stop_id")
    return geojson.line_points(geojson.line_strings(pts, "pattern_id", "seq"), "pattern_id").select("pattern_id", "pos", "lat", "lng")


@query(b.with_tables("pattern_stops") + " SELECT stop_id, count(DISTINCT pattern_id) AS n FROM pattern_stops GROUP BY stop_id ORDER BY n DESC, stop_id LIMIT 50")
def busiest_stops(spark, d):
    """A report of at most 50 stops, however many are asked for."""
    n = max(1, min(80, 50))
    return b.pattern_stops(spark, d).groupBy("stop_id").agg(F.count_distinct("pattern_id").alias("n")).orderBy(F.desc("n"), "stop_id").limit(n)


@query(b.with_tables("stops", "trips_wanted") + _NEAR + " SELECT qid, min(dist_m) FILTER (k = 1) AS nearest_m, min(dist_m) FILTER (k = 2) AS second_m FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist_m, stop_id) AS k FROM near) GROUP BY qid")
def nearest_two(spark, d):
    w = W.partitionBy("qid").orderBy("dist_m", "stop_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return near_stops(spark, d).select("qid", F.first("dist_m").over(w).alias("nearest_m"), F.nth_value("dist_m", 2).over(w).alias("second_m")).distinct()


_ARC_SQL = """, r AS (SELECT pattern_id, seq, stop_id, row_number() OVER (PARTITION BY pattern_id ORDER BY seq) AS i FROM sq JOIN lp USING (pattern_id) WHERE n >= 2 AND NOT is_loop),
fold AS (SELECT pattern_id, i, 1 AS arc, [stop_id] AS now, stop_id AS prev FROM r WHERE i = 1 UNION ALL
 SELECT r.pattern_id, r.i, CASE WHEN list_contains(now, r.stop_id) THEN arc + 1 ELSE arc END, CASE WHEN list_contains(now, r.stop_id) THEN [prev, r.stop_id] ELSE list_append(now, r.stop_id) END, r.stop_id FROM fold JOIN r ON r.pattern_id = fold.pattern_id AND r.i = fold.i + 1),
a AS (SELECT pattern_id, arc, arg_max(now, i) AS now FROM fold GROUP BY ALL), c AS (SELECT pattern_id, arc, CASE WHEN count(*) OVER (PARTITION BY pattern_id) > 1 THEN 'revisit' ELSE 'linear' END AS reason, now FROM a),
lo AS (SELECT pattern_id, stop_id, min(seq) AS seq FROM (SELECT sq.*, max(seq) OVER (PARTITION BY pattern_id) AS m FROM sq JOIN lp USING (pattern_id) WHERE is_loop) WHERE seq < m GROUP BY ALL),
arcs AS (SELECT pattern_id, CAST(arc AS INT) AS arc, reason, now FROM c UNION ALL SELECT pattern_id, 1, 'loop', list(stop_id ORDER BY seq) FROM lo GROUP BY pattern_id HAVING count(*) >= 2)"""


@query(b.with_tables("stops", "pattern_stops") + _LOOPS + _ARC_SQL + " SELECT pattern_id, count(*) AS n_arcs, CAST(to_json(list({'arc': arc, 'stops': now} ORDER BY arc)) AS VARCHAR) AS arcs FROM arcs GROUP BY pattern_id")
def service_directory(spark, d):
    """Every pattern's arcs with their stops in order, as one nested value."""
    a = tt.arc_lists(b.pattern_stops(spark, d), b.stops(spark, d))
    own = F.transform("arcs", lambda x, i: F.struct((i + 1).alias("arc"), F.transform(x, lambda y: y["stop_id"]).alias("stops")))
    return a.select("pattern_id", F.size("arcs").cast("bigint").alias("n_arcs"), F.to_json(own).alias("arcs"))


@query(b.with_tables("stops", "pattern_stops") + _LOOPS + _ARC_SQL + """ SELECT kind, count(*) AS patterns, CAST(sum(n_arcs) AS BIGINT) AS arcs FROM (SELECT p.pattern_id, coalesce(max(reason), 'discarded') AS kind, count(arc) AS n_arcs FROM (SELECT DISTINCT pattern_id FROM pattern_stops) p LEFT JOIN arcs USING (pattern_id) GROUP BY p.pattern_id) GROUP BY kind""")
def linearize_stats(spark, d):
    """How many patterns are straight, looped, cut at revisits, or too short to use."""
    ps = b.pattern_stops(spark, d)
    arcs = tt.arcs(ps, b.stops(spark, d)).select("pattern_id", "arc", "reason").distinct()
    own = ps.select("pattern_id").distinct().join(arcs, "pattern_id", "left").groupBy("pattern_id").agg(F.coalesce(F.max("reason"), F.lit("discarded")).alias("kind"), F.count("arc").alias("n"))
    return own.groupBy("kind").agg(F.count("*").alias("patterns"), F.sum("n").alias("arcs"))
