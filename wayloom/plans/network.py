"""Queries over stops, lines, walking edges and the timetable."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import network as net
from ..operators import spatial as sp
from ..operators import timetable as tt
from ..sources import bindings as b
from .registry import query

M = b.metres_sql


def _int(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS INT)"


_NEAR = f""", near AS MATERIALIZED (SELECT qid, stop_id, dist_m FROM (SELECT t.qid, s.stop_id, {_int(M('t.o_lat', 't.o_lng', 's.lat', 's.lng'))} AS dist_m, {M('t.o_lat', 't.o_lng', 's.lat', 's.lng')} AS dist
  FROM trips_wanted t JOIN stops s ON coalesce(s.active, true) AND abs(s.lat - t.o_lat) < 0.02 AND abs(s.lng - t.o_lng) < 0.02) WHERE dist <= 1200)"""


def near_stops(spark, d, lat="o_lat", lng="o_lng", radius=1200, name="dist_m"):
    """qid, stop_id and the distance of the active stops around an end of every wanted trip."""
    q = b.trips_wanted(spark, d).select("qid", F.col(lat).alias("lat"), F.col(lng).alias("lng"))
    s = b.stops(spark, d).filter(F.coalesce("active", F.lit(True))).select("stop_id", F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    return sp.radius_join(q, s, radius).select("qid", "stop_id", F.rint("dist").cast("int").alias(name))


@query(b.with_tables("stops", "trips_wanted") + _NEAR + " SELECT * FROM near")
def nearby_stops(spark, d):
    return near_stops(spark, d)


@query(b.with_tables("stops", "trips_wanted") + _NEAR + " SELECT qid, stop_id, dist_m FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist_m, stop_id) AS k FROM near) WHERE k = 1")
def nearest_stop(spark, d):
    return near_stops(spark, d).groupBy("qid").agg(F.min(F.struct("dist_m", "stop_id")).alias("b")).select("qid", "b.stop_id", "b.dist_m")


@query(b.with_tables("stops", "trips_wanted", "patterns", "pattern_stops") + _NEAR + f""", nd AS (SELECT t.qid, s.stop_id, {_int(M('t.d_lat', 't.d_lng', 's.lat', 's.lng'))} AS dd, {M('t.d_lat', 't.d_lng', 's.lat', 's.lng')} AS dist FROM trips_wanted t JOIN stops s ON coalesce(s.active, true) AND abs(s.lat - t.d_lat) < 0.02 AND abs(s.lng - t.d_lng) < 0.02),
o AS (SELECT qid, route_id, min(dist_m) AS o_m FROM near JOIN pattern_stops USING (stop_id) JOIN patterns USING (pattern_id) GROUP BY ALL), e AS (SELECT qid, route_id, min(dd) AS d_m FROM nd JOIN pattern_stops USING (stop_id) JOIN patterns USING (pattern_id) WHERE dist <= 1200 GROUP BY ALL)
SELECT qid, route_id, o_m, d_m, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o_m + d_m, route_id) AS k FROM o JOIN e USING (qid, route_id)) WHERE k <= 15""")
def nearby_routes(spark, d):
    """For every wanted trip the 15 routes that pass nearest to both ends."""
    from ..operators.windows import top_k

    served = b.pattern_stops(spark, d).join(b.patterns(spark, d), "pattern_id").select("stop_id", "route_id").distinct()
    o = near_stops(spark, d).join(served, "stop_id").groupBy("qid", "route_id").agg(F.min("dist_m").alias("o_m"))
    e = near_stops(spark, d, "d_lat", "d_lng").join(served, "stop_id").groupBy("qid", "route_id").agg(F.min("dist_m").alias("d_m"))
    return top_k(o.join(e, ["qid", "route_id"]), ["qid"], [F.col("o_m") + F.col("d_m"), "route_id"], 15, rank="rank")


@query(b.with_tables("hubs", "trips_wanted") + f""" SELECT qid, hub, priority, dist_m FROM (SELECT qid, hub, priority, {_int(M('o_lat', 'o_lng', 'lat', 'lng'))} AS dist_m, row_number() OVER (PARTITION BY qid ORDER BY priority DESC, {M('o_lat', 'o_lng', 'lat', 'lng')}, hub_id) AS k
  FROM trips_wanted, hubs WHERE {M('o_lat', 'o_lng', 'lat', 'lng')} <= radius) WHERE k = 1""")
def hub_context(spark, d):
    """The most important hub whose circle holds a trip's origin. Hubs may have any radius."""
    q = b.trips_wanted(spark, d).select("qid", "o_lat", "o_lng")
    h = b.hubs(spark, d).select("hub_id", "hub", "priority", "radius", F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    inside = sp.circle_join(q, h, "radius", "o_lat", "o_lng")
    best = inside.groupBy("qid").agg(F.min(F.struct(-F.col("priority"), "dist", "hub_id", "hub", "priority")).alias("x"))
    return best.select("qid", "x.hub", "x.priority", F.rint("x.dist").cast("int").alias("dist_m"))


_EDGES = f""", served AS (SELECT stop_id, count(DISTINCT pattern_id) >= 3 AS hub FROM pattern_stops GROUP BY stop_id), own AS (SELECT s.stop_id, lat, lng, coalesce(hub, false) AS hub FROM stops s LEFT JOIN served USING (stop_id)),
walk AS MATERIALIZED (SELECT from_stop, to_stop, {_int('d')} AS dist_m, CAST(least(8, greatest(1, floor(d / 84.0 + 0.5))) AS INT) AS minutes FROM (SELECT a.stop_id AS from_stop, z.stop_id AS to_stop, a.hub AND z.hub AS hubs, {M('a.lat', 'a.lng', 'z.lat', 'z.lng')} AS d
  FROM own a JOIN own z ON a.stop_id <> z.stop_id AND abs(a.lat - z.lat) < 0.0065 AND abs(a.lng - z.lng) < 0.0065) WHERE d <= 200 OR (hubs AND d <= 650))"""


@query(b.with_tables("stops", "pattern_stops") + _EDGES + " SELECT from_stop, to_stop, dist_m, minutes, 0.75::DOUBLE AS confidence FROM walk")
def walk_edges(spark, d):
    return net.walking_edges(b.stops(spark, d), b.pattern_stops(spark, d))


@query(b.with_tables("stops", "pattern_stops") + _EDGES + """, both_kinds AS (SELECT from_stop, to_stop, dist_m, minutes, 'synthetic' AS source FROM walk UNION ALL SELECT from_stop, to_stop, dist_m + 10, minutes + CAST(from_stop % 3 AS INT), 'real' FROM walk WHERE (from_stop + to_stop) % 4 = 0 UNION ALL SELECT from_stop, -1, 5, 1, 'real' FROM walk)
SELECT from_stop, to_stop, dist_m, minutes, source FROM (SELECT *, row_number() OVER (PARTITION BY from_stop, to_stop ORDER BY source, minutes, dist_m) AS k FROM both_kinds WHERE to_stop >= 0) WHERE k = 1""")
def walk_edges_conflict(spark, d):
    w = net.walking_edges(b.stops(spark, d), b.pattern_stops(spark, d)).drop("confidence")
    real = w.filter((F.col("from_stop") + F.col("to_stop")) % 4 == 0).withColumns({"dist_m": F.col("dist_m") + 10, "minutes": (F.col("minutes") + F.col("from_stop") % 3).cast("int")})
    unknown = w.select("from_stop", F.lit(-1).cast("bigint").alias("to_stop"), F.lit(5).alias("dist_m"), F.lit(1).alias("minutes"))
    return net.resolved_edges(real.unionByName(unknown), w, b.stops(spark, d))


_LINES = f""", pts AS (SELECT pattern_id, seq, s.stop_id, lat, lng FROM pattern_stops JOIN stops s USING (stop_id)), pr AS (SELECT pattern_id, seq, lng AS x2, lat AS y2, lag(lng) OVER w AS x1, lag(lat) OVER w AS y1 FROM pts WINDOW w AS (PARTITION BY pattern_id ORDER BY seq)),
segs AS MATERIALIZED (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len_deg, {M('y1', 'x1', 'y2', 'x2')} AS len_m FROM pr WHERE x1 IS NOT NULL AND (x1 <> x2 OR y1 <> y2))"""


def _segments(spark, d):
    pts = b.pattern_stops(spark, d).join(b.stops(spark, d).select("stop_id", "lat", "lng"), "stop_id")
    return sp.segments(pts, "pattern_id", "seq")


@query(b.with_tables("stops", "pattern_stops") + _LINES + " SELECT pattern_id, count(*) AS n_segments, CAST(round(sum(len_m), 0) AS BIGINT) AS length_m FROM segs GROUP BY pattern_id")
def line_length(spark, d):
    return _segments(spark, d).groupBy("pattern_id").agg(F.count("*").alias("n_segments"), F.round(F.sum("len_m"), 0).cast("bigint").alias("length_m"))


@query(b.with_tables("stops", "pattern_stops") + _LINES + " SELECT pattern_id, CAST(row_number() OVER (PARTITION BY pattern_id ORDER BY seq) AS INT) AS seg_no, CAST(round(degrees(atan2(x2 - x1, y2 - y1))) AS INT) AS degrees FROM segs")
def segment_bearings(spark, d):
    """Which way each segment of a line heads: 0 is north, 90 east."""
    return _segments(spark, d).select("pattern_id", "seg_no", F.round(geo.bearing("y1", "x1", "y2", "x2")).cast("int").alias("degrees"))


@query(b.with_tables("stops", "pattern_stops") + _LINES.replace("segs AS MATERIALIZED", "segs AS") + f", prog AS (SELECT pattern_id, seq, {M('y1', 'x1', 'y2', 'x2')} AS m FROM pr) SELECT pattern_id, seq, CAST(round(sum(coalesce(m, 0)) OVER (PARTITION BY pattern_id ORDER BY seq), 1) * 10 AS BIGINT) AS progress_dm FROM prog")
def cumulative_progress(spark, d):
    """Distance along a line in tenths of a metre; ``line_progress`` adds up whole metres."""
    w = W.partitionBy("pattern_id").orderBy("seq")
    pts = b.pattern_stops(spark, d).join(b.stops(spark, d).select("stop_id", "lat", "lng"), "stop_id")
    step = F.coalesce(geo.haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")), F.lit(0.0))
    total = F.sum("m").over(w.rowsBetween(W.unboundedPreceding, 0))
    return pts.withColumn("m", step).select("pattern_id", "seq", (F.round(total, 1) * 10).cast("bigint").alias("progress_dm"))


@query(b.with_tables("stops", "pattern_stops") + f""", steps AS (SELECT pattern_id, seq, lat, lng, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0 FROM pattern_stops JOIN stops USING (stop_id) WINDOW w AS (PARTITION BY pattern_id ORDER BY seq))
SELECT pattern_id, seq, CAST(sum(CASE WHEN lat0 IS NULL THEN 0 ELSE {_int(M('lat0', 'lng0', 'lat', 'lng'))} END) OVER (PARTITION BY pattern_id ORDER BY seq) AS BIGINT) AS progress_m FROM steps""")
def line_progress(spark, d):
    """Metres along a line from its first stop to each of its stops."""
    w = W.partitionBy("pattern_id").orderBy("seq")
    pts = b.pattern_stops(spark, d).join(b.stops(spark, d).select("stop_id", "lat", "lng"), "stop_id")
    step = F.coalesce(geo.metres(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")), F.lit(0))
    return pts.withColumn("m", step).select("pattern_id", "seq", F.sum("m").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("progress_m"))


_LOCATED = _LINES + f""", cum AS (SELECT *, sum(len_deg) OVER (PARTITION BY pattern_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cum_deg, sum(len_deg) OVER (PARTITION BY pattern_id) AS total FROM segs),
p AS (SELECT pattern_id, min(lat) AS lat, max(lng) AS lng FROM pts GROUP BY pattern_id), tt AS (SELECT cum.*, lat, lng, greatest(0.0, least(1.0, ((lng - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM cum JOIN p USING (pattern_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY pow(lng - (x1 + t * (x2 - x1)), 2) + pow(lat - (y1 + t * (y2 - y1)), 2), seq) AS k FROM tt)
SELECT pattern_id, round((coalesce(cum_deg, 0) + t * len_deg) / total, 5) AS fraction, {_int(M('lat', 'lng', 'y1 + t * (y2 - y1)', 'x1 + t * (x2 - x1)'))} AS away_m FROM best WHERE k = 1"""


@query(b.with_tables("stops", "pattern_stops") + _LOCATED)
def line_locate(spark, d):
    """The corner point of every pattern's box, located on the pattern's line."""
    segs = _segments(spark, d)
    pts = b.pattern_stops(spark, d).join(b.stops(spark, d).select("stop_id", "lat", "lng"), "stop_id").groupBy("pattern_id").agg(F.min("lat").alias("lat"), F.max("lng").alias("lng"))
    return sp.located(segs.join(pts, "pattern_id"), ["pattern_id"]).select("pattern_id", F.round("fraction", 5).alias("fraction"), F.rint("away_m").cast("int").alias("away_m"))


@query(b.with_tables("stops", "pattern_stops") + """, pts AS (SELECT pattern_id, seq, lat, lng, coalesce(abs(lat - lag(lat) OVER w) > 0.05 OR abs(lng - lag(lng) OVER w) > 0.05, true) AS cut FROM pattern_stops JOIN stops USING (stop_id) WINDOW w AS (PARTITION BY pattern_id ORDER BY seq)),
parts AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY pattern_id ORDER BY seq) AS part FROM pts) SELECT pattern_id, part::BIGINT AS part, count(*) AS n FROM parts GROUP BY ALL HAVING count(*) >= 2""")
def jump_split(spark, d):
    pts = b.pattern_stops(spark, d).join(b.stops(spark, d).select("stop_id", "lat", "lng"), "stop_id")
    return sp.split_at_jumps(pts, "pattern_id", "seq").groupBy("pattern_id", "part").agg(F.count("*").alias("n"))


@query(b.with_tables("stops", "pattern_stops") + _LINES + ", st AS (SELECT unnest(range(4)) AS step) SELECT pattern_id, seq_no AS seg_no, CAST(step AS INT) AS step, round(y1 + step / 4.0 * (y2 - y1), 6) AS lat, round(x1 + step / 4.0 * (x2 - x1), 6) AS lng FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pattern_id ORDER BY seq) AS INT) AS seq_no FROM segs), st")
def densify(spark, d):
    """The lines of all patterns with three points put in each segment."""
    return sp.densified(_segments(spark, d), 4).select("pattern_id", "seg_no", "step", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("""SELECT o_orderkey, CAST(CASE WHEN st = 'unavailable' THEN 0 WHEN st = 'no_route' THEN CASE WHEN s < 350 THEN greatest(3, floor(s / 80.0 + 0.5)) ELSE floor(8 + s / 120.0 + 0.5) END ELSE greatest(0, floor(greatest(0, n - s) / 70.0
 + CASE WHEN (CASE WHEN s > 0 THEN n / s ELSE 1 END) > 2.2 AND n >= 700 THEN least(18, (n / s - 2.2) * 4) ELSE 0 END + CASE WHEN n > 2500 THEN (n - 2500) / 350.0 ELSE 0 END + CASE WHEN n > 5000 THEN 25 ELSE 0 END + 0.5)) END AS INT) AS penalty FROM (
SELECT o_orderkey, ['ok', 'no_route', 'unavailable', 'ok'][CAST(o_orderkey % 4 + 1 AS INT)] AS st, CAST(o_custkey % 2000 AS DOUBLE) AS s, CAST(o_custkey % 2000 + o_orderkey % 4000 AS DOUBLE) AS n FROM orders)""")
def walk_network(spark, d):
    k = F.col("o_orderkey")
    st = F.element_at(F.array(*map(F.lit, ("ok", "no_route", "unavailable", "ok"))), (k % 4 + 1).cast("int"))
    s = F.col("o_custkey") % 2000
    return b.table(spark, d, "orders").select("o_orderkey", geo.walk_network_penalty(st, s, s + k % 4000).alias("penalty"))


_DB = f""", pt AS (SELECT stop_id, radians(lng) * 6378137.0 AS x, ln(tan(0.7853981633974483 + radians(lat) / 2)) * 6378137.0 AS y FROM stops),
pairs AS MATERIALIZED (SELECT a.stop_id AS a, z.stop_id AS b FROM pt a JOIN pt z ON abs(a.x - z.x) <= 120 AND abs(a.y - z.y) <= 120 AND sqrt(pow(a.x - z.x, 2) + pow(a.y - z.y, 2)) <= 120),
core AS MATERIALIZED (SELECT a AS stop_id FROM pairs GROUP BY a HAVING count(*) >= 2), reach AS (SELECT stop_id AS node, stop_id AS root FROM core UNION SELECT b, root FROM reach JOIN pairs ON a = node WHERE b IN (SELECT stop_id FROM core)),
macro AS (SELECT s.stop_id, coalesce(min(root), s.stop_id) AS macro FROM stops s LEFT JOIN reach ON node = s.stop_id GROUP BY s.stop_id)"""


@query(b.with_tables("stops") + _DB + " SELECT macro, count(*) AS members, min(stop_id) AS first_stop, md5(string_agg(CAST(stop_id AS VARCHAR), ',' ORDER BY stop_id)) AS stops_md5 FROM macro GROUP BY macro")
def stop_areas_macro(spark, d):
    areas = net.stop_areas(b.stops(spark, d))
    ids = F.md5(F.array_join(F.array_sort(F.collect_list("stop_id")), ","))
    return areas.groupBy("macro").agg(F.count("*").alias("members"), F.min("stop_id").alias("first_stop"), ids.alias("stops_md5"))


@query(b.with_tables("stops") + _DB + f""" SELECT from_stop, to_stop, kind, {_int('d')} AS dist_m, CAST(ceil(round_even(d, 0) / 80.0) AS INT) AS minutes,
 round(CASE WHEN kind = 'same_macro' THEN greatest(0.8::DOUBLE, 1 - round_even(d, 0) / 160.0 * 0.2::DOUBLE) ELSE greatest(0.35::DOUBLE, 0.75::DOUBLE - round_even(d, 0) / 220.0 * 0.4::DOUBLE) END, 4) AS confidence
FROM (SELECT a.stop_id AS from_stop, z.stop_id AS to_stop, CASE WHEN ma.macro = mz.macro THEN 'same_macro' ELSE 'nearby_walk' END AS kind, {M('a.lat', 'a.lng', 'z.lat', 'z.lng')} AS d FROM stops a JOIN stops z ON a.stop_id <> z.stop_id AND abs(a.lat - z.lat) < 0.003 AND abs(a.lng - z.lng) < 0.003
 JOIN macro ma ON ma.stop_id = a.stop_id JOIN macro mz ON mz.stop_id = z.stop_id) WHERE d <= CASE WHEN kind = 'same_macro' THEN 160 ELSE 220 END""")
def transfer_edges(spark, d):
    s = b.stops(spark, d)
    return net.transfer_edges(net.stop_areas(s).select("stop_id", "macro"), s)


@query(b.with_tables("pattern_stops") + " SELECT pattern_id, count(*) AS n, count(*) FILTER (p IS NULL OR p <> stop_id) AS n_squashed FROM (SELECT *, lag(stop_id) OVER (PARTITION BY pattern_id ORDER BY seq) AS p FROM pattern_stops) GROUP BY pattern_id")
def linearize_squash(spark, d):
    ps = b.pattern_stops(spark, d)
    n = ps.groupBy("pattern_id").agg(F.count("*").alias("n"))
    return n.join(tt.squashed(ps).groupBy("pattern_id").agg(F.count("*").alias("n_squashed")), "pattern_id")


_SQ = ", sq AS MATERIALIZED (SELECT pattern_id, seq, stop_id FROM (SELECT *, lag(stop_id) OVER (PARTITION BY pattern_id ORDER BY seq) AS p FROM pattern_stops) WHERE p IS NULL OR p <> stop_id)"
_LOOPS = _SQ + f""", ends AS (SELECT pattern_id, count(*) AS n, arg_min(stop_id, seq) AS f, arg_max(stop_id, seq) AS l FROM sq GROUP BY pattern_id),
lp AS MATERIALIZED (SELECT pattern_id, n, n > 1 AND (f = l OR coalesce({M('a.lat', 'a.lng', 'z.lat', 'z.lng')} <= 80, false)) AS is_loop FROM ends LEFT JOIN stops a ON a.stop_id = f LEFT JOIN stops z ON z.stop_id = l)"""


@query(b.with_tables("stops", "pattern_stops") + _LOOPS + " SELECT * FROM lp")
def pattern_loops(spark, d):
    return tt.loops(tt.squashed(b.pattern_stops(spark, d)), b.stops(spark, d))


@query(b.with_tables("stops", "pattern_stops") + _LOOPS + """, r AS (SELECT pattern_id, seq, stop_id, row_number() OVER (PARTITION BY pattern_id ORDER BY seq) AS i FROM sq JOIN lp USING (pattern_id) WHERE n >= 2 AND NOT is_loop),
fold AS (SELECT pattern_id, i, 1 AS arc, [stop_id] AS now, stop_id AS prev FROM r WHERE i = 1 UNION ALL
 SELECT r.pattern_id, r.i, CASE WHEN list_contains(now, r.stop_id) THEN arc + 1 ELSE arc END, CASE WHEN list_contains(now, r.stop_id) THEN [prev, r.stop_id] ELSE list_append(now, r.stop_id) END, r.stop_id FROM fold JOIN r ON r.pattern_id = fold.pattern_id AND r.i = fold.i + 1),
a AS (SELECT pattern_id, arc, arg_max(now, i) AS now FROM fold GROUP BY ALL), c AS (SELECT *, count(*) OVER (PARTITION BY pattern_id) AS arcs FROM a),
lo AS (SELECT pattern_id, stop_id, min(seq) AS seq FROM (SELECT sq.*, max(seq) OVER (PARTITION BY pattern_id) AS m FROM sq JOIN lp USING (pattern_id) WHERE is_loop) WHERE seq < m GROUP BY ALL)
SELECT pattern_id, CAST(arc AS INT) AS arc, CASE WHEN arcs > 1 THEN 'revisit' ELSE 'linear' END AS reason, array_to_string(now, ',') AS stop_ids FROM c
UNION ALL SELECT pattern_id, 1, 'loop', string_agg(CAST(stop_id AS VARCHAR), ',' ORDER BY seq) FROM lo GROUP BY pattern_id HAVING count(*) >= 2""")
def revisit_arcs(spark, d):
    a = tt.arc_lists(b.pattern_stops(spark, d), b.stops(spark, d)).select("pattern_id", "reason", F.posexplode("arcs").alias("arc", "x"))
    return a.select("pattern_id", (F.col("arc") + 1).alias("arc"), "reason", F.array_join(F.transform("x", lambda y: y["stop_id"].cast("string")), ",").alias("stop_ids"))


def timed_stops(spark, d):
    """Pattern stops with time and distance, both with gaps, and the offsets that follow."""
    ps = b.pattern_stops(spark, d)
    t = F.when((F.col("pattern_id") + F.col("seq")) % 4 != 0, (F.col("seq") * 4 + F.col("qty") % 3).cast("int"))
    m = F.when((F.col("pattern_id") + F.col("seq")) % 3 != 0, (F.col("seq") * 900 + F.col("qty") * 20).cast("int"))
    return tt.offsets(ps.withColumns({"time_min": t, "dist_m": m}), ["pattern_id"], "seq")


_OFF = """, raw AS (SELECT pattern_id, seq, stop_id, board, alight, CASE WHEN (pattern_id + seq) % 4 <> 0 THEN CAST(floor(seq * 4 + qty % 3) AS INT) END AS t, CASE WHEN (pattern_id + seq) % 3 <> 0 THEN CAST(floor(seq * 900 + qty * 20) AS INT) END AS m FROM pattern_stops),
base AS (SELECT *, first_value(t) OVER w AS t0, first_value(m) OVER w AS m0 FROM raw WINDOW w AS (PARTITION BY pattern_id ORDER BY seq)), x AS (SELECT *, CASE WHEN t >= t0 THEN t - t0 WHEN m >= m0 THEN floor((m - m0) / (25000.0 / 60) + 0.5) END AS x FROM base),
off AS (SELECT pattern_id, seq, stop_id, board, alight, CAST(coalesce(x, 0) AS INT) AS o FROM x WHERE seq = 1 UNION ALL SELECT x.pattern_id, x.seq, x.stop_id, x.board, x.alight, CAST(greatest(coalesce(x.x, o + 2), o + 1) AS INT) FROM off JOIN x ON x.pattern_id = off.pattern_id AND x.seq = off.seq + 1)"""


@query(b.with_tables("pattern_stops") + _OFF + ' SELECT pattern_id, seq, o AS "offset" FROM off')
def stop_offsets(spark, d):
    return timed_stops(spark, d).select("pattern_id", "seq", "offset")


_DEP = ", dep AS (SELECT pattern_id, window_id, day_type, unnest(range(start, CASE WHEN stop < start THEN stop + 1440 ELSE stop END + 1, headway)) AS departure FROM service_windows WHERE coalesce(active, true) AND stop <> start)"


@query(b.with_tables("pattern_stops", "service_windows") + _OFF + _DEP + " SELECT day_type, pattern_id, count(DISTINCT (window_id, departure)) AS trips, count(*) AS stop_times, CAST(min(departure + o) AS INT) AS first_arrival, CAST(max(departure + o) AS INT) AS last_arrival FROM dep JOIN off USING (pattern_id) GROUP BY ALL")
def expand_trips(spark, d):
    t = tt.trips(tt.departures(b.service_windows(spark, d)), timed_stops(spark, d))
    return t.groupBy("day_type", "pattern_id").agg(
        F.count_distinct("window_id", "departure").alias("trips"), F.count("*").alias("stop_times"), F.min("arrival").alias("first_arrival"), F.max("arrival").alias("last_arrival")
    )


@query(b.with_tables("service_windows") + _DEP + " SELECT day_type, count(*) AS trips, count(DISTINCT pattern_id) AS patterns FROM dep GROUP BY day_type")
def trip_counts(spark, d):
    return tt.departures(b.service_windows(spark, d)).groupBy("day_type").agg(F.count("*").alias("trips"), F.count_distinct("pattern_id").alias("patterns"))
