"""Queries over logs of edits: every order is a draft about a stop of its customer's route, every line an event of a pattern's geometry."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import drafts as dr
from ..operators.shared import written
from ..sources import bindings as b
from .registry import query

_ACTIONS = "[" + ", ".join(f"'{a}'" for a in dr.ACTIONS) + "]"
_DRAFTS = f""", first AS (SELECT pattern_id, stop_id AS s1 FROM pattern_stops WHERE seq = 1),
raw AS (SELECT pattern_id AS draft_id, {_ACTIONS}[CAST(pattern_id % 6 + 1 AS INT)] AS action, s1 AS stop_id, CASE WHEN pattern_id % 19 <> 0 THEN route_id END AS route_id, ['ida', 'vuelta', 'ambos', NULL][CAST((pattern_id // 6) % 4 + 1 AS INT)] AS direction,
  CASE WHEN pattern_id % 7 <> 0 THEN CAST(pattern_id % 5 AS INT) END AS target_order, CASE WHEN pattern_id % 13 <> 0 THEN 9.0::DOUBLE + (pattern_id % 1000) / 1000.0::DOUBLE END AS lat, -84.0::DOUBLE AS lng, CASE WHEN pattern_id % 5 <> 0 THEN 'Parada ' || pattern_id END AS name, pattern_id % 17 = 0 AS undone FROM patterns LEFT JOIN first USING (pattern_id)),
st0 AS (SELECT *, CASE WHEN undone THEN 'undone' WHEN coalesce((action NOT IN ('create_stop', 'move_stop') OR lat IS NOT NULL) AND (action = 'create_stop' OR stop_id IS NOT NULL) AND (action <> 'rename_stop' OR name IS NOT NULL) AND (action NOT IN ('attach_stop_to_route', 'detach_stop_from_route') OR route_id IS NOT NULL), false) THEN 'applied' ELSE 'rejected' END AS status FROM raw),
dft AS MATERIALIZED (SELECT * REPLACE (CASE WHEN action = 'create_stop' THEN CASE WHEN status = 'applied' THEN (SELECT max(stop_id) FROM stops) + row_number() OVER (PARTITION BY action = 'create_stop' AND status = 'applied' ORDER BY draft_id) END ELSE stop_id END AS stop_id) FROM st0),
ap AS (SELECT * FROM dft WHERE status = 'applied')"""


def _drafts(spark, d):
    k = F.col("pattern_id")
    some = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    first = b.pattern_stops(spark, d).filter("seq = 1").select("pattern_id", "stop_id")
    log = b.patterns(spark, d).join(first, "pattern_id", "left").select(
        k.alias("draft_id"), some(k, dr.ACTIONS).alias("action"), "stop_id", F.when(k % 19 != 0, F.col("route_id")).alias("route_id"), some(F.floor(k / 6), ("ida", "vuelta", "ambos", None)).alias("direction"),
        F.when(k % 7 != 0, (k % 5).cast("int")).alias("target_order"), F.when(k % 13 != 0, 9.0 + (k % 1000) / 1000.0).alias("lat"), F.lit(-84.0).alias("lng"), F.when(k % 5 != 0, F.concat(F.lit("Parada "), k)).alias("name"),
        F.lit(None).cast("boolean").alias("board"), F.lit(None).cast("boolean").alias("alight"), (k % 17 == 0).alias("undone"),
    )
    return dr.checked_drafts(log, b.stops(spark, d))


def _route_stops(spark, d):
    """Each route's stops by direction: those of its first pattern that way."""
    first = b.patterns(spark, d).groupBy("route_id", "direction").agg(F.min("pattern_id").alias("pattern_id"))
    return b.pattern_stops(spark, d).join(first, "pattern_id").select("route_id", "direction", (F.col("seq") - 1).alias("ord"), "stop_id", "board", "alight")


_ROUTE_STOPS = ", rs AS MATERIALIZED (SELECT route_id, direction, CAST(seq - 1 AS INT) AS ord, stop_id, board, alight FROM pattern_stops JOIN (SELECT route_id, direction, min(pattern_id) AS pattern_id FROM patterns GROUP BY ALL) USING (pattern_id))"


@query(b.with_tables("stops", "patterns", "pattern_stops") + _DRAFTS + """, l AS (SELECT stop_id, arg_max({'lat': lat, 'lng': lng}, draft_id) FILTER (action IN ('create_stop', 'move_stop')) AS pos, arg_max(name, draft_id) FILTER (action IN ('create_stop', 'move_stop', 'rename_stop') AND name IS NOT NULL) AS nm, bool_or(action = 'deactivate_stop') AS off, bool_or(action = 'create_stop') AS new, bool_or(action IN ('move_stop', 'rename_stop', 'deactivate_stop')) AS ed FROM ap GROUP BY stop_id)
SELECT stop_id, round(coalesce(pos.lat, s.lat), 6) AS lat, round(coalesce(pos.lng, s.lng), 6) AS lng, coalesce(nm, s.name) AS name, CASE WHEN off THEN false WHEN new THEN true ELSE active END AS active, CASE WHEN new OR (ed AND stop_id % 2 = 0) THEN 'manual' WHEN s.stop_id IS NULL THEN NULL WHEN stop_id % 2 = 0 THEN 'osm' ELSE 'gtfs' END AS source FROM stops s FULL JOIN l USING (stop_id)""")
def draft_stops(spark, d):
    """The stops after all drafts."""
    stops = b.stops(spark, d).withColumn("source", F.when(F.col("stop_id") % 2 == 0, "osm").otherwise("gtfs"))
    return dr.drafted_stops(stops, _drafts(spark, d)).select("stop_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "name", "active", "source")


_FOLD = _DRAFTS + _ROUTE_STOPS + """, lg AS MATERIALIZED (SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY draft_id) AS i, action <> 'detach_stop_from_route' AS attach, coalesce(direction, CASE WHEN action <> 'detach_stop_from_route' THEN 'ida' ELSE 'ambos' END) AS way, greatest(0, coalesce(target_order, 0)) AS tgt, stop_id AS sid FROM ap WHERE route_id IS NOT NULL AND action IN ('create_stop', 'attach_stop_to_route', 'detach_stop_from_route')),
base AS (SELECT route_id, list({'direction': direction, 'ord': ord, 'stop_id': stop_id, 'board': board, 'alight': alight}) AS rows FROM rs GROUP BY route_id),
fold AS (SELECT DISTINCT lg.route_id, 0::BIGINT AS i, coalesce(rows, []) AS rows FROM lg LEFT JOIN base USING (route_id)
 UNION ALL SELECT f.route_id, g.i, CASE WHEN attach THEN list_concat(list_transform(rows, lambda r: {'direction': r.direction, 'ord': r.ord + CASE WHEN (way = r.direction OR (way = 'ambos' AND r.direction IN ('ida', 'vuelta', 'loop')) OR (way = 'ambos' AND r.direction = 'ambos' AND len(list_filter(rows, lambda y: y.direction IN ('ida', 'vuelta', 'loop'))) = 0)) AND r.ord >= tgt THEN 1 ELSE 0 END, 'stop_id': r.stop_id, 'board': r.board, 'alight': r.alight}),
   list_transform(CASE WHEN way <> 'ambos' THEN [way] WHEN len(list_filter(rows, lambda y: y.direction IN ('ida', 'vuelta', 'loop'))) > 0 THEN list_distinct(list_transform(list_filter(rows, lambda y: y.direction IN ('ida', 'vuelta', 'loop')), lambda y: y.direction)) ELSE ['ambos'] END, lambda w: {'direction': w, 'ord': tgt, 'stop_id': sid, 'board': true, 'alight': true}))
   ELSE list_transform(list_filter(rows, lambda r: NOT (r.stop_id = sid AND (way = 'ambos' OR r.direction = way))), lambda r: {'direction': r.direction, 'ord': r.ord - CAST(len(list_filter(rows, lambda y: y.stop_id = sid AND (way = 'ambos' OR y.direction = way) AND y.direction = r.direction AND y.ord < r.ord)) AS INT), 'stop_id': r.stop_id, 'board': r.board, 'alight': r.alight}) END
 FROM fold f JOIN lg g ON g.route_id = f.route_id AND g.i = f.i + 1),
rd AS (SELECT route_id, unnest(arg_max(rows, i)) AS r FROM fold GROUP BY route_id),
aft AS MATERIALIZED (SELECT route_id, r.direction AS direction, r.ord AS ord, r.stop_id AS stop_id, r.board AS board, r.alight AS alight FROM rd UNION ALL SELECT * FROM rs WHERE route_id NOT IN (SELECT route_id FROM lg))"""


@query(b.with_tables("stops", "patterns", "pattern_stops") + _FOLD + " SELECT * FROM aft")
def draft_route_stops(spark, d):
    """Every route's stops after all drafts."""
    return dr.drafted_routes(_route_stops(spark, d), _drafts(spark, d)).select("route_id", "direction", "ord", "stop_id", "board", "alight")


@query(b.with_tables("stops", "patterns", "pattern_stops") + _FOLD + """, o AS (SELECT route_id, direction, list({'s': stop_id, 'b': board, 'a': alight} ORDER BY ord, stop_id, board, alight) AS x FROM rs GROUP BY ALL), n AS (SELECT route_id, direction, list({'s': stop_id, 'b': board, 'a': alight} ORDER BY ord, stop_id, board, alight) AS x FROM aft GROUP BY ALL),
ch AS (SELECT n.* FROM n LEFT JOIN o USING (route_id, direction) WHERE o.x IS NULL OR o.x <> n.x)
SELECT route_id, direction, CAST(i AS INT) AS seq, x[i].s AS stop_id, x[i].b AS board, x[i].a AS alight FROM (SELECT route_id, direction, x, unnest(generate_series(1, len(x))) AS i FROM ch)""")
def draft_patterns(spark, d):
    """The patterns that the drafts changed, rebuilt; the others aren't touched."""
    before = written(_route_stops(spark, d), "route_stops")
    return dr.changed_patterns(before, dr.drafted_routes(before, _drafts(spark, d)))


_OPS = ("apply", "undo", "apply", "restore", "undo", "backup", "delete_version", "undo")
_LOG = f""", ev AS MATERIALIZED (SELECT pattern_id % 500 AS route_id, row_number() OVER (PARTITION BY pattern_id % 500 ORDER BY seq, pattern_id) AS event, [{', '.join(f"'{o}'" for o in _OPS)}][CAST((pattern_id * 5 + seq * 3 + stop_id) % 8 + 1 AS INT)] AS op, pattern_id, seq, stop_id FROM pattern_stops),
el AS MATERIALIZED (SELECT route_id, event, op, CASE WHEN op IN ('restore', 'delete_version') AND stop_id % 9 <> 0 THEN greatest(0, event - 1 - stop_id % 6) END AS version, event * 10 + route_id % 7 AS moment FROM ev),
fd AS (SELECT DISTINCT route_id, 0::BIGINT AS event, NULL::BIGINT AS shown, false AS ok, [] :: STRUCT(v BIGINT, g BIGINT)[] AS vs FROM el
 UNION ALL SELECT route_id, event, CASE WHEN op = 'apply' THEN event WHEN tgt IS NOT NULL THEN list_filter(vs, lambda x: x.v = tgt)[1].g ELSE shown END, CASE op WHEN 'apply' THEN true WHEN 'backup' THEN shown IS NOT NULL WHEN 'delete_version' THEN len(list_filter(vs, lambda x: x.v = version)) > 0 ELSE tgt IS NOT NULL END,
  CASE WHEN op = 'delete_version' THEN list_filter(vs, lambda x: version IS NULL OR x.v <> version) WHEN (op IN ('apply', 'backup') AND shown IS NOT NULL) OR tgt IS NOT NULL THEN list_append(vs, {{'v': event, 'g': shown}}) ELSE vs END
  FROM (SELECT f.route_id, e.event, e.op, e.version, f.shown, f.vs, CASE WHEN e.op = 'undo' THEN vs[-1].v WHEN e.op = 'restore' AND len(list_filter(vs, lambda x: x.v = e.version)) > 0 THEN e.version END AS tgt FROM fd f JOIN el e ON e.route_id = f.route_id AND e.event = f.event + 1)),
sh AS MATERIALIZED (SELECT fd.route_id, fd.event, el.op, fd.ok, fd.shown, el.moment FROM fd JOIN el ON el.route_id = fd.route_id AND el.event = fd.event)"""


def _shown(spark, d):
    """The events of 500 routes' geometries, each route's in the order of sequence and pattern."""
    k, seq, s = F.col("pattern_id"), F.col("seq"), F.col("stop_id")
    op = F.element_at(F.array(*map(F.lit, _OPS)), ((k * 5 + seq * 3 + s) % 8 + 1).cast("int"))
    ev = b.pattern_stops(spark, d).select((k % 500).alias("route_id"), k, seq, s, op.alias("op")).withColumn("event", F.row_number().over(W.partitionBy("route_id").orderBy("seq", "pattern_id")).cast("bigint"))
    version = F.when(F.col("op").isin("restore", "delete_version") & (s % 9 != 0), F.greatest(F.lit(0), F.col("event") - 1 - s % 6))
    return dr.geometry_log(ev.select("route_id", "event", "op", version.alias("version"), (F.col("event") * 10 + F.col("route_id") % 7).alias("at")))


@query(b.with_tables("pattern_stops") + _LOG + " SELECT route_id, event, op, ok, shown FROM sh")
def geometry_versions(spark, d):
    """What every event of a geometry's log did, and which geometry is shown after it."""
    return _shown(spark, d).select("route_id", "event", "op", "ok", "shown")


@query(b.with_tables("pattern_stops") + _LOG + """, ask AS (SELECT DISTINCT o_custkey % 520 AS route_id, (o_orderkey * 37) % 1500 AS moment FROM orders)
SELECT route_id, moment, (SELECT arg_max(struct_pack(s := shown), event) FROM sh WHERE sh.route_id = ask.route_id AND sh.moment <= ask.moment).s AS shown FROM ask""")
def geometry_as_of(spark, d):
    """The geometry shown at an instant, for a table of instants."""
    asked = b.table(spark, d, "orders").select((F.col("o_custkey") % 520).alias("route_id"), (F.col("o_orderkey") * 37 % 1500).alias("at")).distinct()
    return dr.geometry_as_of(_shown(spark, d), asked).select("route_id", F.col("at").alias("moment"), "shown")
