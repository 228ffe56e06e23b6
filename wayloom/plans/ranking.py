"""Queries that rank journeys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ranking as rk
from ..operators import search as se
from ..operators import spatial as sp
from ..sources import bindings as b
from .network import M, _int
from .registry import query

_FOLD = f"upper(trim(regexp_replace(translate(translate(coalesce({{}}, ''), '{tx.ACCENTED}', '{tx.PLAIN}'), '{tx.DASHES}', '------'), '\\s+', ' ', 'g')))"
_J = f", j AS MATERIALIZED (SELECT *, {_FOLD.format('route1')} AS first_route, list_filter([{_FOLD.format('route1')}, {_FOLD.format('route2')}], lambda x: x <> '') AS routes FROM journeys)"


def _journeys(spark, d):
    j = b.journeys(spark, d)
    return j.withColumns({"first_route": tx.folded("route1"), "routes": F.filter(F.array(tx.folded("route1"), tx.folded("route2")), lambda x: x != "")})


_ALT = """, alt AS MATERIALIZED (SELECT qid, journey_id, 'direct_alternative' AS reason, 35.0::DOUBLE AS points FROM j WHERE n_legs >= 2 AND EXISTS (SELECT 1 FROM j c WHERE c.qid = j.qid AND c.journey_id <> j.journey_id AND c.n_legs = 1 AND c.first_route = j.first_route AND c.origin_walk_m <= j.origin_walk_m + 250 AND c.score <= j.score + 30 AND c.total_walk_m <= j.total_walk_m + 350 AND c.final_walk_m <= j.final_walk_m + 250)
UNION ALL SELECT qid, journey_id, 'far_drop', 35.0 FROM j WHERE n_legs = 1 AND final_walk_m >= 1000 AND EXISTS (SELECT 1 FROM j c WHERE c.qid = j.qid AND c.journey_id <> j.journey_id AND list_has_any(c.routes, j.routes) AND c.final_walk_m <= 600 AND c.final_walk_m <= j.final_walk_m - 800 AND c.total_walk_m <= j.total_walk_m - 250 AND c.score <= j.score + 35)
UNION ALL SELECT qid, journey_id, 'walk_dominant', 10.0 FROM j WHERE EXISTS (SELECT 1 FROM j c WHERE c.qid = j.qid AND c.journey_id <> j.journey_id AND c.final_walk_m <= 500 AND CASE WHEN j.n_legs = 1 THEN j.final_walk_m >= 900 AND c.n_legs <= 2 AND c.total_walk_m <= j.total_walk_m - 600 AND c.score <= j.score + 10
  ELSE c.n_legs >= 2 AND c.n_legs <= j.n_legs AND c.final_walk_m <= j.final_walk_m - 220 AND c.total_walk_m <= j.total_walk_m - 250 AND c.score <= j.score + 8 END)
UNION ALL SELECT qid, journey_id, 'walk_vs_wait', 8.0 FROM j WHERE trip_m BETWEEN 250 AND 1700 AND origin_walk_m + final_walk_m >= greatest(350, trip_m * 0.95::DOUBLE))"""


@query(b.with_tables("journeys") + _J + _ALT + " SELECT qid, journey_id, reason, CAST(points AS BIGINT) AS points FROM alt")
def rank_alternatives(spark, d):
    return rk.alternatives(_journeys(spark, d)).withColumn("points", F.col("points").cast("bigint"))


def _rules(spark, d):
    """Three rules a hub: a bonus for journeys by the named corridor, and points for a far drop, or another corridor, where a good one exists."""
    n = b.hubs(spark, d)
    hint = F.element_at(F.array(*map(F.lit, ("CARTAGO", "TARAS", "QUIRCOT", "EXPRESO", "TEJAR"))), (F.col("hub_id") % 5 + 1).cast("int"))
    kinds = [("bonus", True, 0, 700, False, -8), ("far_drop", True, 1000, 1 << 30, True, 35), ("other_corridor", False, 0, 1 << 30, True, 12)]
    shapes = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(k, ("kind", "wants_fit", "min_walk", "max_walk", "needs_other", "points"))]) for k in kinds])
    rows = n.select("hub_id", F.array(hint).alias("hints"), F.explode(shapes).alias("k"))
    return rows.select(F.concat(F.col("k.kind"), F.lit("-"), F.col("hub_id")).alias("rule_id"), F.col("hub_id").alias("area_id"), "hints", "k.wants_fit", "k.min_walk", "k.max_walk", "k.needs_other", F.lit(500).alias("near_walk"), "k.points")


_RULES = f""", ends AS (SELECT DISTINCT qid, d_lat, d_lng FROM journeys), rules AS (SELECT kind || '-' || hub_id AS rule_id, hub_id, ['CARTAGO', 'TARAS', 'QUIRCOT', 'EXPRESO', 'TEJAR'][CAST(hub_id % 5 + 1 AS INT)] AS hint, wants, lo, hi, other, pts FROM hubs, (VALUES ('bonus', true, 0, 700, false, -8), ('far_drop', true, 1000, 1073741824, true, 35), ('other_corridor', false, 0, 1073741824, true, 12)) k(kind, wants, lo, hi, other, pts)),
asked AS (SELECT qid, rules.* FROM ends JOIN hubs ON {M('d_lat', 'd_lng', 'lat', 'lng')} <= radius JOIN rules USING (hub_id)),
rr AS (SELECT j.qid, j.journey_id, rule_id, pts, wants, lo, hi, other, final_walk_m, len(list_filter(routes, lambda r: contains(r, hint))) > 0 AS fits FROM j JOIN asked USING (qid)),
ruled AS MATERIALIZED (SELECT qid, journey_id, rule_id AS reason, pts::DOUBLE AS points FROM rr WHERE fits = wants AND final_walk_m BETWEEN lo AND hi AND (NOT other OR EXISTS (SELECT 1 FROM rr z WHERE z.qid = rr.qid AND z.rule_id = rr.rule_id AND z.journey_id <> rr.journey_id AND z.fits AND z.final_walk_m <= 500)))"""


@query(b.with_tables("journeys", "hubs") + _J + _RULES + " SELECT qid, journey_id, reason, CAST(points AS BIGINT) AS points FROM ruled")
def rank_rules(spark, d):
    """Corridor preferences: a table of rules over circles around destinations."""
    return rk.ruled(_journeys(spark, d), _rules(spark, d), b.hubs(spark, d).withColumnRenamed("hub_id", "area_id")).withColumn("points", F.col("points").cast("bigint"))


_CONTEXT = """, medium AS (SELECT qid, journey_id, 'medium-expreso' AS reason, CASE WHEN trip_m <= 2000 THEN 3 ELSE 1.5 END AS points FROM j WHERE len(list_filter(routes, lambda r: contains(r, 'EXPRESO'))) > 0), cancel AS (SELECT qid, journey_id, 'cancel-medium-expreso' AS reason, -points AS points FROM medium WHERE qid % 2 = 0),
reasons AS (SELECT * FROM alt UNION ALL SELECT * FROM ruled UNION ALL SELECT * FROM medium UNION ALL SELECT * FROM cancel),
sums AS (SELECT qid, journey_id, sum(points) AS points, coalesce(string_agg(reason, ',' ORDER BY reason) FILTER (NOT (qid % 2 = 0 AND contains(reason, 'medium-expreso'))), '') AS reasons FROM reasons GROUP BY ALL),
sc AS MATERIALIZED (SELECT j.*, round(score + eta_min * 1.4::DOUBLE + coalesce(points, 0), 4) AS display, coalesce(s.reasons, '') AS why FROM j LEFT JOIN sums s USING (qid, journey_id))"""


def _ranked(spark, d):
    j = _journeys(spark, d)
    medium = j.filter(F.exists("routes", lambda r: F.contains(r, F.lit("EXPRESO")))).select("qid", "journey_id", F.lit("medium-expreso").alias("reason"), F.when(F.col("trip_m") <= 2000, 3.0).otherwise(1.5).alias("points"))
    cancel = medium.filter("qid % 2 = 0").select("qid", "journey_id", F.lit("cancel-medium-expreso").alias("reason"), (-F.col("points")).alias("points"))
    rules = rk.ruled(j, _rules(spark, d), b.hubs(spark, d).withColumnRenamed("hub_id", "area_id"))
    return rk.ranked(j, rk.alternatives(j).unionByName(rules).unionByName(medium).unionByName(cancel))


@query(b.with_tables("journeys", "hubs") + _J + _ALT + _RULES + _CONTEXT + " SELECT qid, journey_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY display, total_walk_m, n_legs, journey_id) AS INT) AS rank, CAST(round(display * 10) AS BIGINT) AS display_tenths, why AS reasons FROM sc")
def rank_context(spark, d):
    """All reasons together: score, waiting and points; a hint that its counter-hint cancels isn't shown."""
    return _ranked(spark, d).select("qid", "journey_id", "rank", F.round(F.col("display_score") * 10).cast("bigint").alias("display_tenths"), F.array_join("reasons", ",").alias("reasons"))


@query(b.with_tables("journeys", "hubs") + _J + _ALT + _RULES + _CONTEXT + " SELECT qid, journey_id FROM sc j WHERE EXISTS (SELECT 1 FROM sc c WHERE c.qid = j.qid AND c.journey_id <> j.journey_id AND c.routes = j.routes AND c.final_stop = j.final_stop AND c.origin_walk_m + 180 <= j.origin_walk_m AND c.total_walk_m < j.total_walk_m AND j.display >= c.display - 2)")
def inferior_boardings(spark, d):
    return rk.inferior_boardings(_ranked(spark, d))


_GROUPS = f""", hs AS (SELECT hub_id, hub_id % 5 AS group_id, CASE hub_id % 3 WHEN 0 THEN 'origin' WHEN 1 THEN 'destination' ELSE 'both' END AS role, CAST(hub_id % 7 AS INT) AS hp FROM hubs),
mem AS (SELECT n_nationkey * 7 % 5 AS group_id, CAST(n_nationkey AS VARCHAR) AS code, CAST(n_nationkey % 11 AS INT) AS mp, CAST(n_nationkey % 4 AS INT) AS dr FROM nation),
oh AS (SELECT qid, hub_id, priority, least({_int(M('o_lat', 'o_lng', 'lat', 'lng'))}, 500) // 25 AS far FROM trips_wanted JOIN hubs ON {M('o_lat', 'o_lng', 'lat', 'lng')} <= radius),
dh AS (SELECT qid, hub_id, priority, least({_int(M('d_lat', 'd_lng', 'lat', 'lng'))}, 500) // 25 AS far FROM trips_wanted JOIN hubs ON {M('d_lat', 'd_lng', 'lat', 'lng')} <= radius),
og AS (SELECT qid, oh.hub_id AS o_hub, group_id, priority + far + hp AS pr FROM oh JOIN hs USING (hub_id) WHERE role IN ('origin', 'both')), dg AS (SELECT qid, dh.hub_id AS d_hub, group_id, priority + far + hp AS pr FROM dh JOIN hs USING (hub_id) WHERE role IN ('destination', 'both'))
SELECT dg.qid, o_hub, d_hub, dg.group_id, code, CAST(dg.group_id * 3 + dg.pr + coalesce(og.pr, 0) + mp + dr AS INT) AS priority FROM dg JOIN mem USING (group_id) LEFT JOIN og ON og.qid = dg.qid AND og.group_id = dg.group_id
WHERE og.qid IS NOT NULL OR dg.group_id NOT IN (SELECT group_id FROM hs WHERE role IN ('origin', 'both') AND group_id % 2 = 0)"""


@query(b.with_tables("hubs", "trips_wanted") + _GROUPS)
def service_groups(spark, d):
    """Preferred services of the hubs at both ends; a group that is tied to origins needs one of them."""
    k = F.col("hub_id")
    role = F.element_at(F.array(*map(F.lit, ("origin", "destination", "both"))), (k % 3 + 1).cast("int"))
    links = b.hubs(spark, d).select("hub_id", (k % 5).alias("group_id"), role.alias("role"), (k % 7).cast("int").alias("link_priority"))
    c = F.col("n_nationkey")
    members = b.table(spark, d, "nation").select((c * 7 % 5).alias("group_id"), c.cast("string").alias("code"), (c % 11).cast("int").alias("member_priority"), (c % 4).cast("int").alias("directness"))
    groups = links.select("group_id").distinct().withColumn("group_priority", (F.col("group_id") * 3).cast("int"))
    tied = links.filter("role IN ('origin', 'both') AND group_id % 2 = 0").select("group_id").distinct()
    h = b.hubs(spark, d).select("hub_id", "priority", "radius", F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    q = b.trips_wanted(spark, d)
    return se.service_groups(sp.circle_join(q, h, "radius", "o_lat", "o_lng"), sp.circle_join(q, h, "radius", "d_lat", "d_lng"), links, groups, members, tied)
