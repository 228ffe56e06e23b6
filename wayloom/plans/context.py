"""Queries of displayed scores, doubtful journeys and preferred service groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import context as cx
from ..sources import bindings as b
from .network import M
from .registry import query

_PLACES = ("Terminal San José", "Limón Centro", "Mercado", "Tres Ríos")


def legged(spark, d):
    """The bound journeys with coordinates: every place lies on the way by shares, some beyond the end, some unknown."""
    k, q = F.col("journey_id"), F.col("qid")
    j = b.journeys(spark, d)
    j = j.withColumns({"o_lat": F.when(q % 41 != 0, F.col("d_lat") + ((q * 97) % 61 - 30) / 1000.0), "o_lng": F.col("d_lng") + ((q * 53) % 59 - 29) / 1000.0})

    def at(share, part):
        return F.col(f"o_{part}") + (F.col(f"d_{part}") - F.col(f"o_{part}")) * share

    off, end = (k * 13) % 150 / 100.0 - 0.2, (k * 29) % 130 / 100.0
    two = F.col("n_legs") == 2
    first = F.when(k % 5 == 0, F.concat("route1", F.lit(" por Tres Ríos"))).otherwise(F.col("route1"))
    j = j.withColumns({
        "a1_lat": F.when(k % 19 != 0, at(off, "lat")), "a1_lng": at(off, "lng"), "b2_lat": F.when(two, at(off, "lat")), "b2_lng": F.when(two, at(off, "lng")),
        "a2_lat": F.when(two & (k % 23 != 0), at(end, "lat")), "a2_lng": F.when(two, at(end, "lng")),
    })
    place = F.element_at(F.array(*map(F.lit, _PLACES)), (q % 4 + 1).cast("int"))
    return j.withColumns({
        "z_lat": F.when(two, F.col("a2_lat")).otherwise(F.col("a1_lat")), "z_lng": F.when(two, F.col("a2_lng")).otherwise(F.col("a1_lng")), "kind": F.when(two, "transfer").otherwise("direct"),
        "routes": F.when(two, F.array(first, "route2")).otherwise(F.array(first)), "route_ids": F.when(two, F.array(k % 40, F.floor(k / 7) % 40)).otherwise(F.array(k % 40)),
        "destination_name": F.when(q % 9 != 0, place),
    })


def candidates(spark, d):
    """Four service groups a query that asks for any, with ties of priority and routes of two groups."""
    q, i = F.col("qid"), F.col("position")
    rows = b.journeys(spark, d).select("qid").distinct().filter(q % 5 != 0).select("qid", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("position"))
    return rows.select("qid", "position", ((q * 3 + i * 11) % 40).alias("product_route"), F.when((q + i) % 3 != 0, (q * 7 + i * 2) % 40).alias("preview_route"),
        F.when((q + i) % 13 != 0, (20 + (q + i) % 4 * 45).cast("int")).alias("priority"), F.when(q % 4 != 0, ((q + i * 17) % 90).cast("int")).alias("directness"))


def _text(x: str) -> str:
    return f"upper(trim(translate(coalesce({x}, ''), '{tx.ACCENTED}', '{tx.PLAIN}')))"


def _any(x: str) -> str:
    return f"regexp_matches({x}, '{'|'.join(cx.STRONG_HINTS + cx.MEDIUM_HINTS)}')"


def _way(share: str, part: str) -> str:
    return f"o_{part} + (d_{part} - o_{part}) * ({share})"


_OFF, _END = "(journey_id * 13) % 150 / 100.0::DOUBLE - 0.2::DOUBLE", "(journey_id * 29) % 130 / 100.0::DOUBLE"
_LEGGED = b.with_tables("journeys") + f""", l0 AS (SELECT *, CASE WHEN qid % 41 <> 0 THEN d_lat + ((qid * 97) % 61 - 30) / 1000.0::DOUBLE END AS o_lat, d_lng + ((qid * 53) % 59 - 29) / 1000.0::DOUBLE AS o_lng, n_legs = 2 AS two,
  CASE WHEN qid % 9 <> 0 THEN ['{"', '".join(_PLACES)}'][CAST(qid % 4 + 1 AS INT)] END AS place, CASE WHEN journey_id % 5 = 0 THEN route1 || ' por Tres Ríos' ELSE route1 END AS name1 FROM journeys),
l1 AS (SELECT *, {_way(_OFF, 'lat')} AS x_lat, {_way(_OFF, 'lng')} AS x_lng, {_way(_END, 'lat')} AS y_lat, {_way(_END, 'lng')} AS y_lng FROM l0),
l2 AS (SELECT *, {M('o_lat', 'o_lng', 'd_lat', 'd_lng')} AS s, CASE WHEN journey_id % 19 <> 0 THEN {M('x_lat', 'x_lng', 'd_lat', 'd_lng')} END AS a1, CASE WHEN journey_id % 23 <> 0 AND two THEN {M('y_lat', 'y_lng', 'd_lat', 'd_lng')} END AS a2,
  CASE WHEN journey_id % 23 <> 0 AND two THEN {M('x_lat', 'x_lng', 'y_lat', 'y_lng')} END AS ride2, {_text('name1')} AS t1, {_text('CASE WHEN two THEN route2 END')} AS t2, {_text("name1 || CASE WHEN two THEN ' ' || route2 ELSE '' END")} AS ta, {_text('place')} AS tp FROM l1),
l3 AS (SELECT *, CASE WHEN two THEN a2 ELSE a1 END AS z, CASE WHEN s <= 3000 THEN 1 ELSE 2 END AS w, {_any('t1')} AND t2 <> '' AND NOT {_any('t2')} AS outloc FROM l2),
l4 AS (SELECT *, CASE WHEN s > 0 THEN (s - a1) / s END AS fr, CASE WHEN s > 0 THEN (s - z) / s END AS lr, coalesce(a1 - s, 0) AS fb, coalesce(z - s, 0) AS lb, a1 - z AS gain, CASE WHEN s > 0 THEN total_walk_m / s END AS wr, CASE WHEN s > 0 THEN transfer_walk_m / s END AS cr FROM l3),
l5 AS MATERIALIZED (SELECT *, coalesce(fr, 1) AS f1, coalesce(lr, fr, 1) AS f2, coalesce(a1 <= least(320, s * 0.22::DOUBLE), false) AS near, coalesce(gain <= greatest(140, s * 0.1::DOUBLE), false) AS tiny FROM l4)"""


def _reason(name: str, fits: str) -> str:
    short, longer = cx.POINTS[name]
    return f"WHEN {fits} THEN {{'id': '{name}', 'points': [{short}, {longer}][w] * 10}}"


def _hints(prefix: str, hints, points) -> str:
    rows = ", ".join(f"CASE WHEN contains(ta, '{h}') AND NOT contains(tp, '{h}') THEN {{'id': '{prefix}{h}', 'points': CASE WHEN s <= 10000 THEN {int(points[0] * 10)} ELSE {int(points[1] * 10)} END}} END" for h in hints)
    return f"[{rows}]"


_GROUPS = (
    (("first-leg-backtrack-high", "fb >= 250"), ("first-leg-progress-very-low", "f1 < 0.08"), ("first-leg-progress-low", "f1 < 0.18")),
    (("final-stop-backtrack-high", "lb >= 180"), ("final-stop-progress-very-low", "f2 < 0.32"), ("final-stop-progress-low", "f2 < 0.52")),
    (("total-walk-high", "wr > 0.42 AND total_walk_m >= 550"),),
    (("direct-progress-poor", "NOT two AND f1 < 0.16 AND f2 < 0.4"),),
    (("transfer-low-value", "two AND (f1 < 0.22 OR (f2 < 0.58 AND coalesce(lr - fr, 1) < 0.16) OR (cr > 0.16 AND transfer_walk_m >= 120))"),),
    (("cleanup-transfer-after-near-destination", "two AND near AND transfer_walk_m >= 50"), ("cleanup-transfer-gain-tiny", "two AND tiny AND transfer_walk_m >= 60"), ("cleanup-transfer-gain-limited", "two AND gain <= 240 AND transfer_walk_m >= 90")),
    (("interurban-plus-local-cleanup", "two AND outloc AND (near OR tiny)"),),
)
_RULED = ", ".join("CASE " + " ".join(_reason(n, f"s <= 5500 AND ({f})") for n, f in g) + " END" for g in _GROUPS)
_SCORED = _LEGGED + f""", l6 AS (SELECT *, list_filter([{_RULED}] || {_hints('strong-interurban-', cx.STRONG_HINTS, cx.STRONG_POINTS)} || {_hints('medium-interurban-', cx.MEDIUM_HINTS, cx.MEDIUM_POINTS)}, lambda r: r IS NOT NULL) AS why FROM l5)
SELECT qid, journey_id, len(why) AS n_reasons, array_to_string(list_transform(why, lambda r: r.id || ':' || CAST(r.points AS BIGINT)), ',') AS reasons, CAST(coalesce(list_sum(list_transform(why, lambda r: r.points)), 0) AS BIGINT) AS penalty_tenths,
  CAST(score * 10 + eta_min * 14 + coalesce(list_sum(list_transform(why, lambda r: r.points)), 0) AS BIGINT) AS display_tenths FROM l6"""


@query(_SCORED)
def display_scores(spark, d):
    """Why each journey is shown lower, and the score it is shown by, in tenths."""
    tenths = lambda x: F.rint(x * 10).cast("bigint")
    told = F.transform("reasons", lambda r: F.concat(r["id"], F.lit(":"), tenths(r["points"]).cast("string")))
    j = cx.display_scores(legged(spark, d))
    return j.select("qid", "journey_id", F.size("reasons").cast("bigint").alias("n_reasons"), F.array_join(told, ",").alias("reasons"), tenths(F.col("penalty")).alias("penalty_tenths"), tenths(F.col("display_score")).alias("display_tenths"))


_DOUBT = _LEGGED + """, d0 AS (SELECT qid, journey_id, coalesce(s <= 12000 AND two AND outloc AND ride2 <= greatest(1200, s * 0.2::DOUBLE) AND (a1 <= least(360, s * 0.24::DOUBLE) OR (gain <= greatest(180, s * 0.12::DOUBLE) AND transfer_walk_m <= 120)), false) AS low_value,
  coalesce(s <= 12000 AND ((two AND fb >= greatest(800, s * 0.25::DOUBLE) AND coalesce(lr, 0) < 0.78) OR (""" + _any("ta") + """ AND final_walk_m >= 1500 AND coalesce(lr, 0) < 0.7)), false) AS incoherent FROM l5),
d1 AS (SELECT *, count(*) FILTER (NOT incoherent) OVER (PARTITION BY qid) AS good FROM d0 WHERE NOT low_value)
SELECT qid, journey_id, incoherent FROM d1 WHERE NOT incoherent OR good = 0"""


@query(_DOUBT)
def coherent_journeys(spark, d):
    """Journeys without low-value changes and, where a query has others, without incoherent ones."""
    return cx.coherent(cx.doubtful(cx.progress(legged(spark, d)))).select("qid", "journey_id", "incoherent")


_BIAS = _LEGGED + """, cand AS (SELECT qid, i AS pos, (qid * 3 + i * 11) % 40 AS r1, CASE WHEN (qid + i) % 3 <> 0 THEN (qid * 7 + i * 2) % 40 END AS r2, CASE WHEN (qid + i) % 13 <> 0 THEN 20 + (qid + i) % 4 * 45 END AS pr, CASE WHEN qid % 4 <> 0 THEN (qid + i * 17) % 90 ELSE 100 END AS dr
  FROM (SELECT DISTINCT qid FROM journeys WHERE qid % 5 <> 0), range(4) t(i)),
c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, r ORDER BY pr, pos) AS k FROM (SELECT *, unnest([r1, r2]) AS r FROM cand WHERE pr IS NOT NULL) WHERE r IS NOT NULL) WHERE k = 1),
lg AS (SELECT qid, journey_id, 0 AS leg, journey_id % 40 AS r FROM journeys UNION ALL SELECT qid, journey_id, 1, (journey_id // 7) % 40 FROM journeys WHERE n_legs = 2),
pick AS (SELECT * FROM (SELECT lg.*, r1, r2, pr, dr, row_number() OVER (PARTITION BY journey_id ORDER BY pr, leg) AS k FROM lg JOIN c1 USING (qid, r)) WHERE k = 1),
found AS (SELECT p.journey_id, pr, dr, min(lg.leg) AS leg FROM pick p JOIN lg ON lg.journey_id = p.journey_id AND (lg.r = r1 OR lg.r = r2) GROUP BY ALL),
bo AS (SELECT l5.qid, journey_id, score, CASE WHEN pr IS NULL THEN 0 ELSE CAST(greatest(0, floor((greatest(6, floor((180 - least(pr, 160)) / 4.0::DOUBLE + 0.5)) + greatest(0, 12 - floor(least(dr, 60) / 6.0::DOUBLE + 0.5)))
  * CASE WHEN two AND leg > 0 THEN CASE WHEN """ + _any("t1") + """ AND (near OR tiny) THEN 0 ELSE 0.4::DOUBLE END ELSE 1 END + 0.5)) AS INT) END AS boost FROM l5 LEFT JOIN found USING (journey_id))
SELECT qid, journey_id, boost, CAST(CASE WHEN boost > 0 THEN greatest(0, score - boost) ELSE score END AS INT) AS biased_score FROM bo"""


@query(_BIAS)
def group_bias(spark, d):
    """Scores lowered where a ride belongs to a service group of the query."""
    return cx.preferred(cx.progress(legged(spark, d)), candidates(spark, d)).select("qid", "journey_id", "boost", F.col("biased_score").cast("int").alias("biased_score"))
