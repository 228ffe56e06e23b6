"""Audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as au
from ..sources import bindings as b
from .registry import query

_SIDES = """, listed AS (SELECT route_id, direction, stop_id, seq AS ord FROM pattern_stops JOIN patterns USING (pattern_id) WHERE (route_id + stop_id) % 11 <> 0 UNION ALL SELECT c_custkey, 'ida', 9000000 + c_custkey, 1 FROM customer WHERE c_custkey % 5 = 0),
pa AS (SELECT pattern_id, route_id, direction, CASE pattern_id % 13 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS active FROM patterns), st AS (SELECT stop_id, CASE WHEN stop_id % 19 = 0 THEN '  ' ELSE name END AS name FROM stops),
a AS (SELECT route_id, direction, stop_id, min(ord) AS listed_order FROM listed GROUP BY ALL), z AS (SELECT route_id, direction, stop_id, min(seq) AS pattern_seq, string_agg(DISTINCT CAST(pattern_id AS VARCHAR), ',') AS ids, count(DISTINCT pattern_id) AS n_patterns FROM pattern_stops JOIN pa USING (pattern_id) WHERE coalesce(active, true) GROUP BY ALL),
au AS MATERIALIZED (SELECT route_id, direction, stop_id, listed_order, pattern_seq, coalesce(n_patterns, 0) AS n_patterns, pattern_seq IS NOT NULL AS visible, concat_ws(',', CASE WHEN st.stop_id IS NULL THEN 'unknown_stop' END, CASE WHEN trim(st.name) = '' THEN 'no_name' END, CASE WHEN listed_order IS NULL THEN 'not_listed' END, CASE WHEN pattern_seq IS NULL THEN 'in_no_pattern' END) AS issues
 FROM a FULL JOIN z USING (route_id, direction, stop_id) LEFT JOIN st USING (stop_id))"""


def _listed(spark, d):
    rows = b.pattern_stops(spark, d).join(b.patterns(spark, d), "pattern_id").filter((F.col("route_id") + F.col("stop_id")) % 11 != 0).select("route_id", "direction", "stop_id", F.col("seq").alias("ord"))
    k = F.col("c_custkey")
    lost = b.table(spark, d, "customer").filter(k % 5 == 0).select(k.alias("route_id"), F.lit("ida").alias("direction"), (k + 9000000).alias("stop_id"), F.lit(1).alias("ord"))
    return rows.unionByName(lost)


def _audit(spark, d):
    k = F.col("pattern_id") % 13
    pa = b.patterns(spark, d).withColumn("active", F.when(k == 0, False).when(k != 1, True))
    st = b.stops(spark, d).select("stop_id", F.when(F.col("stop_id") % 19 == 0, "  ").otherwise(F.col("name")).alias("name"))
    return au.stop_audit(_listed(spark, d), pa, b.pattern_stops(spark, d), st)


@query(b.with_tables("patterns", "pattern_stops", "stops") + _SIDES + " SELECT * FROM au")
def route_audit(spark, d):
    """Every stop of a route's list or patterns, and what is wrong with it; a pattern whose flag is null is active."""
    return _audit(spark, d).select("route_id", "direction", "stop_id", "listed_order", "pattern_seq", F.size("pattern_ids").cast("bigint").alias("n_patterns"), "visible", F.array_join("issues", ",").alias("issues"))


@query(b.with_tables("patterns", "pattern_stops", "stops") + _SIDES + """, tw AS (SELECT route_id, direction, count(*) AS twice FROM (SELECT route_id, direction, ord FROM listed GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL)
SELECT route_id, direction, count(listed_order) AS listed, count(pattern_seq) AS in_patterns, count(*) FILTER (contains(issues, 'in_no_pattern')) AS in_no_pattern, count(*) FILTER (contains(issues, 'not_listed')) AS not_listed, count(*) FILTER (contains(issues, 'no_name')) AS no_name, coalesce(any_value(twice), 0) AS twice,
 count(*) FILTER (contains(issues, 'in_no_pattern')) = 0 AND count(pattern_seq) > 0 AS visible FROM au LEFT JOIN tw USING (route_id, direction) GROUP BY route_id, direction""")
def route_audit_summary(spark, d):
    return au.stop_audit_summary(_audit(spark, d), _listed(spark, d))


@query(b.with_tables("routes", "patterns") + """, o AS (SELECT code, string_agg(DISTINCT direction || '-' || category, ',' ORDER BY direction || '-' || category) AS variants FROM patterns JOIN routes USING (route_id) WHERE CAST(regexp_extract(code, '[0-9]+$') AS INT) % 7 <> 0 GROUP BY code), c AS (SELECT code, count(*) AS n FROM routes WHERE CAST(regexp_extract(code, '[0-9]+$') AS INT) % 5 <> 0 GROUP BY code)
SELECT code, variants, coalesce(n, 0) AS n_current, CASE WHEN variants IS NULL THEN 'extra' WHEN n IS NULL THEN 'missing' ELSE 'covered' END AS status FROM o FULL JOIN c USING (code)""")
def coverage(spark, d):
    r, number = b.routes(spark, d).select("route_id", "code"), F.regexp_extract("code", "[0-9]+$", 0).cast("int")
    official = b.patterns(spark, d).join(r, "route_id").filter(number % 7 != 0).select("code", F.concat_ws("-", "direction", "category").alias("variant"))
    return au.coverage(official, r.filter(number % 5 != 0))


@query(b.with_tables("patterns", "pattern_stops", "stops") + " SELECT (SELECT count(*) FROM stops WHERE coalesce(active, true)) AS stops, (SELECT count(*) FROM patterns) AS patterns, (SELECT count(*) FROM patterns WHERE category = 'expreso') AS expreso, (SELECT count(*) FROM patterns WHERE category = 'local') AS local_, (SELECT count(*) FROM pattern_stops) AS pattern_stops")
def network_counts(spark, d):
    """Row counts of several tables as one row."""
    pt = b.patterns(spark, d).agg(F.count("*").alias("patterns"), F.count_if(F.col("category") == "expreso").alias("expreso"), F.count_if(F.col("category") == "local").alias("local_"))
    st = b.stops(spark, d).agg(F.count_if(F.coalesce("active", F.lit(True))).alias("stops"))
    return st.crossJoin(F.broadcast(pt)).crossJoin(F.broadcast(b.pattern_stops(spark, d).agg(F.count("*").alias("pattern_stops"))))


_PICK = "[{}][CAST(({}) % {} + 1 AS INT)]"
_TITLES = ("Cartago - Paraíso", "TARAS", "Tejar", "San José – Cartago", "  ", "quircot")


def _golden_sql() -> str:
    names = ", ".join(f"'{t}'" for t in _TITLES)
    pick = lambda e: _PICK.format(names, e, 6)
    fold = lambda x: f"upper(trim(regexp_replace(translate(translate(coalesce({x}, ''), 'ÁÉÍÓÚáéíóú', 'AEIOUaeiou'), '–', '-'), '\\s+', ' ', 'g')))"
    hit = lambda t, r: f"({fold(t)} <> '' AND {fold(r)} <> '' AND (contains({fold(t)}, {fold(r)}) OR contains({fold(r)}, {fold(t)})))"
    return f"""WITH c AS (SELECT c_custkey AS case_id, CASE WHEN c_custkey % 10 <> 3 THEN {pick('c_custkey')} END AS title, {pick('c_custkey // 6')} AS board, {pick('c_custkey // 5')} AS final, {pick('c_custkey // 7')} AS nv, {pick('c_custkey // 11')} AS nb, {pick('c_custkey // 13')} AS nf,
 {pick('c_custkey // 2')} AS e1, {pick('c_custkey // 3')} AS e2, CASE WHEN c_custkey % 4 = 0 THEN {pick('c_custkey // 17')} END AS eb, {pick('c_custkey // 4')} AS ac FROM customer),
 j AS (SELECT *, CASE WHEN trim(coalesce(title, '')) = '' THEN 'empty' WHEN {hit('title', 'nv')} OR {hit('board', 'nb')} AND c.case_id % 3 = 0 OR {hit('final', 'nf')} AND c.case_id % 5 = 0 THEN 'forbidden'
 WHEN {hit('title', 'e1')} OR {hit('title', 'e2')} THEN CASE WHEN eb IS NOT NULL AND NOT {hit('board', 'eb')} THEN 'unexpected' ELSE 'pass' END WHEN {hit('title', 'ac')} THEN 'acceptable' ELSE 'unexpected' END AS status FROM c) SELECT case_id, status FROM j"""


@query(_golden_sql())
def golden_eval(spark, d):
    """Known trips: is the winner one that must never win, the expected one, or one that will do?"""
    k = F.col("c_custkey")
    pick = lambda e: F.element_at(F.array(*map(F.lit, _TITLES)), (F.floor(e) % 6 + 1).cast("int"))
    some = lambda flag, e: F.when(flag, F.array(pick(e)))
    cases = b.table(spark, d, "customer").select(
        k.alias("case_id"), F.when(k % 10 != 3, pick(k)).alias("title"), pick(k / 6).alias("board"), pick(k / 5).alias("final"), F.array(pick(k / 7)).alias("never"), some(k % 3 == 0, k / 11).alias("never_board"), some(k % 5 == 0, k / 13).alias("never_final"),
        F.array(pick(k / 2), pick(k / 3)).alias("expected"), some(k % 4 == 0, k / 17).alias("expected_board"), F.lit(None).cast("array<string>").alias("expected_final"), F.array(pick(k / 4)).alias("acceptable"),
    )
    return au.judged(cases).select("case_id", "status")
