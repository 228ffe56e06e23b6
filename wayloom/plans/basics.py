"""Queries over single functions, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text as tx
from ..operators.windows import latest_by, merged, nearest_ranks
from ..sources import bindings as b
from .registry import query

_WS = r"[ \t\n\f\r]+"


@query("SELECT c_custkey, lpad(nullif(regexp_replace(c_name, '[^0-9]', '', 'g'), ''), 4, '0') AS code FROM customer")
def route_code_norm(spark, d):
    return b.table(spark, d, "customer").select("c_custkey", tx.route_code("c_name").alias("code"))


@query(r"SELECT doc_id, md5(coalesce(nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), ''), '')) AS norm FROM documents")
def text_norm(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.md5(F.coalesce(tx.squeezed("text"), F.lit(""))).alias("norm"))


@query("""SELECT o_orderkey, ['ida', 'vuelta', 'loop_horario', 'loop_antihorario', 'sin_definir', 'sin_definir'][CAST(o_orderkey % 6 + 1 AS INT)] AS direction FROM orders""")
def direction_norm(spark, d):
    raw = F.element_at(F.array(*map(F.lit, (" 1-2", "2-1 ", "anillo horario", "ANILLO ANTIHORARIO", "", "x"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return b.table(spark, d, "orders").select("o_orderkey", tx.direction(raw).alias("direction"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '02-' || (o_custkey % 90) WHEN 1 THEN '02-' || (o_custkey % 90) || '-x-' || (o_orderkey % 5) ELSE '02-' || (o_custkey % 90) || '-a' END AS family FROM orders""")
def family_code(spark, d):
    base = F.concat(F.lit("02-"), (F.col("o_custkey") % 90).cast("string"))
    n = (F.col("o_orderkey") % 5).cast("string")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(base, F.lit("-"), n)).when(F.col("o_orderkey") % 3 == 1, F.concat(base, F.lit("-x-"), n)).otherwise(F.concat(base, F.lit("-a")))
    return b.table(spark, d, "orders").select("o_orderkey", tx.family_code(raw).alias("family"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace(p_name || ' ' || p_type || ' Las Buses', '[^\\p{L}\\p{N}]+', ' ', 'g')), '\\s+'),
  lambda w: length(w) >= 3 AND w NOT IN ('san','santa','jose','del','las','los','por','con','cartago','ruta','buses','bus','ida','vuelta')))), ' ') AS tokens FROM part""".replace("\\\\", "\\"))
def name_tokens(spark, d):
    return b.table(spark, d, "part").select("p_partkey", F.array_join(tx.name_tokens(F.concat_ws(" ", "p_name", "p_type", F.lit("Las Buses"))), " ").alias("tokens"))


@query(rf"""SELECT doc_id, md5(upper(trim(regexp_replace(translate(translate(coalesce(text, ''), '{tx.ACCENTED}', '{tx.PLAIN}'), '{tx.DASHES}', '------'), '\s+', ' ', 'g')))) AS fold FROM documents""")
def accent_fold(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.md5(tx.folded("text")).alias("fold"))


_PLACES = ("CARTAGO", "SAN JOSÉ", "TURRIALBA", "LIMÓN", "PARAÍSO", "BARRIO EL ALTO", "EXPRESO", "TARAS", "XYZ", "LA PEÑA BLANCA", "TERMINAL")


def _category_sql() -> str:
    name = f"upper(translate([{', '.join(repr(p) for p in _PLACES)}][CAST(c_custkey % 11 + 1 AS INT)] || '-' || [{', '.join(repr(p) for p in _PLACES)}][CAST(c_custkey // 11 % 11 + 1 AS INT)], '{tx.ACCENTED}', '{tx.PLAIN}'))"
    cases = " ".join(f"WHEN regexp_matches(n, '{m}')" + (f" AND NOT regexp_matches(n, '{x}')" if x else "") + f" THEN '{c}'" for c, m, x in tx.CATEGORIES)
    return f"SELECT c_custkey, CASE {cases} ELSE 'desconocida' END AS category FROM (SELECT c_custkey, {name} AS n FROM customer)"


@query(_category_sql())
def category(spark, d):
    k = F.col("c_custkey")
    pick = lambda i: F.element_at(F.array(*map(F.lit, _PLACES)), (i % 11 + 1).cast("int"))
    return b.table(spark, d, "customer").select("c_custkey", tx.category(tx.folded(F.concat(pick(k), F.lit("-"), pick(F.floor(k / 11))))).alias("category"))


@query("""SELECT o_orderkey, CASE WHEN s <= 0 THEN 0 WHEN s <= 1000 AND w >= 450 AND w::DOUBLE / s > 0.85 THEN 260 WHEN s <= 1200 AND w >= 500 AND w::DOUBLE / s > 0.7 THEN 180 ELSE 0 END AS penalty,
  CAST(greatest(1, floor(w / 80.0 + 0.5)) AS INT) AS walk_min FROM (SELECT o_orderkey, o_orderkey % 1500 AS s, o_custkey % 1200 AS w FROM orders)""")
def short_walk(spark, d):
    s, w = F.col("o_orderkey") % 1500, F.col("o_custkey") % 1200
    return b.table(spark, d, "orders").select("o_orderkey", tx.short_walk_penalty(s, w).alias("penalty"), tx.walk_minutes(w).alias("walk_min"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN 'feriado' WHEN dayofweek(l) = 0 THEN 'domingo' WHEN dayofweek(l) = 6 THEN 'sabado' ELSE 'habil' END AS day_type, CAST(hour(l) * 60 + minute(l) AS INT) AS minute
  FROM (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INT)) - INTERVAL 6 HOUR AS l FROM orders)""")
def day_type_flag(spark, d):
    ts = cal.local(F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int")), "-06:00")
    return b.table(spark, d, "orders").select("o_orderkey", cal.day_type(ts, F.col("o_orderkey") % 31 == 0).alias("day_type"), cal.minute_of_day(ts).alias("minute"))


_CLOCKS = """SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'x:' || (o_orderkey % 60) WHEN o_orderkey % 11 = 0 THEN CAST(o_orderkey % 24 AS VARCHAR) ELSE lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || CASE o_orderkey % 3 WHEN 0 THEN ':' || (o_orderkey % 130) WHEN 1 THEN ':s' ELSE '' END END AS text FROM orders"""


@query(f"SELECT o_orderkey, CAST(TRY_CAST(split_part(text, ':', 1) AS INT) * 60 + TRY_CAST(nullif(split_part(text, ':', 2), '') AS INT) + coalesce(TRY_CAST(nullif(split_part(text, ':', 3), '') AS INT) // 60, 0) AS INT) AS minutes FROM ({_CLOCKS})")
def clock_times(spark, d):
    """Times of day as text, some without minutes, some no time at all."""
    k = F.col("o_orderkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    seconds = F.when(k % 3 == 0, F.concat(F.lit(":"), (k % 130).cast("string"))).when(k % 3 == 1, ":s").otherwise("")
    text = F.when(k % 17 == 0, None).when(k % 13 == 0, F.concat(F.lit("x:"), (k % 60).cast("string"))).when(k % 11 == 0, (k % 24).cast("string")).otherwise(F.concat(two(k % 30), F.lit(":"), two(k % 60), seconds))
    return b.table(spark, d, "orders").select("o_orderkey", cal.clock_minutes(text).alias("minutes"))


_EASTER = """SELECT DISTINCT y, make_date(y, n // 31, n % 31 + 1) AS easter FROM (SELECT y, h + w - 7 * ((y % 19 + 11 * h + 22 * w) // 451) + 114 AS n FROM (
  SELECT y, h, (32 + 2 * ((y // 100) % 4) + 2 * ((y % 100) // 4) - h - (y % 100) % 4) % 7 AS w FROM (
  SELECT y, (19 * (y % 19) + y // 100 - (y // 100) // 4 - ((y // 100) - ((y // 100) + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders))))"""


@query(f"""WITH e AS ({_EASTER}), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CAST(easter AS VARCHAR) AS easter, CASE WHEN month(d) * 100 + day(d) IN (101, 411, 501, 725, 802, 815, 831, 915, 1201, 1225) OR datediff('day', d, easter) IN (2, 3) THEN 'feriado'
  WHEN dayofweek(d) = 0 THEN 'domingo' WHEN dayofweek(d) = 6 THEN 'sabado' ELSE 'habil' END AS day_type FROM o JOIN e ON year(d) = y""")
def day_type_calendar(spark, d):
    day = F.col("o_orderdate").cast("date")
    return b.table(spark, d, "orders").select("o_orderkey", cal.easter(F.year(day)).cast("string").alias("easter"), cal.day_type(day).alias("day_type"))


@query("""SELECT user_id, h % 10000 AS bucket, (h % 10000) / 100.0 < 35 AS on_new FROM (SELECT DISTINCT user_id,
  list_reduce(list_transform(range(1, length('user-' || user_id) + 1), lambda i: CAST(ascii(substr('user-' || user_id, i, 1)) AS BIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM events)""")
def rollout_bucket(spark, d):
    h = tx.fnv1a(F.concat(F.lit("user-"), F.col("user_id")))
    return b.table(spark, d, "events").select("user_id").distinct().select("user_id", (h % 10000).alias("bucket"), ((h % 10000) / 100.0 < 35).alias("on_new"))


@query(b.with_tables("pattern_stops") + """ SELECT pattern_id, count(*) AS n, md5(string_agg(stop_id || ':' || seq || ':' || CAST(board AS VARCHAR) || ':' || CAST(alight AS VARCHAR), '|' ORDER BY seq)) AS signature,
  arg_min(stop_id, seq) AS first_stop, arg_max(stop_id, seq) AS last_stop FROM pattern_stops GROUP BY pattern_id""")
def stop_signature(spark, d):
    part = F.concat_ws(":", "stop_id", "seq", F.col("board").cast("string"), F.col("alight").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("seq", part.alias("p"))))
    return b.pattern_stops(spark, d).groupBy("pattern_id").agg(
        F.count("*").alias("n"), F.md5(F.array_join(F.transform(rows, lambda x: x["p"]), "|")).alias("signature"), F.min_by("stop_id", "seq").alias("first_stop"), F.max_by("stop_id", "seq").alias("last_stop")
    )


@query(b.with_tables("fares") + " SELECT code, fare, valid_from FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY valid_from DESC NULLS LAST, fare_id DESC) AS k FROM fares) WHERE k = 1")
def latest_fare(spark, d):
    return latest_by(b.fares(spark, d), ["code"], F.struct("valid_from", "fare_id")).select("code", "fare", "valid_from")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, concat_ws(',', CASE WHEN l_quantity > 30 THEN 'large' END, CASE WHEN l_discount >= 0.05 THEN 'discounted' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END) AS reasons FROM lineitem""")
def reason_labels(spark, d):
    why = tx.labels((F.col("l_quantity") > 30, "large"), (F.col("l_discount") >= 0.05, "discounted"), (F.col("l_returnflag") == "R", "returned"))
    return b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.array_join(why, ",").alias("reasons"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, count(DISTINCT user_id) AS users, bool_or(user_id % 50 = 0) AS has_zero,
  string_agg(DISTINCT CAST(user_id % 7 AS VARCHAR), ',' ORDER BY CAST(user_id % 7 AS VARCHAR)) AS sevens FROM events GROUP BY event_type HAVING count(*) > 10 OR max(value) > 99""")
def event_summary(spark, d):
    out = b.table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.count_distinct("user_id").alias("users"), F.bool_or(F.col("user_id") % 50 == 0).alias("has_zero"),
        F.array_join(F.array_sort(F.collect_set((F.col("user_id") % 7).cast("string"))), ",").alias("sevens"), F.max("value").alias("_top"),
    )
    return out.filter((F.col("n") > 10) | (F.col("_top") > 99)).drop("_top")


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS total, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM c)
SELECT c_nationkey, c_mktsegment AS top_segment, round(n::DOUBLE / total, 4) AS share FROM t WHERE k = 1""")
def mode_with_share(spark, d):
    counts = b.table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    w = W.partitionBy("c_nationkey")
    ranked = counts.withColumns({"total": F.sum("n").over(w), "k": F.row_number().over(w.orderBy(F.desc("n"), "c_mktsegment"))}).filter("k = 1")
    return ranked.select("c_nationkey", F.col("c_mktsegment").alias("top_segment"), F.round(F.col("n") / F.col("total"), 4).alias("share"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (k = greatest(1, ceil(0.5 * n))) AS p50, max(value) FILTER (k = greatest(1, ceil(0.95 * n))) AS p95, max(value) FILTER (k = greatest(1, ceil(0.99 * n))) AS p99, max(value) AS top FROM r GROUP BY event_type""")
def latency_percentiles(spark, d):
    return nearest_ranks(b.table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "top": 1.0})


@query("""SELECT coalesce(a.k, n.k) AS k, coalesce(n.v, a.v) AS v, coalesce(n.s, a.s) AS s FROM (SELECT o_orderkey AS k, o_orderkey % 100 AS v, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0) a
FULL JOIN (SELECT o_orderkey AS k, o_orderkey % 7 AS v, CASE WHEN o_orderkey % 10 > 3 THEN 'N' END AS s FROM orders WHERE o_orderkey % 2 = 0) n USING (k)""")
def upsert_merge(spark, d):
    o, k = b.table(spark, d, "orders"), F.col("o_orderkey")
    old = o.filter(k % 3 != 0).select(k.alias("k"), (k % 100).alias("v"), F.col("o_orderstatus").alias("s"))
    new = o.filter(k % 2 == 0).select(k.alias("k"), (k % 7).alias("v"), F.when(k % 10 > 3, "N").alias("s"))
    return merged(old, new, ["k"])


@query(b.with_tables("pattern_stops") + """ SELECT pattern_id, stop_id, CASE WHEN seq >= 1 + pattern_id % 3 THEN seq + 1 ELSE seq END AS seq FROM pattern_stops
UNION ALL SELECT pattern_id, -pattern_id AS stop_id, CAST(1 + pattern_id % 3 AS INT) AS seq FROM (SELECT pattern_id, max(seq) AS m FROM pattern_stops GROUP BY pattern_id) WHERE m >= pattern_id % 3""")
def sequence_shift(spark, d):
    """A stop is inserted in every pattern; the stops from there on move up by one."""
    ps = b.pattern_stops(spark, d)
    at = (1 + F.col("pattern_id") % 3).cast("int")
    moved = ps.select("pattern_id", "stop_id", F.when(F.col("seq") >= at, F.col("seq") + 1).otherwise(F.col("seq")).alias("seq"))
    new = ps.groupBy("pattern_id").agg(F.max("seq").alias("m")).filter(F.col("m") >= at - 1).select("pattern_id", (-F.col("pattern_id")).alias("stop_id"), at.alias("seq"))
    return moved.unionByName(new)


@query("SELECT event_id, ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY AS kept FROM events")
def retention(spark, d):
    e = b.table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.crossJoin(F.broadcast(now)).select("event_id", (F.col("ts") >= F.col("now") - F.expr("INTERVAL 10 DAYS")).alias("kept"))


@query(b.with_tables("service_windows") + """, shifted AS (SELECT pattern_id, day_type, CAST(CASE WHEN late THEN -window_id ELSE window_id END AS BIGINT) AS wid, CAST(start + CASE WHEN late THEN 200 ELSE 0 END AS INT) AS begins, CAST(stop + CASE WHEN stop < start THEN 1440 ELSE 0 END + CASE WHEN late THEN 200 ELSE 0 END AS INT) AS ends
  FROM service_windows, (VALUES (false), (true)) v(late) WHERE NOT late OR pattern_id % 5 = 0)
SELECT x.pattern_id, x.wid AS w1, y.wid AS w2, CAST(least(x.ends, y.ends) - greatest(x.begins, y.begins) AS INT) AS overlap FROM shifted x JOIN shifted y ON x.pattern_id = y.pattern_id AND x.day_type = y.day_type WHERE x.wid < y.wid AND x.begins < y.ends AND y.begins < x.ends""")
def window_overlap(spark, d):
    """Windows of one pattern and day type that overlap; a window that ends before it starts runs over midnight."""
    sw = b.service_windows(spark, d).withColumn("e", F.when(F.col("stop") < F.col("start"), F.col("stop") + 1440).otherwise(F.col("stop")))
    late = sw.filter(F.col("pattern_id") % 5 == 0).withColumns({"window_id": -F.col("window_id"), "start": F.col("start") + 200, "e": F.col("e") + 200})
    w = sw.unionByName(late).select("pattern_id", "day_type", "window_id", "start", "e")
    x, y = w.alias("x"), w.alias("y")
    pairs = x.join(y, ["pattern_id", "day_type"]).filter("x.window_id < y.window_id AND x.start < y.e AND y.start < x.e")
    return pairs.select("pattern_id", F.col("x.window_id").alias("w1"), F.col("y.window_id").alias("w2"), (F.least("x.e", "y.e") - F.greatest("x.start", "y.start")).alias("overlap"))


@query("""SELECT p_partkey, len(list_intersect(t, f)) AS shared, round(len(list_intersect(t, f))::DOUBLE / greatest(len(t), len(f)), 4) AS similarity FROM (
SELECT p_partkey, list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS t, list_distinct(list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS f FROM part) WHERE len(t) > 0 AND len(f) > 0""")
def token_similarity(spark, d):
    t, f = tx.name_tokens("p_name"), tx.name_tokens("p_type")
    shared = F.size(F.array_intersect("t", "f"))
    rows = b.table(spark, d, "part").select("p_partkey", t.alias("t"), f.alias("f")).filter((F.size("t") > 0) & (F.size("f") > 0))
    return rows.select("p_partkey", shared.cast("bigint").alias("shared"), F.round(shared / F.greatest(F.size("t"), F.size("f")), 4).alias("similarity"))
