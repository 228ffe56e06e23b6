"""The transport tables, bound to the driver's star schema by integer arithmetic that any engine repeats.

The tables that grow say so with a hint, ``merge``: Spark judges them by their small files, and would send millions of rows through the driver to broadcast them.
Some flags are null, which counts as active. Stops are parts, routes are customers, patterns are orders and their stops the order's lines. Stops fill tiles of 2,000, so
the stops near a point don't grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TILE = 2000


def code(n) -> Column:
    """A route's code; every 25th is longer than ten characters."""
    return F.when(n % 25 == 0, F.concat(F.lit("linea-"), F.lpad(n.cast("string"), 5, "0"))).otherwise(n.cast("string"))


def _code(n: str) -> str:
    return f"CASE WHEN {n} % 25 = 0 THEN 'linea-' || lpad(CAST({n} AS VARCHAR), 5, '0') ELSE CAST({n} AS VARCHAR) END"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stops(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    tile = F.floor(k / TILE) % 800
    return table(spark, d, "part").select(
        k.alias("stop_id"), (9.8 + ((k * 7919) % 997) / 10000.0).alias("lat"), (-83.95 + ((k * 6007) % 1009) / 10000.0 + 0.2 * tile).alias("lng"),
        F.col("p_name").alias("name"), F.when(k % 23 != 0, k % 17 != 0).alias("active"),
    ).hint("merge")


def routes(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("route_id"), code(k % 300).alias("code"), F.col("c_name").alias("route_name"), F.col("c_mktsegment").alias("operator")).hint("merge")


def patterns(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("local", "troncal", "expreso", "interurbana"))), (k % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(k.alias("pattern_id"), F.col("o_custkey").alias("route_id"), F.when(k % 2 == 0, "ida").otherwise("vuelta").alias("direction"), kind.alias("category")).hint("merge")


def pattern_stops(spark, d) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("pattern_id"), F.row_number().over(order).alias("seq"), F.col("l_partkey").alias("stop_id"),
        (F.col("l_returnflag") != "R").alias("board"), (F.col("l_linestatus") == "O").alias("alight_o"), F.col("l_quantity").alias("qty"),
    ).withColumn("alight", F.col("alight_o") | (F.col("seq") > 1)).drop("alight_o").hint("merge")


def service_windows(spark, d) -> DataFrame:
    """Three windows a pattern, one of them over midnight; every seventh pattern's second is inactive, and every eleventh has no flag."""
    shapes = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(day).alias("day_type"), F.lit(a).alias("start"), F.lit(b).alias("stop")) for i, (day, a, b) in enumerate((("habil", 300, 540), ("habil", 540, 1200), ("sabado", 1320, 60)))])
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("pattern_id"), F.explode(shapes).alias("w")).select(
        "pattern_id", (F.col("pattern_id") * 3 + F.col("w.i")).alias("window_id"), "w.day_type", "w.start", "w.stop",
        (20 + F.col("pattern_id") % 40).cast("int").alias("headway"), F.when(F.col("pattern_id") % 11 != 0, (F.col("w.i") != 1) | (F.col("pattern_id") % 7 != 0)).alias("active"),
    ).hint("merge")


def fares(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(code(F.col("o_custkey") % 300).alias("code"), F.col("o_orderdate").alias("valid_from"), F.rint("o_totalprice").cast("int").alias("fare"), F.col("o_orderkey").alias("fare_id"))


def trips_wanted(spark, d) -> DataFrame:
    """One origin-destination query a supplier, each within a tile; every third ends beyond the last stops, where few patterns go."""
    k = F.col("s_suppkey")
    tile = F.floor(k / 100) % 800
    return table(spark, d, "supplier").select(
        k.alias("qid"), (9.8 + ((k * 613) % 991) / 10000.0).alias("o_lat"), (-83.95 + ((k * 727) % 1009) / 10000.0 + 0.2 * tile).alias("o_lng"),
        F.when(k % 3 == 0, 9.7903 + (k % 5) / 2000.0).otherwise(9.8 + ((k * 389) % 983) / 10000.0).alias("d_lat"), (-83.95 + ((k * 887) % 997) / 10000.0 + 0.2 * tile).alias("d_lng"),
        (360 + (k * 37) % 700).cast("int").alias("minute"),
    )


def hubs(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        k.alias("hub_id"), F.col("n_name").alias("hub"), (9.8 + ((k * 41) % 100) / 1000.0).alias("lat"), (-83.95 + ((k * 67) % 100) / 1000.0).alias("lng"),
        (800 + (k % 5) * 300).cast("int").alias("radius"), F.col("n_regionkey").alias("priority"),
    )


def positions(spark, d) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(
        e.alias("arrival"), F.when(F.col("user_id") % 50 != 0, F.concat(F.lit("driver-"), F.col("user_id"))).alias("driver_id"), F.col("ts"),
        (9.8 + ((e * 31) % 997) / 10000.0).alias("lat"), F.when(e % 97 != 0, -83.95 + ((e * 57) % 1009) / 10000.0).alias("lng"),
        F.col("event_type").alias("status"), F.col("value").alias("speed"), F.when(e % 4 == 0, F.concat(F.lit("Bus "), code(F.col("user_id") % 300), F.lit(" hoy"))).otherwise(code(F.col("user_id") % 300)).alias("route"),
    )


def journeys(spark, d) -> DataFrame:
    """Some ten journeys a query, of one or two legs over a few routes; walks and scores by arithmetic, with ties."""
    k, q = F.col("o_orderkey"), F.col("o_custkey")
    two = k % 3 == 0
    walk = lambda a, m: ((k * a) % m).cast("int")
    name = lambda n: F.concat(F.element_at(F.array(*map(F.lit, ROUTE_NAMES)), (n % len(ROUTE_NAMES) + 1).cast("int")), F.lit(" "), (q % 3).cast("string"))
    rows = table(spark, d, "orders").select(
        q.alias("qid"), k.alias("journey_id"), F.when(two, 2).otherwise(1).alias("n_legs"), name(k).alias("route1"), F.when(two, name(F.floor(k / 7))).alias("route2"),
        walk(37, 900).alias("origin_walk_m"), walk(53, 1900).alias("final_walk_m"), F.when(two, walk(11, 200)).otherwise(0).alias("transfer_walk_m"),
        walk(29, 60).alias("score"), (k % 15).cast("int").alias("eta_min"), (200 + (q * 97) % 4000).cast("int").alias("trip_m"), (k % 9).alias("final_stop"),
        (9.8 + ((q * 389) % 983) / 10000.0).alias("d_lat"), (-83.95 + ((q * 887) % 997) / 10000.0).alias("d_lng"),
    )
    return rows.withColumn("total_walk_m", F.col("origin_walk_m") + F.col("final_walk_m") + F.col("transfer_walk_m"))


ROUTE_NAMES = ("Cartago - Paraíso", "SAN JOSÉ – CARTAGO", "Taras", "Local  Quircot", "Turrialba Expreso", "Tejar")

# The same bindings for an SQL engine, as common table expressions.
SQL = {
    "stops": "stops AS (SELECT p_partkey AS stop_id, 9.8 + ((p_partkey * 7919) % 997) / 10000.0 AS lat, -83.95 + ((p_partkey * 6007) % 1009) / 10000.0 + 0.2::DOUBLE * ((p_partkey // 2000) % 800) AS lng, p_name AS name, CASE WHEN p_partkey % 23 <> 0 THEN p_partkey % 17 <> 0 END AS active FROM part)",
    "routes": f"routes AS (SELECT c_custkey AS route_id, {_code('(c_custkey % 300)')} AS code, c_name AS route_name, c_mktsegment AS operator FROM customer)",
    "patterns": "patterns AS (SELECT o_orderkey AS pattern_id, o_custkey AS route_id, CASE WHEN o_orderkey % 2 = 0 THEN 'ida' ELSE 'vuelta' END AS direction, ['local', 'troncal', 'expreso', 'interurbana'][CAST(o_orderkey % 4 + 1 AS INT)] AS category FROM orders)",
    "pattern_stops": "pattern_stops AS MATERIALIZED (SELECT pattern_id, seq, stop_id, board, alight_o OR seq > 1 AS alight, qty FROM (SELECT l_orderkey AS pattern_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT) AS seq, l_partkey AS stop_id, l_returnflag <> 'R' AS board, l_linestatus = 'O' AS alight_o, l_quantity AS qty FROM lineitem))",
    "service_windows": "service_windows AS (SELECT o_orderkey AS pattern_id, o_orderkey * 3 + i AS window_id, day_type, start, stop, CAST(20 + o_orderkey % 40 AS INT) AS headway, CASE WHEN o_orderkey % 11 <> 0 THEN i <> 1 OR o_orderkey % 7 <> 0 END AS active FROM orders, (VALUES (0, 'habil', 300, 540), (1, 'habil', 540, 1200), (2, 'sabado', 1320, 60)) s(i, day_type, start, stop))",
    "fares": f"fares AS (SELECT {_code('(o_custkey % 300)')} AS code, o_orderdate AS valid_from, CAST(round_even(o_totalprice, 0) AS INT) AS fare, o_orderkey AS fare_id FROM orders)",
    "trips_wanted": "trips_wanted AS (SELECT s_suppkey AS qid, 9.8 + ((s_suppkey * 613) % 991) / 10000.0 AS o_lat, -83.95 + ((s_suppkey * 727) % 1009) / 10000.0 + 0.2::DOUBLE * ((s_suppkey // 100) % 800) AS o_lng, CASE WHEN s_suppkey % 3 = 0 THEN 9.7903::DOUBLE + (s_suppkey % 5) / 2000.0 ELSE 9.8 + ((s_suppkey * 389) % 983) / 10000.0 END AS d_lat, -83.95 + ((s_suppkey * 887) % 997) / 10000.0 + 0.2::DOUBLE * ((s_suppkey // 100) % 800) AS d_lng, CAST(360 + (s_suppkey * 37) % 700 AS INT) AS minute FROM supplier)",
    "hubs": "hubs AS (SELECT n_nationkey AS hub_id, n_name AS hub, 9.8 + ((n_nationkey * 41) % 100) / 1000.0 AS lat, -83.95 + ((n_nationkey * 67) % 100) / 1000.0 AS lng, CAST(800 + (n_nationkey % 5) * 300 AS INT) AS radius, n_regionkey AS priority FROM nation)",
    "positions": f"positions AS (SELECT event_id AS arrival, CASE WHEN user_id % 50 <> 0 THEN 'driver-' || user_id END AS driver_id, ts, 9.8 + ((event_id * 31) % 997) / 10000.0 AS lat, CASE WHEN event_id % 97 <> 0 THEN -83.95 + ((event_id * 57) % 1009) / 10000.0 END AS lng, event_type AS status, value AS speed, CASE WHEN event_id % 4 = 0 THEN 'Bus ' || {_code('(user_id % 300)')} || ' hoy' ELSE {_code('(user_id % 300)')} END AS route FROM events)",
}


_NAMES = "[" + ", ".join(f"'{n}'" for n in ROUTE_NAMES) + "]"
SQL["journeys"] = f"""journeys AS (SELECT *, origin_walk_m + final_walk_m + transfer_walk_m AS total_walk_m FROM (SELECT o_custkey AS qid, o_orderkey AS journey_id, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS n_legs,
  {_NAMES}[CAST(o_orderkey % 6 + 1 AS INT)] || ' ' || (o_custkey % 3) AS route1, CASE WHEN o_orderkey % 3 = 0 THEN {_NAMES}[CAST((o_orderkey // 7) % 6 + 1 AS INT)] || ' ' || (o_custkey % 3) END AS route2,
  CAST((o_orderkey * 37) % 900 AS INT) AS origin_walk_m, CAST((o_orderkey * 53) % 1900 AS INT) AS final_walk_m, CAST(CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 11) % 200 ELSE 0 END AS INT) AS transfer_walk_m, CAST((o_orderkey * 29) % 60 AS INT) AS score,
  CAST(o_orderkey % 15 AS INT) AS eta_min, CAST(200 + (o_custkey * 97) % 4000 AS INT) AS trip_m, o_orderkey % 9 AS final_stop, 9.8 + ((o_custkey * 389) % 983) / 10000.0 AS d_lat, -83.95 + ((o_custkey * 887) % 997) / 10000.0 AS d_lng FROM orders))"""


def metres_sql(a: str, b: str, c: str, d: str) -> str:
    x = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * 6371000.0 * asin(sqrt(CASE WHEN {x} > 1 THEN 1.0::DOUBLE ELSE {x} END)))"


def with_tables(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)
