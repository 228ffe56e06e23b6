"""Positions of vehicles: the last one of each, how old it is, and what it says about waiting. The same functions serve tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, walk_minutes

FRESH_S, EXPIRE_S = 30, 120
# Minutes to wait by the number of fresh vehicles; with stale ones only; without any.
WAIT_FRESH, WAIT_STALE, WAIT_NONE = ((3, 2), (2, 4), (1, 6)), 10, 14


def cleaned(positions: DataFrame) -> DataFrame:
    """Rows with an id and a finite position, with defaults for what a message may lack; a time that can't be read is when the message came.

    ``positions``: driver_id, lat, lng, ts (a timestamp, or text), arrival (the order in which messages came), and optionally received, route, status, speed.
    """
    finite = lambda x: F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & (F.abs(F.col(x).cast("double")) < float("inf"))
    own = lambda name, default, kind: (F.coalesce(F.col(name).cast(kind), F.lit(default)) if name in positions.columns else F.lit(default)).alias(name)
    received = F.col("received") if "received" in positions.columns else F.current_timestamp()
    at = F.coalesce(F.expr("try_cast(ts AS timestamp)"), received)
    return positions.filter(F.col("driver_id").isNotNull() & finite("lat") & finite("lng")).select(
        F.col("driver_id").cast("string").alias("driver_id"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), at.alias("last"), F.col("arrival"),
        own("route", "Desconocida", "string"), own("status", "Activo", "string"), own("speed", None, "double"),
    )


def latest(positions: DataFrame) -> DataFrame:
    """The message that came last from each driver, whatever its own time says; combined before the shuffle."""
    rest = [c for c in positions.columns if c != "driver_id"]
    best = positions.groupBy("driver_id").agg(F.max_by(F.struct(*rest), "arrival").alias("_x"))
    return best.select("driver_id", *[F.col("_x")[c].alias(c) for c in rest])


def aged(state: DataFrame, now: Column, fresh_s: int = FRESH_S, expire_s: int = EXPIRE_S) -> DataFrame:
    """``state`` with age_ms and freshness: fresh (up to ``fresh_s``), stale, or expired (over ``expire_s``)."""
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1000)
    return state.withColumn("age_ms", age).withColumn("freshness", F.when(F.col("age_ms") <= fresh_s * 1000, "fresh").when(F.col("age_ms") <= expire_s * 1000, "stale").otherwise("expired"))


def _key(x) -> Column:
    return F.lower(F.regexp_replace(folded(x), "[^A-Z0-9]+", ""))


def eta(routes: DataFrame, live: DataFrame) -> DataFrame:
    """route_id, matched, fresh, stale, wait_min, walk_min, eta_min, confidence of ``routes`` (route_id, code, route_name, dist_m) by live vehicles (driver_id, route, freshness).

    A vehicle serves a route if its text is the route's id or name, or holds its code, of whatever length. The last is an equi-join too: on the parts of the text
    that are as long as some code. Vehicles of one text and freshness are counted before, and so are met with codes, not with each route that has the code.
    """
    own = routes.select("route_id", "dist_m", _key("code").alias("code_key"), _key("route_name").alias("name_key"))
    said = live.filter("freshness <> 'expired'").groupBy("driver_id", "freshness").agg(F.array_sort(F.collect_set(_key("route"))).alias("texts"))
    text = said.groupBy("texts", "freshness").agg(F.count("*").alias("n")).withColumn("text", F.explode("texts"))
    n, coded = F.length("text"), own.filter("code_key <> ''")
    lengths = coded.agg(F.collect_set(F.length("code_key")).alias("_lengths"))  # one row, as many lengths as the longest code has characters at most
    cuts = F.flatten(F.transform("_lengths", lambda k: F.when(k <= n, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col("text"), i, k))).otherwise(F.array().cast("array<string>"))))
    by_part = text.crossJoin(F.broadcast(lengths)).withColumn("code_key", F.explode(F.array_distinct(cuts)))
    # a route is its set of codes, mostly one: what is met by a code isn't counted again by a name or an id
    codes = own.groupBy("route_id").agg(F.array_sort(F.collect_set(F.when(F.col("code_key") != "", F.col("code_key")))).alias("codes"))
    by_code = by_part.join(codes.select("codes").distinct().withColumn("code_key", F.explode("codes")), "code_key").select("codes", "texts", "freshness", "n").distinct()
    by_name = text.join(own.filter("name_key <> ''"), F.col("text") == F.col("name_key")).select("route_id", "texts", "freshness", "n")
    by_id = text.join(own.withColumn("id_key", F.col("route_id").cast("string")), F.col("text") == F.col("id_key")).select("route_id", "texts", "freshness", "n")
    others = by_name.unionByName(by_id).distinct().join(codes, "route_id").join(by_code, ["codes", "texts", "freshness"], "left_anti")
    total = lambda rows, key: rows.groupBy(key).agg(F.sum("n").alias("matched"), F.sum(F.when(F.col("freshness") == "fresh", F.col("n")).otherwise(0)).alias("fresh"))
    each = codes.join(total(by_code, "codes"), "codes").select("route_id", "matched", "fresh").unionByName(total(others, "route_id"))
    counts = each.groupBy("route_id").agg(F.sum("matched").alias("matched"), F.sum("fresh").alias("fresh"))
    rows = own.join(counts, "route_id", "left").select("route_id", "dist_m", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("fresh", F.lit(0)).alias("fresh")).withColumn("stale", F.col("matched") - F.col("fresh"))
    wait = F.when(F.col("stale") > 0, WAIT_STALE).otherwise(WAIT_NONE)
    for least, minutes in reversed(WAIT_FRESH):
        wait = F.when(F.col("fresh") >= least, minutes).otherwise(wait)
    trust = F.when(F.col("fresh") >= 2, "alta").when(F.col("fresh") == 1, "media").otherwise("baja")
    return rows.select("route_id", "matched", "fresh", "stale", wait.alias("wait_min"), walk_minutes("dist_m").alias("walk_min"), (wait + walk_minutes("dist_m")).alias("eta_min"), trust.alias("confidence"))
