"""Edits of patterns and windows: each is a function from tables to tables, no table is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine
from .shared import written
from .timetable import squashed

RIDE_M_PER_MIN = 380


def rotated(rows: DataFrame, anchor: Column) -> DataFrame:
    """Circular patterns renumbered to begin at the stop with sequence ``anchor``; repeated neighbours go. ``rows``: pattern_id, seq, stop_id."""
    w = W.partitionBy("pattern_id")
    turned = rows.withColumns({"_top": F.max("seq").over(w), "_at": anchor})
    turned = turned.withColumn("seq", F.when(F.col("seq") >= F.col("_at"), F.col("seq") - F.col("_at") + 1).otherwise(F.col("seq") + F.col("_top") - F.col("_at") + 1)).drop("_top", "_at")
    return squashed(turned).withColumn("seq", F.row_number().over(w.orderBy("seq")))


def with_terminals(rows: DataFrame, terminals: DataFrame, stops: DataFrame) -> DataFrame:
    """Patterns with a terminal put before the first stop (sequence 0; the rest moves up in metres and minutes) or after the last.

    ``rows``: pattern_id, seq, stop_id, cum_m, cum_min. ``terminals``: pattern_id, terminal, at_start. A pattern that has the stop already, or whose
    terminal is unknown, stays as it is.
    """
    at = stops.select("stop_id", "lat", "lng")
    ends = rows.groupBy("pattern_id").agg(
        F.min_by(F.struct("stop_id", "seq"), "seq").alias("a"), F.max_by(F.struct("stop_id", "seq", "cum_m", "cum_min"), "seq").alias("z"), F.collect_set("stop_id").alias("has")
    )
    new = ends.join(terminals, "pattern_id").filter(~F.array_contains("has", F.col("terminal"))).drop("has").withColumn("end_stop", F.when(F.col("at_start"), F.col("a.stop_id")).otherwise(F.col("z.stop_id")))
    new = new.join(at.select(F.col("stop_id").alias("terminal"), "lat", "lng"), "terminal").join(at.select(F.col("stop_id").alias("end_stop"), F.col("lat").alias("e_lat"), F.col("lng").alias("e_lng")), "end_stop")
    m = F.rint(haversine("lat", "lng", "e_lat", "e_lng")).cast("int")
    new = new.withColumn("m", m).withColumn("min", F.greatest(F.lit(1), F.floor(F.col("m") / float(RIDE_M_PER_MIN) + 0.5)).cast("int"))
    added = new.select(
        "pattern_id", F.when(F.col("at_start"), 0).otherwise(F.col("z.seq") + 1).alias("seq"), F.col("terminal").alias("stop_id"),
        F.when(F.col("at_start"), 0).otherwise(F.col("z.cum_m") + F.col("m")).alias("cum_m"), F.when(F.col("at_start"), 0).otherwise(F.col("z.cum_min") + F.col("min")).alias("cum_min"),
    )
    shift = new.filter("at_start").select("pattern_id", F.col("m").alias("_m"), F.col("min").alias("_min"))
    zero = F.lit(0)
    moved = rows.join(shift, "pattern_id", "left").select("pattern_id", "seq", "stop_id", (F.col("cum_m") + F.coalesce("_m", zero)).alias("cum_m"), (F.col("cum_min") + F.coalesce("_min", zero)).alias("cum_min"))
    return moved.unionByName(added)


def gated(rows: DataFrame, patterns: DataFrame, gates: DataFrame) -> DataFrame:
    """``rows`` without boarding where a gate (route_id, low, high: sequences) of the pattern's route holds; alighting stays."""
    shut = rows.join(patterns.select("pattern_id", "route_id"), "pattern_id").join(gates, "route_id").filter("seq BETWEEN low AND high").select("pattern_id", "seq").distinct().withColumn("_shut", F.lit(True))
    return rows.join(shut, ["pattern_id", "seq"], "left").withColumn("board", F.col("board") & F.col("_shut").isNull()).drop("_shut")


def inverted(rows: DataFrame, flag: Column) -> DataFrame:
    """Patterns where ``flag`` holds get their stops in the opposite order."""
    n = F.count("*").over(W.partitionBy("pattern_id"))
    w = W.partitionBy("pattern_id").orderBy(F.when(F.col("_f"), -F.col("seq")).otherwise(F.col("seq")))
    return rows.withColumn("_f", flag).withColumn("seq", F.row_number().over(w)).withColumn("n_stops", n).drop("_f")


def rebuilt(old: DataFrame, new: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of the keys in ``scope`` replaced by those of ``new``."""
    return old.join(scope, key, "left_anti").unionByName(new.join(scope, key, "left_semi"))


def corrected_windows(windows: DataFrame, off: Column, reason: str, single: DataFrame) -> DataFrame:
    """Windows where ``off`` holds are switched off, with the reason in ``note``; each row of ``single`` (pattern_id, window_id, day_type, start) becomes
    a window of one minute, which has one departure."""
    marked = windows.withColumn("_off", off).withColumns({"note": F.when(F.col("_off"), F.to_json(F.struct(F.lit(reason).alias("reason"), F.col("active").alias("was"))))}).withColumn("active", F.col("active") & ~F.col("_off")).drop("_off")
    new = single.withColumns({"stop": F.col("start") + 1, "headway": F.lit(60), "active": F.lit(True), "note": F.lit(None).cast("string")})
    return marked.unionByName(new.select(*marked.columns))


def batches(keys: DataFrame, key: str, size: int) -> DataFrame:
    """Ordered keys in batches of ``size``: batch (from 0), low, high, n. Numbers come from dense_ids, so keys may be many."""
    numbered = dense_ids(keys, key, "_i")
    return numbered.groupBy(F.floor(F.col("_i") / size).alias("batch")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"))


def dense_ids(keys: DataFrame, key: str, name: str = "dense_id") -> DataFrame:
    """Every distinct key with its place in order, from 0.

    Keys are range-partitioned; each partition numbers its own, from where those before it end: only one count a partition meets in one task.
    """
    part = written(keys.select(key).distinct().repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = part.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_from", before).select("_p", "_from")
    own = F.row_number().over(W.partitionBy("_p").orderBy(key))
    return part.join(F.broadcast(starts), "_p").select(key, (F.col("_from") + own - 1).alias(name))
