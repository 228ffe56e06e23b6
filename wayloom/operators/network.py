"""Stop areas, boarding points and walking edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spatial import dbscan, radius_join
from .windows import top_k

WALK_M, HUB_WALK_M, HUB_PATTERNS = 200, 650, 3


def walking_edges(stops: DataFrame, pattern_stops: DataFrame) -> DataFrame:
    """from_stop, to_stop, dist_m, minutes, confidence: up to 200 m between any stops, up to 650 m between stops of three or more patterns each; both directions."""
    served = pattern_stops.groupBy("stop_id").agg(F.count_distinct("pattern_id").alias("np"))
    own = stops.join(served, "stop_id", "left").select("stop_id", "lat", "lng", (F.coalesce("np", F.lit(0)) >= HUB_PATTERNS).alias("hub"))
    other = own.select(F.col("stop_id").alias("to_stop"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), F.col("hub").alias("r_hub"))
    # most stops only reach the short radius: the long one is a join of hubs with hubs
    short = radius_join(own, other, WALK_M)
    long = radius_join(own.filter("hub"), other.filter("r_hub"), HUB_WALK_M).filter(F.col("dist") > WALK_M)
    pairs = short.unionByName(long).filter(F.col("stop_id") != F.col("to_stop"))
    minutes = F.least(F.lit(8), F.greatest(F.lit(1), F.floor(F.col("dist") / 84.0 + 0.5))).cast("int")
    return pairs.select(F.col("stop_id").alias("from_stop"), "to_stop", F.rint("dist").cast("int").alias("dist_m"), minutes.alias("minutes"), F.lit(0.75).alias("confidence"))


def resolved_edges(real: DataFrame, synthetic: DataFrame, known: DataFrame) -> DataFrame:
    """One edge a direction: a real one before a synthetic one, then the fewest minutes. Edges to themselves, or with an unknown stop, go."""
    both = real.withColumn("source", F.lit("real")).unionByName(synthetic.withColumn("source", F.lit("synthetic")))
    ok = both.filter("from_stop <> to_stop").join(known.select(F.col("stop_id").alias("from_stop")), "from_stop", "left_semi").join(known.select(F.col("stop_id").alias("to_stop")), "to_stop", "left_semi")
    return top_k(ok, ["from_stop", "to_stop"], ["source", "minutes", "dist_m"], 1)


def stop_areas(stops: DataFrame, macro_m: float = 120, micro_m: float = 35) -> DataFrame:
    """stop_id, macro, micro: two levels of clusters, the lower within the upper; a stop on its own is an area of its own."""
    macro = dbscan(stops, "stop_id", macro_m, 2).select("stop_id", F.coalesce("cluster", "stop_id").alias("macro"))
    own = stops.join(macro, "stop_id")
    micro = dbscan(own, "stop_id", micro_m, 1, within="macro").select("stop_id", F.col("cluster").alias("micro"))
    return macro.hint("merge").join(micro, "stop_id")


def area_summary(areas: DataFrame, stops: DataFrame) -> DataFrame:
    """micro, macro, members, display name (most frequent, then alphabetical) with its share, centre, key."""
    rows = areas.join(stops.select("stop_id", "name", "lat", "lng"), "stop_id")
    names = rows.groupBy("micro", "name").agg(F.count("*").alias("n"))
    w = W.partitionBy("micro")
    name = names.withColumns({"total": F.sum("n").over(w), "k": F.row_number().over(w.orderBy(F.desc("n"), "name"))}).filter("k = 1")
    base = rows.groupBy("micro").agg(F.min("macro").alias("macro"), F.count("*").alias("members"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng"))
    return base.join(name.hint("merge"), "micro").select("micro", "macro", "members", "lat", "lng", F.col("name").alias("display_name"), F.round(F.col("n") / F.col("total"), 4).alias("name_share"), F.md5(F.col("micro").cast("string")).alias("area_key"))


def edge_confidence(kind: Column, dist: Column) -> Column:
    """Falls with distance from 1 to a floor: .80 inside an area (160 m), .35 between areas (220 m)."""
    same = F.greatest(F.lit(0.8), 1 - dist / 160.0 * 0.2)
    near = F.greatest(F.lit(0.35), 0.75 - dist / 220.0 * 0.4)
    return F.round(F.when(kind == "same_macro", same).otherwise(near), 4)


def transfer_edges(areas: DataFrame, stops: DataFrame) -> DataFrame:
    """Directed walking edges between boarding points: same_macro up to 160 m, nearby_walk up to 220 m."""
    own = areas.join(stops.select("stop_id", "lat", "lng"), "stop_id")
    other = own.select(F.col("stop_id").alias("to_stop"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), F.col("macro").alias("r_macro"))
    pairs = radius_join(own, other, 220).filter(F.col("stop_id") != F.col("to_stop"))
    kind = F.when(F.col("macro") == F.col("r_macro"), "same_macro").otherwise("nearby_walk")
    edges = pairs.withColumn("kind", kind).filter((F.col("kind") == "nearby_walk") | (F.col("dist") <= 160))
    return edges.select(F.col("stop_id").alias("from_stop"), "to_stop", "kind", F.rint("dist").cast("int").alias("dist_m"), F.ceil(F.rint("dist") / 80.0).cast("int").alias("minutes"), edge_confidence(F.col("kind"), F.rint("dist")).alias("confidence"))


def transfer_links(edges: DataFrame, boarding_stops: DataFrame) -> DataFrame:
    """All ways to change: at the same stop, then over edges; one link a pair by source, type, distance and confidence."""
    same = boarding_stops.select(F.col("stop_id").alias("from_stop"), F.col("stop_id").alias("to_stop"), F.lit("same_stop").alias("kind"), F.lit(0).alias("dist_m"), F.lit(1.0).alias("confidence"), F.lit(0).alias("prio"))
    walk = edges.select("from_stop", "to_stop", "kind", "dist_m", "confidence", F.lit(1).alias("prio"))
    order = F.when(F.col("kind") == "same_stop", 0).when(F.col("kind") == "same_macro", 1).otherwise(2)
    return top_k(same.unionByName(walk).withColumn("_o", order), ["from_stop", "to_stop"], ["prio", "_o", "dist_m", F.desc("confidence")], 1).drop("_o", "prio")
