"""GeoJSON in and out, as JSON functions on columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURES = "type string, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """Every feature of the FeatureCollections under ``path`` (one a file): properties (a map), kind, coordinates (JSON text)."""
    rows = spark.read.schema(_FEATURES).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return rows.select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def stops(rows: DataFrame, id_name: str, name: str) -> DataFrame:
    """stop_id, name, lat, lng of point features; those without a numeric id or position go."""
    at = F.from_json("coordinates", "array<double>")
    out = rows.filter("kind = 'Point'").select(F.expr(f"try_cast(properties['{id_name}'] AS bigint)").alias("stop_id"), F.col("properties")[name].alias("name"), F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lng"))
    return out.filter("stop_id IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL")


def routes(rows: DataFrame, id_name: str) -> DataFrame:
    """route_id, part, pos, lat, lng of line features; a single line counts as a line of one part."""
    line, lines = F.from_json("coordinates", "array<array<double>>"), F.from_json("coordinates", "array<array<array<double>>>")
    parts = rows.filter("kind IN ('LineString', 'MultiLineString')").select(F.col("properties")[id_name].alias("route_id"), F.posexplode(F.when(F.col("kind") == "LineString", F.array(line)).otherwise(lines)).alias("part", "p"))
    points = parts.select("route_id", (F.col("part") + 1).alias("part"), F.posexplode("p").alias("pos", "x"))
    return points.select("route_id", "part", (F.col("pos") + 1).alias("pos"), F.col("x")[1].alias("lat"), F.col("x")[0].alias("lng"))


def line_strings(points: DataFrame, line: str, order: str) -> DataFrame:
    """line, geojson: a LineString of the points in order. A line's points are one value, so lines, not their number, are bounded by memory."""
    xy = F.transform(F.array_sort(F.collect_list(F.struct(order, "lng", "lat"))), lambda p: F.array(p["lng"], p["lat"]))
    return points.groupBy(line).agg(F.to_json(F.struct(F.lit("LineString").alias("type"), xy.alias("coordinates"))).alias("geojson"))


def line_points(lines: DataFrame, line: str) -> DataFrame:
    """line, pos (from 1), lat, lng of LineStrings."""
    xy = F.from_json("geojson", "struct<type:string,coordinates:array<array<double>>>")["coordinates"]
    return lines.select(line, F.posexplode(xy).alias("pos", "x")).select(line, (F.col("pos") + 1).alias("pos"), F.col("x")[1].alias("lat"), F.col("x")[0].alias("lng"))
