"""Ranking of journeys: reasons with score points, as rows, and what they add up to.

A journey: qid, journey_id, n_legs, routes (folded names), origin_walk_m, final_walk_m, total_walk_m, score, ... Whether a better alternative exists in
the same query is a semi-join: no pair of journeys is ever listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import circle_join

# Points of the reasons, and the limits they go by (metres, score points).
DIRECT = {"id": "direct_alternative", "points": 35, "score": 30, "origin": 250, "total": 350, "final": 250}
FAR_DROP = {"id": "far_drop", "points": 35, "far": 1000, "near": 600, "final": 800, "total": 250, "score": 35}
WALK = {"id": "walk_dominant", "points": 10, "near": 500, "final": 220, "total": 250, "score": 8, "far": 900, "direct_total": 600, "direct_score": 10}
SHORT_HOP = {"id": "walk_vs_wait", "points": 8, "least": 250, "most": 1700, "walk": 350, "share": 0.95}
SAME_ROUTE = {"origin": 180, "score": 2}
ETA_WEIGHT = 1.4


def _exists(journeys: DataFrame, own: Column, better: Column, alike: list[tuple[str, str]]) -> DataFrame:
    """The journeys (j) where ``own`` holds and another one (c) of the query, equal in the columns ``alike``, is ``better``."""
    j, c = journeys.filter(own).alias("j"), journeys.alias("c")
    on = (F.col("j.qid") == F.col("c.qid")) & (F.col("j.journey_id") != F.col("c.journey_id")) & better
    for a, b in alike:
        on &= F.col(f"j.{a}") == F.col(f"c.{b}")
    return j.join(c, on, "left_semi")


def _reason(rows: DataFrame, rule: dict) -> DataFrame:
    return rows.select("qid", "journey_id", F.lit(rule["id"]).alias("reason"), F.lit(float(rule["points"])).alias("points"))


def alternatives(journeys: DataFrame) -> DataFrame:
    """qid, journey_id, reason, points: journeys that another of their query makes pointless, and short hops that are better walked.

    * a change, where a direct journey by its first route costs and walks little more;
    * a far drop by a single route, where one that shares a route gets near;
    * a long last walk, where another with few legs walks much less for about the same score.
    """
    j, c = (lambda x: F.col(f"j.{x}")), (lambda x: F.col(f"c.{x}"))
    d, f, w, s = DIRECT, FAR_DROP, WALK, SHORT_HOP
    direct = _exists(
        journeys, F.col("n_legs") >= 2,
        (c("n_legs") == 1) & (c("origin_walk_m") <= j("origin_walk_m") + d["origin"]) & (c("score") <= j("score") + d["score"]) & (c("total_walk_m") <= j("total_walk_m") + d["total"]) & (c("final_walk_m") <= j("final_walk_m") + d["final"]),
        [("first_route", "first_route")],
    )
    far = _exists(
        journeys, (F.col("n_legs") == 1) & (F.col("final_walk_m") >= f["far"]),
        F.arrays_overlap(j("routes"), c("routes")) & (c("final_walk_m") <= f["near"]) & (c("final_walk_m") <= j("final_walk_m") - f["final"]) & (c("total_walk_m") <= j("total_walk_m") - f["total"]) & (c("score") <= j("score") + f["score"]),
        [],
    )
    near = c("final_walk_m") <= w["near"]
    single = (c("n_legs") <= 2) & near & (c("total_walk_m") <= j("total_walk_m") - w["direct_total"]) & (c("score") <= j("score") + w["direct_score"])
    changed = (c("n_legs") >= 2) & (c("n_legs") <= j("n_legs")) & near & (c("final_walk_m") <= j("final_walk_m") - w["final"]) & (c("total_walk_m") <= j("total_walk_m") - w["total"]) & (c("score") <= j("score") + w["score"])
    walk = _exists(journeys, (F.col("n_legs") == 1) & (F.col("final_walk_m") >= w["far"]), single, []).unionByName(_exists(journeys, F.col("n_legs") >= 2, changed, []))
    ends = F.col("origin_walk_m") + F.col("final_walk_m")
    hop = journeys.filter(F.col("trip_m").between(s["least"], s["most"]) & (ends >= F.greatest(F.lit(float(s["walk"])), F.col("trip_m") * s["share"])))
    return _reason(direct, d).unionByName(_reason(far, f)).unionByName(_reason(walk, w)).unionByName(_reason(hop, s))


def ruled(journeys: DataFrame, rules: DataFrame, areas: DataFrame) -> DataFrame:
    """qid, journey_id, reason, points by a table of rules over areas.

    ``rules``: rule_id, area_id, hints (folded text parts; a journey fits if one stands in a route's name), wants_fit, min_walk, max_walk (of the last walk),
    needs_other (another journey of the query fits and drops within ``near_walk``), near_walk, points. ``areas``: area_id, lat, lng, radius: circles around
    destinations (d_lat, d_lng of the journeys). Rules and areas are data: none is in the code.
    """
    circles = areas.select("area_id", F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), "radius")
    ends = journeys.select("qid", "d_lat", "d_lng").distinct()
    asked = circle_join(ends, circles, "radius", "d_lat", "d_lng").select("qid", "area_id").distinct().join(rules, "area_id")
    fits = F.exists("routes", lambda r: F.exists("hints", lambda h: F.contains(r, h)))
    rows = journeys.join(asked, "qid").withColumn("fits", fits)
    good = rows.filter("fits AND final_walk_m <= near_walk").groupBy("qid", "rule_id").agg(F.count("*").alias("good"))
    rows = rows.join(good, ["qid", "rule_id"], "left")
    others = F.coalesce("good", F.lit(0)) - (F.col("fits") & (F.col("final_walk_m") <= F.col("near_walk"))).cast("int")
    ok = (F.col("fits") == F.col("wants_fit")) & F.col("final_walk_m").between(F.col("min_walk"), F.col("max_walk")) & (~F.col("needs_other") | (others > 0))
    return rows.filter(ok).select("qid", "journey_id", F.col("rule_id").alias("reason"), F.col("points").cast("double").alias("points"))


def summed(reasons: DataFrame) -> DataFrame:
    """qid, journey_id, points (of all reasons), reasons: the visible ones, each once, sorted; a reason and the ``cancel-`` one that undoes it are not shown."""
    once = reasons.groupBy("qid", "journey_id", "reason").agg(F.sum("points").alias("points"), F.first("points").alias("one"))
    per = once.groupBy("qid", "journey_id").agg(F.sum("points").alias("points"), F.array_sort(F.collect_list(F.struct("reason", "one"))).alias("r"))
    undone = lambda x: F.exists("r", lambda y: ((y["reason"] == F.concat(F.lit("cancel-"), x["reason"])) | (x["reason"] == F.concat(F.lit("cancel-"), y["reason"]))) & (x["one"] + y["one"] == 0))
    return per.select("qid", "journey_id", "points", F.transform(F.filter("r", lambda x: ~undone(x)), lambda x: x["reason"]).alias("reasons"))


def ranked(journeys: DataFrame, reasons: DataFrame) -> DataFrame:
    """``journeys`` with display_score (score, waiting and reasons), reasons and rank: by that score, then walking, then legs, then id."""
    from pyspark.sql import Window as W

    rows = journeys.join(summed(reasons), ["qid", "journey_id"], "left")
    rows = rows.withColumns({"display_score": F.round(F.col("score") + F.col("eta_min") * ETA_WEIGHT + F.coalesce("points", F.lit(0.0)), 4), "reasons": F.coalesce("reasons", F.array().cast("array<string>"))})
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("display_score", "total_walk_m", "n_legs", "journey_id")))


def inferior_boardings(ranked_rows: DataFrame) -> DataFrame:
    """qid, journey_id of those whose routes and last stop another journey has too, boarded nearer by 180 m with less walking and about no worse score."""
    j, c = (lambda x: F.col(f"j.{x}")), (lambda x: F.col(f"c.{x}"))
    rows = ranked_rows.withColumn("chain", F.array_join("routes", "@"))
    better = (c("origin_walk_m") + SAME_ROUTE["origin"] <= j("origin_walk_m")) & (c("total_walk_m") < j("total_walk_m")) & (j("display_score") >= c("display_score") - SAME_ROUTE["score"])
    return _exists(rows, F.lit(True), better, [("chain", "chain"), ("final_stop", "final_stop")]).select("qid", "journey_id")
