"""Found itineraries as journeys: walks by where they lie, score, signature, duplicates, and walks that the street network corrects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import walk_network_penalty
from .windows import top_k

WALK_METRES_A_POINT, WAIT_WEIGHT, CHANGE_POINTS = 70, 0.25, 12
VALIDATED, SHORT_ORIGIN_M = 24, 250
# Confidence lost where no way was found, by a penalty of so much or more, by any; confidence of a walk that can't be checked.
NO_ROUTE_DROP, LARGE_PENALTY, LARGE_DROP, SOME_DROP, UNCHECKED = 0.32, 1500, 0.22, 0.12, 0.45


def mapped(legs: DataFrame, context: DataFrame) -> DataFrame:
    """One row an itinerary with at least one ride: qid, itinerary_id, n_rides, route_ids, signature, origin_walk_m, transfer_walk_m, final_walk_m, total_walk_m, score.

    ``legs``: itinerary_id, leg, ride (else a walk), route_id, from_stop, to_stop, metres. ``context``: itinerary_id, qid, asked, departure,
    arrival (minutes), from_m, to_m (walks to the first and from the last stop). A walk before the first ride counts to the origin's, one
    after the last to the destination's, any other to the change. Null metres count as none; a route is named once, where it first comes.
    """
    w = W.partitionBy("itinerary_id")
    at = F.when(F.col("ride"), F.col("leg"))
    rows = legs.withColumns({"_first": F.min(at).over(w), "_last": F.max(at).over(w), "_m": F.when(F.col("ride"), 0).otherwise(F.coalesce("metres", F.lit(0)))})
    walked = lambda cond: F.sum(F.when(cond, F.col("_m")).otherwise(0)).cast("int")
    stop = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    ridden = F.array_sort(F.collect_list(F.when(F.col("ride"), F.struct("leg", F.col("route_id").alias("route"), F.concat(stop("from_stop"), F.lit("-"), stop("to_stop")).alias("stops")))))
    one = rows.filter(F.col("_first").isNotNull()).groupBy("itinerary_id").agg(
        F.count_if("ride").cast("int").alias("n_rides"), ridden.alias("_rides"), walked(F.col("leg") < F.col("_first")).alias("_o"), walked(F.col("leg") > F.col("_last")).alias("_f"),
        walked(F.col("leg").between(F.col("_first"), F.col("_last"))).alias("transfer_walk_m"),
    )
    out = one.join(context, "itinerary_id").withColumns({"origin_walk_m": F.col("from_m") + F.col("_o"), "final_walk_m": F.col("to_m") + F.col("_f"), "route_ids": F.array_distinct(F.array_compact(F.col("_rides.route")))})
    out = out.withColumn("total_walk_m", F.col("origin_walk_m") + F.col("final_walk_m") + F.col("transfer_walk_m"))
    score = F.greatest(F.lit(0), F.col("arrival") - F.col("departure")) + F.greatest(F.lit(0), F.col("departure") - F.col("asked")) * WAIT_WEIGHT + F.col("total_walk_m") / float(WALK_METRES_A_POINT) + (F.col("n_rides") - 1) * CHANGE_POINTS
    text = F.concat_ws("|", F.array_join(F.col("route_ids").cast("array<string>"), ","), F.array_join("_rides.stops", ","), F.col("total_walk_m").cast("string"))
    return out.select("qid", "itinerary_id", "n_rides", "route_ids", text.alias("signature"), "origin_walk_m", "transfer_walk_m", "final_walk_m", "total_walk_m", score.alias("score"))


def deduplicated(journeys: DataFrame) -> DataFrame:
    """The best journey of each signature of a query, numbered by score, walking, number of routes, and (ties) the smaller itinerary."""
    order = ["score", "total_walk_m", F.size("route_ids"), "itinerary_id"]
    best = top_k(journeys, ["qid", "signature"], order, 1)
    return best.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order)))


def walks_checked(journeys: DataFrame, walks: DataFrame, limit: int = VALIDATED) -> DataFrame:
    """``journeys`` with walks, score and confidence corrected by the street network for the ``limit`` best of each query; the others stay as they are.

    ``journeys``: qid, itinerary_id, origin_walk_m, final_walk_m, total_walk_m, score, confidence. ``walks``: itinerary_id, place (origin or
    final), status, straight_m, network_m, one row a place. An origin under 250 m with a way, and a walk that couldn't be asked, change nothing.
    """
    for place in ("origin", "final"):
        known = walks.filter(F.col("place") == place).select("itinerary_id", F.col("status").alias(f"_{place}"), F.col("straight_m").alias(f"_{place}_s"), F.col("network_m").alias(f"_{place}_n"))
        journeys = journeys.join(known, "itinerary_id", "left")
    out = journeys.withColumn("_k", F.row_number().over(W.partitionBy("qid").orderBy("score", "itinerary_id")))
    for place in ("origin", "final"):
        status, straight, network, own = F.col(f"_{place}"), F.col(f"_{place}_s"), F.col(f"_{place}_n"), F.col(f"{place}_walk_m")
        found = status == "ok"
        counts = (F.col("_k") <= limit) & status.isNotNull() & (status != "unavailable")
        if place == "origin":
            counts = counts & ~(found & (straight < SHORT_ORIGIN_M))
        points = walk_network_penalty(status, straight, network)
        drop = F.when(status == "no_route", NO_ROUTE_DROP).when(points >= LARGE_PENALTY, LARGE_DROP).when(points > 0, SOME_DROP).otherwise(0.0)
        sure = F.when(F.col("confidence").isNotNull(), F.greatest(F.lit(0.0), F.col("confidence") - drop)).when(found, F.greatest(F.lit(0.0), 1.0 - drop)).otherwise(UNCHECKED)
        new = counts & found & network.isNotNull()
        out = out.withColumns({
            "score": F.col("score") + F.when(counts, points).otherwise(0), "confidence": F.when(counts, sure).otherwise(F.col("confidence")),
            "total_walk_m": F.when(new, F.greatest(F.lit(0), F.col("total_walk_m") - own + network)).otherwise(F.col("total_walk_m")), f"{place}_walk_m": F.when(new, network).otherwise(own),
        })
    return out.drop("_k", *[f"_{p}{x}" for p in ("origin", "final") for x in ("", "_s", "_n")])
