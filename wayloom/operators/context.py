"""What a journey costs beyond its score: progress towards the destination, points by rules, doubtful changes, service groups that are preferred.

A journey is a row: ``routes`` and ``route_ids`` are arrays with its rides in order, a1_lat, a1_lng where the first ride ends, b2_.. and a2_..
where the second begins and ends, z_lat, z_lng where the last ride ends. Nothing here is a UDF, and no group of journeys has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import c, haversine
from ..functions.text import ACCENTED, PLAIN
from .shared import written

# Places that a route's name mentions if it leaves the town.
STRONG_HINTS = ("SAN JOSE", "PASO CANOAS", "LIMON", "PUNTARENAS", "ALAJUELA", "HEREDIA", "TURRIALBA", "NICOYA", "LIBERIA", "UPALA")
MEDIUM_HINTS = ("TRES RIOS", "ZAPOTE", "DESAMPARADOS", "ASERRI", "QUEPOS")
# Metres up to which a trip is short, local, regional; beyond the last no change is discarded. Points for a hint, near and far.
SHORT_M, LOCAL_M, REGIONAL_M, DISCARD_M = 3000, 5500, 10_000, 12_000
STRONG_POINTS, MEDIUM_POINTS = (7.0, 3.0), (3.0, 1.5)
# Points of each reason, for a short trip and for a longer local one.
POINTS = {
    "first-leg-backtrack-high": (28, 18), "first-leg-progress-very-low": (18, 12), "first-leg-progress-low": (10, 6),
    "final-stop-backtrack-high": (14, 9), "final-stop-progress-very-low": (12, 8), "final-stop-progress-low": (6, 4),
    "total-walk-high": (8, 5), "direct-progress-poor": (6, 4), "transfer-low-value": (10, 6),
    "cleanup-transfer-after-near-destination": (22, 12), "cleanup-transfer-gain-tiny": (16, 9), "cleanup-transfer-gain-limited": (10, 6),
    "interurban-plus-local-cleanup": (18, 10),
}
# What a minute until the bus comes counts in the displayed score.
WAIT_POINTS = 1.4


def plain_upper(x) -> Column:
    """Upper case without accents or outer spaces; null becomes empty."""
    return F.upper(F.trim(F.regexp_replace(F.translate(F.coalesce(c(x), F.lit("")), ACCENTED, PLAIN), "[̀-ͯ]", "")))


def _names_any(text: Column) -> Column:
    return text.rlike("|".join(STRONG_HINTS + MEDIUM_HINTS))


def progress(j: DataFrame) -> DataFrame:
    """``j`` with the columns of ``PROGRESS``: how far each end of a ride brings the traveller.

    ``j``: o_lat, o_lng, d_lat, d_lng, the places of the rides, routes, total_walk_m, transfer_walk_m. A distance to or from an unknown place is
    null, and so is what is derived from it, but for the two backtracks, which are 0; ratios are null too if both ends are one place.
    ``first_text``, ``second_text``, ``all_text`` are the names of the routes, made comparable; empty without a ride.
    """
    to_end = lambda at: haversine(f"{at}_lat", f"{at}_lng", "d_lat", "d_lng")
    j = j.withColumns({"_s": haversine("o_lat", "o_lng", "d_lat", "d_lng"), "_first": to_end("a1"), "_last": to_end("z")})
    s, one, end = F.col("_s"), F.col("_first"), F.col("_last")
    share = lambda x: F.when(s > 0, x / s)
    back = lambda x: F.coalesce(F.greatest(F.lit(0.0), x - s), F.lit(0.0))
    fields = {
        "straight_m": s, "first_left_m": one, "final_left_m": end, "first_m": s - one, "final_m": s - end, "first_ratio": share(s - one), "final_ratio": share(s - end),
        "first_back_m": back(one), "final_back_m": back(end), "gain_m": one - end, "total_walk_ratio": share(F.col("total_walk_m")), "transfer_walk_ratio": share(F.col("transfer_walk_m")),
        "second_ride_m": haversine("b2_lat", "b2_lng", "a2_lat", "a2_lng"),
        "first_text": plain_upper(F.get("routes", F.lit(0))), "second_text": plain_upper(F.get("routes", F.lit(1))), "all_text": plain_upper(F.array_join("routes", " ", "")),
    }
    return j.withColumns(fields).drop("_s", "_first", "_last")


# Plain columns, not one struct: the optimizer would write out a struct's expressions again for each use of a field.
PROGRESS = (
    "straight_m", "first_left_m", "final_left_m", "first_m", "final_m", "first_ratio", "final_ratio", "first_back_m", "final_back_m", "gain_m",
    "total_walk_ratio", "transfer_walk_ratio", "second_ride_m", "first_text", "second_text", "all_text",
)


def _progress() -> dict[str, Column]:
    return {n: F.col(n) for n in PROGRESS}


def _out_then_local(p) -> Column:
    """An interurban bus, then a local one."""
    return _names_any(p["first_text"]) & (p["second_text"] != "") & ~_names_any(p["second_text"])


def reasons(p: dict[str, Column], kind: Column, total_walk: Column, transfer_walk: Column, destination: Column) -> Column:
    """The reasons that apply, as an array of (id, points); within a group of rules only the first that fits counts. ``destination`` is made comparable."""
    s, known = p["straight_m"], lambda x, otherwise: F.coalesce(x, otherwise)
    first = known(p["first_ratio"], F.lit(1.0))
    final = known(p["final_ratio"], first)
    change, gain = kind == "transfer", p["gain_m"]
    near = p["first_left_m"] <= F.least(F.lit(320.0), s * 0.22)
    tiny = gain <= F.greatest(F.lit(140.0), s * 0.1)
    poor_gain = (final < 0.58) & (known(p["final_ratio"] - p["first_ratio"], F.lit(1.0)) < 0.16)
    groups = [
        [(p["first_back_m"] >= 250, "first-leg-backtrack-high"), (first < 0.08, "first-leg-progress-very-low"), (first < 0.18, "first-leg-progress-low")],
        [(p["final_back_m"] >= 180, "final-stop-backtrack-high"), (final < 0.32, "final-stop-progress-very-low"), (final < 0.52, "final-stop-progress-low")],
        [((p["total_walk_ratio"] > 0.42) & (total_walk >= 550), "total-walk-high")],
        [((kind == "direct") & (first < 0.16) & (final < 0.4), "direct-progress-poor")],
        [(change & ((first < 0.22) | poor_gain | ((p["transfer_walk_ratio"] > 0.16) & (transfer_walk >= 120))), "transfer-low-value")],
        [(change & near & (transfer_walk >= 50), "cleanup-transfer-after-near-destination"), (change & tiny & (transfer_walk >= 60), "cleanup-transfer-gain-tiny"), (change & (gain <= 240) & (transfer_walk >= 90), "cleanup-transfer-gain-limited")],
        [(change & _out_then_local(p) & (near | tiny), "interurban-plus-local-cleanup")],
    ]
    entry = lambda name, points: F.struct(name.alias("id"), points.cast("double").alias("points"))

    def first_of(rules) -> Column:
        out = F.lit(None)
        for fits, name in reversed(rules):
            short, longer = POINTS[name]
            out = F.when(fits, entry(F.lit(name), F.when(s <= SHORT_M, short).otherwise(longer))).otherwise(out)
        return F.when(s <= LOCAL_M, out)

    def hinted(prefix, hints, points) -> Column:
        named = F.filter(F.array(*map(F.lit, hints)), lambda h: F.contains(p["all_text"], h) & ~F.contains(destination, h))
        return F.transform(named, lambda h: entry(F.concat(F.lit(prefix), h), F.when(s <= REGIONAL_M, points[0]).otherwise(points[1])))

    return F.concat(F.array_compact(F.array(*map(first_of, groups))), hinted("strong-interurban-", STRONG_HINTS, STRONG_POINTS), hinted("medium-interurban-", MEDIUM_HINTS, MEDIUM_POINTS))


def display_scores(j: DataFrame) -> DataFrame:
    """``j`` with the columns of ``progress``, ``reasons`` (array of id and points), ``penalty`` and ``display_score``.

    ``j``: what ``progress`` takes, and kind ('direct', 'transfer'; others and null have no rules of their own), destination_name, score,
    eta_min. Null walks and waits count as 0, a null score gives a null displayed score. Without both ends of the trip only the names of
    places are judged, at the lower points.
    """
    walk = lambda x: F.coalesce(F.col(x), F.lit(0))
    j = progress(j).withColumn("_to", plain_upper("destination_name"))
    found = reasons(_progress(), F.coalesce("kind", F.lit("")), walk("total_walk_m"), walk("transfer_walk_m"), F.col("_to"))
    j = j.withColumn("reasons", found).drop("_to").withColumn("penalty", F.aggregate("reasons", F.lit(0.0), lambda acc, r: acc + r["points"]))
    return j.withColumn("display_score", F.col("score") + walk("eta_min") * WAIT_POINTS + F.col("penalty"))


def doubtful(j: DataFrame) -> DataFrame:
    """``j`` with ``low_value`` (a change to a short local ride at the end of an interurban one) and ``incoherent`` (a first ride the wrong
    way, or an interurban route and a long walk from its stop). ``j`` has the columns of ``progress``, kind, transfer_walk_m, final_walk_m. Neither is ever null."""
    p, s = _progress(), F.col("straight_m")
    change = F.coalesce(F.col("kind") == "transfer", F.lit(False))
    walk = lambda x: F.coalesce(F.col(x), F.lit(0))
    short_ride = p["second_ride_m"] <= F.greatest(F.lit(1200.0), s * 0.2)
    near, tiny = p["first_left_m"] <= F.least(F.lit(360.0), s * 0.24), p["gain_m"] <= F.greatest(F.lit(180.0), s * 0.12)
    low = change & _out_then_local(p) & short_ride & (near | (tiny & (walk("transfer_walk_m") <= 120)))
    final = F.coalesce(p["final_ratio"], F.lit(0.0))
    wrong_way = change & (p["first_back_m"] >= F.greatest(F.lit(800.0), s * 0.25)) & (final < 0.78)
    far_end = _names_any(p["all_text"]) & (walk("final_walk_m") >= 1500) & (final < 0.7)
    said = lambda x: F.coalesce((s <= DISCARD_M) & x, F.lit(False))
    return j.withColumns({"low_value": said(low), "incoherent": said(wrong_way | far_end)})


def coherent(j: DataFrame) -> DataFrame:
    """The rows of ``doubtful`` that stand: no low-value change, and of the rest of a query (qid) none that is incoherent, unless all are.

    Whether a query has a coherent journey is an aggregate a query, combined before the shuffle, and joined back. The rows of a null qid are
    one query. The flags are written first: they are read twice, and a filter on them would be pushed down with all that they are made of.
    """
    left = written(j, "doubtful").filter(~F.col("low_value"))
    some = left.filter(~F.col("incoherent")).select(F.col("qid").alias("_qid")).distinct().withColumn("_some", F.lit(True))
    joined = left.join(some, F.col("qid").eqNullSafe(F.col("_qid")), "left")
    return joined.filter(~F.col("incoherent") | F.col("_some").isNull()).drop("_qid", "_some")


def preferred(j: DataFrame, candidates: DataFrame) -> DataFrame:
    """``j`` with ``boost`` and ``biased_score``: the score less points if a ride belongs to a service group that serves the query.

    ``j``: the columns of ``progress``, qid, kind, route_ids, score. ``candidates``: qid, product_route, preview_route (each may be null), priority (less is
    better), directness, position (the order of the list, for ties). Of the candidates that share a route the best speaks for it, of the
    journey's routes the best candidate, the earlier ride in a tie. A candidate without a priority takes no part; an unknown directness is
    100. A group that comes only after a change counts 0.4, and nothing if an interurban bus was there already. No score falls under 0.
    A query's routes are joined, not its journeys: rows with the same rides share one look-up.
    """
    best = F.struct("priority", "position", F.coalesce("directness", F.lit(100)).alias("directness"), F.array("product_route", "preview_route").alias("own"))
    by_route = candidates.filter("priority IS NOT NULL").select("qid", best.alias("best"), F.explode(F.array("product_route", "preview_route")).alias("route_id"))
    by_route = by_route.filter("route_id IS NOT NULL").groupBy("qid", "route_id").agg(F.min("best").alias("best"))
    asked = j.select("qid", F.col("route_ids").alias("_routes")).distinct()
    legs = asked.select("qid", "_routes", F.posexplode("_routes").alias("leg", "route_id")).join(by_route, ["qid", "route_id"])
    choice = F.struct(F.col("best.priority").alias("priority"), "leg", F.col("best.directness").alias("directness"), F.col("best.own").alias("own"))
    chosen = legs.groupBy("qid", "_routes").agg(F.min(choice).alias("_c")).select(F.col("qid").alias("_q"), F.col("_routes").alias("_r"), "_c")
    j = j.join(chosen, (F.col("qid") == F.col("_q")) & (F.col("route_ids") == F.col("_r")), "left")
    own, p, s = F.col("_c.own"), _progress(), F.col("straight_m")
    at = F.array_min(F.filter(F.transform("route_ids", lambda x, i: F.when(F.array_contains(own, x), i)), lambda i: i.isNotNull()))
    needless = _names_any(p["first_text"]) & F.coalesce((p["first_left_m"] <= F.least(F.lit(320.0), s * 0.22)) | (p["gain_m"] <= F.greatest(F.lit(140.0), s * 0.1)), F.lit(False))
    share = F.when((F.col("kind") == "transfer") & (at > 0), F.when(needless, 0.0).otherwise(0.4)).otherwise(1.0)
    half_up = lambda x: F.floor(x + 0.5)
    base = F.greatest(F.lit(6), half_up((180 - F.least("_c.priority", F.lit(160))) / 4)) + F.greatest(F.lit(0), 12 - half_up(F.least(F.col("_c.directness"), F.lit(60)) / 6))
    # without a candidate nothing: least and greatest would pass over its nulls
    j = j.withColumn("boost", F.when(F.col("_c").isNotNull(), F.greatest(F.lit(0), half_up(base * share))).otherwise(0).cast("int"))
    biased = F.when(F.col("boost") > 0, F.greatest(F.lit(0), F.col("score") - F.col("boost"))).otherwise(F.col("score"))
    # greatest passes over a null: an unknown score stays unknown
    return j.withColumn("biased_score", F.when(F.col("score").isNotNull(), biased)).drop("_q", "_r", "_c")
