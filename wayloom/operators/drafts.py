"""Change drafts of stops and versions of geometry: logs of edits, replayed to the state that they lead to."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .edits import dense_ids
from .shared import written

ACTIONS = ("create_stop", "move_stop", "rename_stop", "deactivate_stop", "attach_stop_to_route", "detach_stop_from_route")
WAYS = ("ida", "vuelta", "loop")


def checked_drafts(drafts: DataFrame, stops: DataFrame) -> DataFrame:
    """``drafts`` with ``status`` (applied, rejected, undone) and the stop that each is about; a new stop gets the next free id, in order of drafts.

    ``drafts``: draft_id, action, stop_id, route_id, direction, target_order, lat, lng, name, board, alight, undone (null: false). A draft is rejected if its action is unknown, if it
    creates or moves a stop without a position, names none that exists (all but create), renames without a name, or attaches or detaches without a route. Only
    applied drafts change anything.
    """
    known = stops.select("stop_id").distinct().withColumn("_known", F.lit(True))
    own = drafts.join(known, "stop_id", "left").withColumn("name", F.when(F.trim("name") != "", F.trim("name")))
    a, new = F.col("action"), F.col("action") == "create_stop"
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    ok = a.isin(*ACTIONS) & (~a.isin("create_stop", "move_stop") | placed) & (new | F.col("_known").isNotNull()) & ((a != "rename_stop") | F.col("name").isNotNull())
    ok &= ~a.isin("attach_stop_to_route", "detach_stop_from_route") | F.col("route_id").isNotNull()
    status = F.when(F.coalesce("undone", F.lit(False)), "undone").when(F.coalesce(ok, F.lit(False)), "applied").otherwise("rejected")
    own = written(own.withColumn("status", status).drop("_known"), "drafts")
    made = dense_ids(own.filter(new & (F.col("status") == "applied")), "draft_id", "_made")
    top = stops.agg(F.coalesce(F.max("stop_id"), F.lit(0)).alias("_top"))
    out = own.join(made, "draft_id", "left").crossJoin(F.broadcast(top))
    return out.withColumn("stop_id", F.when(new, F.col("_top") + 1 + F.col("_made")).otherwise(F.col("stop_id"))).drop("_made", "_top")


def drafted_stops(stops: DataFrame, drafts: DataFrame) -> DataFrame:
    """stop_id, lat, lng, name, active, source after all applied drafts (``checked_drafts``), each column as the last draft that sets it leaves it.

    A stop that a draft touches is ``manual`` if it was from ``osm``; new stops are active and manual. A move without a name keeps the name.
    """
    own = drafts.filter("status = 'applied'")
    placed = F.col("action").isin("create_stop", "move_stop")
    named = F.col("action").isin("create_stop", "move_stop", "rename_stop") & F.col("name").isNotNull()
    edited = F.col("action").isin("move_stop", "rename_stop", "deactivate_stop")
    last = own.groupBy("stop_id").agg(
        F.max_by(F.when(placed, F.struct("lat", "lng")), F.when(placed, F.col("draft_id"))).alias("_at"), F.max_by(F.when(named, F.col("name")), F.when(named, F.col("draft_id"))).alias("_name"),
        F.max(F.col("action") == "deactivate_stop").alias("_off"), F.max(edited).alias("_edited"), F.max(F.col("action") == "create_stop").alias("_new"),
    )
    both = stops.join(last, "stop_id", "full")
    return both.select(
        "stop_id", F.coalesce("_at.lat", "lat").alias("lat"), F.coalesce("_at.lng", "lng").alias("lng"), F.coalesce("_name", "name").alias("name"),
        F.when(F.col("_off"), False).when(F.col("_new"), True).otherwise(F.col("active")).alias("active"), F.when(F.col("_new") | F.col("_edited") & (F.col("source") == "osm"), "manual").otherwise(F.col("source")).alias("source"),
    )


def drafted_routes(route_stops: DataFrame, drafts: DataFrame) -> DataFrame:
    """route_id, direction, ord, stop_id, board, alight after all attaching and detaching drafts: one fold over a route's drafts in order, for routes that have any.

    Attaching puts the stop at target_order (null: 0) and moves up what stands there and after; a draft that creates a stop and names a route attaches it. Detaching takes out every row of the stop
    and closes the gaps. The direction ``ambos`` is every direction that the route has at that moment (attaching) or has the stop in (detaching); without any, attaching makes ``ambos`` a direction of its
    own. No direction means ``ida`` when attaching, ``ambos`` when detaching. A route's rows and drafts meet in one task; routes are folded side by side.
    """
    state = "array<struct<direction: string, ord: int, stop_id: bigint, board: boolean, alight: boolean>>"
    row = ("direction", F.col("ord").cast("int").alias("ord"), F.col("stop_id").cast("bigint").alias("stop_id"), "board", "alight")
    attach = F.col("action").isin("create_stop", "attach_stop_to_route")
    own = drafts.filter("status = 'applied' AND route_id IS NOT NULL").filter(attach | (F.col("action") == "detach_stop_from_route"))
    way = F.coalesce(F.when(F.col("direction") != "", F.col("direction")), F.when(attach, "ida").otherwise("ambos"))
    log = own.select("route_id", F.struct(
        "draft_id", attach.alias("attach"), way.alias("way"), F.greatest(F.lit(0), F.coalesce("target_order", F.lit(0))).cast("int").alias("at"), F.col("stop_id").cast("bigint").alias("stop"),
        F.coalesce("board", F.lit(True)).alias("board"), F.coalesce("alight", F.lit(True)).alias("alight")).alias("x"))
    log = log.groupBy("route_id").agg(F.array_sort(F.collect_list("x")).alias("log"))
    held = route_stops.join(log.select("route_id"), "route_id", "left_semi").groupBy("route_id").agg(F.collect_list(F.struct(*row)).alias("rows"))

    def step(rows, x):
        ways = F.array_distinct(F.transform(F.filter(rows, lambda r: r["direction"].isin(*WAYS)), lambda r: r["direction"]))
        ways = F.when(x["way"] != "ambos", F.array(x["way"])).when(F.size(ways) > 0, ways).otherwise(F.array(F.lit("ambos")))
        moved = F.transform(rows, lambda r: F.struct(r["direction"].alias("direction"), (r["ord"] + (F.array_contains(ways, r["direction"]) & (r["ord"] >= x["at"])).cast("int")).alias("ord"), r["stop_id"].alias("stop_id"), r["board"].alias("board"), r["alight"].alias("alight")))
        put = F.transform(ways, lambda w: F.struct(w.alias("direction"), x["at"].alias("ord"), x["stop"].alias("stop_id"), x["board"].alias("board"), x["alight"].alias("alight")))
        gone = F.filter(rows, lambda r: (r["stop_id"] == x["stop"]) & ((x["way"] == "ambos") | (r["direction"] == x["way"])))
        before = lambda r: F.size(F.filter(gone, lambda g: (g["direction"] == r["direction"]) & (g["ord"] < r["ord"])))
        left = F.filter(rows, lambda r: ~((r["stop_id"] == x["stop"]) & ((x["way"] == "ambos") | (r["direction"] == x["way"]))))
        closed = F.transform(left, lambda r: F.struct(r["direction"].alias("direction"), (r["ord"] - before(r)).alias("ord"), r["stop_id"].alias("stop_id"), r["board"].alias("board"), r["alight"].alias("alight")))
        return F.when(x["attach"], F.concat(moved, put)).otherwise(closed).cast(state)

    folded = log.join(held, "route_id", "left").select("route_id", F.aggregate("log", F.coalesce(F.col("rows").cast(state), F.array().cast(state)), step).alias("rows"))
    new = folded.select("route_id", F.explode("rows").alias("r")).select("route_id", "r.*")
    return route_stops.join(log.select("route_id"), "route_id", "left_anti").select("route_id", *row).unionByName(new)


def changed_patterns(before: DataFrame, after: DataFrame) -> DataFrame:
    """route_id, direction, seq, stop_id, board, alight of the patterns whose rows differ, numbered anew from 1; one that lost all its rows isn't there.

    Both: route_id, direction, ord, stop_id, board, alight. A pattern is its rows in order, so the same rows under other numbers are no change.
    """
    def signed(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("route_id", "direction").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "stop_id", "board", "alight"))), lambda x: F.struct(x["stop_id"].alias("stop_id"), x["board"].alias("board"), x["alight"].alias("alight"))).alias(name))

    new = signed(after, "_new").join(signed(before, "_old"), ["route_id", "direction"], "left").filter("_old IS NULL OR _old <> _new").select("route_id", "direction", F.posexplode("_new").alias("i", "x"))
    return new.select("route_id", "direction", (F.col("i") + 1).alias("seq"), "x.stop_id", "x.board", "x.alight")


def _replayed(batches):
    """Batches of a log that lies by route and event, with ``ok`` and ``shown``: the geometry shown and the versions there are, carried from event to event."""
    route, shown, versions, latest = (), None, {}, []
    for batch in batches:
        oks, showns = [], []
        for r, event, op, version in zip(*(batch.column(c).to_pylist() for c in ("route_id", "event", "op", "version"))):
            if r != route:
                route, shown, versions, latest = r, None, {}, []
            was, ok, makes = shown, False, False
            if op == "apply":
                shown, ok, makes = event, True, was is not None
            elif op == "backup":
                ok = makes = was is not None
            elif op == "delete_version":
                ok = versions.pop(version, None) is not None
            elif op in ("restore", "undo"):
                if op == "undo":
                    while latest and latest[-1] not in versions:  # deleted since
                        latest.pop()
                    version = latest[-1] if latest else None
                if version in versions:
                    shown, ok, makes = versions[version], True, True
            if makes:
                versions[event] = was
                latest.append(event)
            oks.append(ok)
            showns.append(shown)
        kept = [c for c in batch.schema.names if c != "version"]
        columns = [batch.column(c) for c in kept] + [pa.array(oks, pa.bool_()), pa.array(showns, batch.schema.field("event").type)]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, "ok", "shown"])


def geometry_log(log: DataFrame) -> DataFrame:
    """``log`` with ``shown``, the apply whose geometry the route has after the event (its event number; null: none), and ``ok``, whether the event did anything. Other columns stay.

    ``log``: route_id, event (a number from 0 on that orders a route's events), op, version. What an event replaces is kept as a version under the event's own number: ``apply`` (if the route has a
    geometry), ``backup`` and every restoring event make one. ``restore`` shows the version again, ``undo`` the latest version there is, ``delete_version`` deletes one. An
    event that names no version, one that isn't there yet or was deleted, or that finds none to undo, does nothing; so does a backup of nothing.

    The log is dealt out by route and sorted by event, and each route's events are gone through once, as a stream: a task holds a batch of rows and, of one route at a time, two numbers a
    version that is there. Every event takes the same small work, however long the log is.
    """
    spread = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lying = log.repartition(spread, "route_id").sortWithinPartitions("route_id", "event")
    fields = [f for f in log.schema.fields if f.name != "version"]
    shape = T.StructType([*fields, T.StructField("ok", T.BooleanType()), T.StructField("shown", log.schema["event"].dataType)])
    return lying.mapInArrow(_replayed, shape)


def geometry_as_of(shown: DataFrame, instants: DataFrame) -> DataFrame:
    """``instants`` (route_id, at, ...) with ``shown`` as the last event up to ``at`` leaves it: one sorted union of both, no range join.

    ``shown``: route_id, event, at, shown (``geometry_log`` with each event's time; among equal times the larger event is later). An instant before all events, or of an unknown route, has null. Equal
    instants count each.
    """
    rest = [c for c in instants.columns if c not in ("route_id", "at")]
    kept = F.struct(*rest) if rest else F.struct(F.lit(0).alias("_none"))
    asked = instants.select("route_id", "at", F.lit(1).alias("_k"), F.lit(None).cast("bigint").alias("event"), F.lit(None).cast("struct<shown: bigint>").alias("_s"), kept.alias("_rest"))
    told = shown.select("route_id", "at", F.lit(0).alias("_k"), F.col("event").cast("bigint").alias("event"), F.struct(F.col("shown").cast("bigint").alias("shown")).alias("_s"), F.lit(None).cast(asked.schema["_rest"].dataType).alias("_rest"))
    w = W.partitionBy("route_id").orderBy("at", "_k", "event")
    out = told.unionByName(asked).withColumn("_s", F.last("_s", ignorenulls=True).over(w)).filter("_k = 1")
    return out.select("route_id", "at", *[F.col("_rest")[c].alias(c) for c in rest], F.col("_s.shown").alias("shown"))
