"""State machines over event streams: traces that are recorded, paused and finished, and alerts at thresholds, each as a table and as a stream with the same rows.

The stream holds a key's events back until the watermark has passed them, and hands them on in the order of their time and number; so events may come late, in any order and
twice. What is later than the watermark allows is dropped. State is a key's machine and the events of the last ``delay``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.alerts import RESET_OVER_MIN

#: (state or None, event) to (state, rows); events and states are plain values.
Step = Callable[[dict | None, dict], tuple[dict | None, list[tuple]]]
LEAST_POINTS = 2


class _InOrder(StatefulProcessor):
    """Runs a step for each event of a key, in order, once the watermark is past it."""

    def __init__(self, step: Step, columns: list[str]):
        self.step, self.columns = step, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", T.StructType([T.StructField("at", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("data", T.StringType())]))
        self.machine = handle.getValueState("machine", T.StructType([T.StructField("data", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = {(x[0], x[1]) for x in self.pending.get()} if self.pending.exists() else set()
        for frame in rows:
            for at, seq, data in zip(frame["at_ms"], frame["seq"], frame["data"]):
                at, seq = int(at), int(seq)
                if at > passed and (at, seq) not in held:
                    held.add((at, seq))
                    self.pending.appendValue((at, seq, data))
                    self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        every = sorted(tuple(x) for x in self.pending.get()) if self.pending.exists() else []
        due, rest = [x for x in every if x[0] <= passed], [x for x in every if x[0] > passed]
        state = json.loads(self.machine.get()[0]) if self.machine.exists() else None
        out = []
        for _, _, data in due:
            state, rows = self.step(state, json.loads(data))
            out += [(*key, *r) for r in rows]
        if due:
            self.pending.put(rest) if rest else self.pending.clear()
            self.machine.update((json.dumps(state),)) if state is not None else self.machine.clear()
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, step: Step, shape: str, delay: str = "10 minutes") -> DataFrame:
    """``events`` (``key``, at: a timestamp, seq, ...) through a machine a key, as a stream; ``shape``: the key and what the step's rows hold. Events without a key, time or number are left out."""
    rest = [c for c in events.columns if c not in (key, "at", "seq")]
    ready = events.filter(F.col(key).isNotNull() & F.col("at").isNotNull() & F.col("seq").isNotNull()).withWatermark("at", delay)
    ready = ready.select(key, "at", F.unix_millis("at").alias("at_ms"), F.col("seq").cast("bigint").alias("seq"), F.to_json(F.struct(*rest)).alias("data"))
    columns = [f.split()[0] for f in shape.split(", ")]
    return ready.groupBy(key).transformWithStateInPandas(_InOrder(step, columns), T._parse_datatype_string(shape), "Append", "EventTime")


TRACE = "trace_id string, event string, point_order int, lat double, lng double, status string"


def trace_step(state: dict | None, e: dict) -> tuple[dict | None, list[tuple]]:
    """One event of a trace: ``start``, ``point``, ``pause``, ``resume``, ``finish``, ``sync``. Before its start nothing counts, and a second start doesn't.

    A point gets the next number and sets a paused trace recording again; one without a position is none. ``finish`` asks for two points, and so does ``sync``, which does nothing to a trace that is being recorded or paused.
    """
    kind = e.get("kind")
    if state is None:
        return ({"status": "recording", "n": 0}, [("status", None, None, None, "recording")]) if kind == "start" else (None, [])
    rows, status, n = [], state["status"], state["n"]
    if kind == "point" and e.get("lat") is not None and e.get("lng") is not None:
        rows.append(("point", n, e["lat"], e["lng"], None))
        status, n = "recording", n + 1
    elif kind == "pause":
        status = "paused"
    elif kind == "resume":
        status = "recording"
    elif kind == "finish":
        status = "pending_sync" if n >= LEAST_POINTS else "sync_error"
    elif kind == "sync" and status not in ("recording", "paused"):
        status = "synced" if n >= LEAST_POINTS else "sync_error"
    if status != state["status"]:
        rows.append(("status", None, None, None, status))
    return {"status": status, "n": n}, rows


def traces(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of ``events`` (trace_id, at, seq, kind, lat, lng) as the points of traces in order, and each change of a trace's status."""
    return in_order(events.select("trace_id", "at", "seq", "kind", "lat", "lng"), "trace_id", trace_step, TRACE, delay)


def trace_table(events: DataFrame) -> DataFrame:
    """The same rows of a table of events, by windows. Of rows with one time and number the first by kind and position counts."""
    one = events.filter("trace_id IS NOT NULL AND at IS NOT NULL AND seq IS NOT NULL").groupBy("trace_id", "at", "seq").agg(F.min(F.struct("kind", "lat", "lng")).alias("x")).select("trace_id", "at", "seq", "x.*")
    w = W.partitionBy("trace_id").orderBy("at", "seq")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    own = one.withColumn("_on", F.max(F.col("kind") == "start").over(upto)).filter("_on")
    own = own.withColumn("_first", F.row_number().over(w) == 1).filter("_first OR kind <> 'start'")
    point = (F.col("kind") == "point") & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    own = own.withColumn("_point", point).withColumn("_n", F.sum(F.col("_point").cast("int")).over(upto))
    # what an event other than sync sets; a sync looks at the last of these
    set_to = F.when(F.col("_point") | F.col("kind").isin("start", "resume"), "recording").when(F.col("kind") == "pause", "paused").when(F.col("kind") == "finish", "done")
    own = own.withColumn("_set", F.last(set_to, ignorenulls=True).over(upto))
    # of an ended trace: how many points it had, whether it was synced since
    run = own.withColumn("_end", F.sum(set_to.isNotNull().cast("int")).over(upto))
    run = run.withColumn("_synced", F.max(F.col("kind") == "sync").over(W.partitionBy("trace_id", "_end").orderBy("at", "seq").rowsBetween(W.unboundedPreceding, 0)))
    enough = F.col("_n") >= LEAST_POINTS
    status = F.when(F.col("_set") != "done", F.col("_set")).when(~enough, "sync_error").when(F.col("_synced"), "synced").otherwise("pending_sync")
    run = run.withColumn("status", status).withColumn("_was", F.lag("status").over(w))
    points = run.filter("_point").select("trace_id", F.lit("point").alias("event"), (F.col("_n") - 1).cast("int").alias("point_order"), "lat", "lng", F.lit(None).cast("string").alias("status"))
    none = F.lit(None).cast("double")
    turns = run.filter("_was IS NULL OR status <> _was").select("trace_id", F.lit("status").alias("event"), F.lit(None).cast("int").alias("point_order"), none.alias("lat"), none.alias("lng"), "status")
    return points.unionByName(turns)


ALERT = "alert_id bigint, seq bigint, threshold int, eta int"


def alert_step(state: dict | None, e: dict) -> tuple[dict | None, list[tuple]]:
    """One expected arrival for one alert: fires the largest threshold that it falls to and that hasn't fired since the arrival was last more than four minutes over all of them."""
    eta, limits = e.get("eta"), sorted({x for x in e.get("thresholds") or [] if x is not None}, reverse=True)
    if eta is None or not limits:
        return state, []
    prev, fired = (state or {}).get("prev"), (state or {}).get("fired", [])
    if eta > limits[0] + RESET_OVER_MIN:
        fired = []
    fell = [t for t in limits if t not in fired and eta <= t and (prev is None or prev > t)]
    return {"prev": eta, "fired": fired + fell[:1]}, [(e["tick"], fell[0], eta)] if fell else []


def alerts(etas: DataFrame, table: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of ``etas`` (route_id, at, seq, eta) as the alerts that fire, for a static ``table`` (alert_id, route_id, thresholds); rows as ``operators.alerts.threshold_alerts`` gives them."""
    both = etas.join(table, "route_id").select("alert_id", "at", "seq", F.col("seq").alias("tick"), "eta", "thresholds")
    return in_order(both, "alert_id", alert_step, ALERT, delay)


def append_to(rows: DataFrame, path: str, checkpoint: str):
    """Starts a query over all that is there, a file a batch, and ends; its checkpoint lets the next one go on from there."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that is done again replaces itself

    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
