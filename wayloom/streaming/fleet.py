"""The live state as a stream: positions in, the last one of every driver out, silent drivers forgotten."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.live import EXPIRE_S, cleaned

POSITION = "arrival bigint, driver_id string, ts string, lat double, lng double, status string, speed double, route string"
_STATE = "arrival bigint, last timestamp, lat double, lng double, route string, status string"
_OUT = "driver_id string, arrival bigint, last timestamp, lat double, lng double, route string, status string, event string"


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the JSON files that appear under ``path``."""
    return spark.readStream.schema(POSITION).json(path)


def tracked(positions: DataFrame, expire_s: int = EXPIRE_S) -> DataFrame:
    """A row (event ``update``) for each driver that a batch has messages of: the one that came last. A driver silent for ``expire_s`` seconds gets a row ``expired``, and its state goes.

    State is one message a driver, and ends with the timeout, so it is bounded by the drivers on the road.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["arrival", "last", "lat", "lng", "route", "status"]
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield pd.DataFrame([(key[0], *held, "expired")], columns=["driver_id", *names, "event"])
            return
        best = state.get if state.exists else None
        for frame in frames:
            row = frame.loc[frame["arrival"].idxmax()]
            if best is None or row["arrival"] > best[0]:
                best = (int(row["arrival"]), *(row[c] for c in names[1:]))
        state.update(best)
        state.setTimeoutDuration(expire_s * 1000)
        yield pd.DataFrame([(key[0], *best, "update")], columns=["driver_id", *names, "event"])

    return cleaned(positions).groupBy("driver_id").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def write_updates(tracked_rows: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends the updates of every batch as Parquet; the checkpoint lets it go on after a failure."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that is done again replaces itself

    return tracked_rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
