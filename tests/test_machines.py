"""State machines as streams of files, stopped and restarted from their checkpoint, against the same rows of tables."""

from __future__ import annotations

import json
import os
import random
from collections import Counter

import pytest

from wayloom.operators import alerts as al
from wayloom.streaming import machines as ma

EVENTS = "trace_id string, at timestamp, seq bigint, kind string, lat double, lng double"
ETAS = "route_id bigint, at timestamp, seq bigint, eta int"


@pytest.fixture()
def stateful(spark):
    names = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _moment(second: int) -> str:
    return f"2024-05-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"


def _run(spark, tmp_path, parts: list[list[dict]], shape: str, through) -> Counter:
    """Each part is a file; half of them are there at first, and a new query goes on with the rest."""
    (tmp_path / "in").mkdir()
    half = len(parts) // 2
    for some in (range(half), range(half, len(parts))):
        for k in some:
            file = tmp_path / "in" / f"{k:03d}.json"
            file.write_text("\n".join(map(json.dumps, parts[k])))
            os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read by age
        read = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = ma.append_to(through(read), str(tmp_path / "out"), str(tmp_path / "mark"))
        assert query.awaitTermination(240)
    out = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    return Counter(map(tuple, out.collect()))


def _shuffled(rng, events: list[dict], per: int) -> list[list[dict]]:
    """Events that come up to a minute late, some twice."""
    order = sorted(events + [e for e in events if rng.random() < 0.2], key=lambda e: e["_s"] + rng.randint(0, 60))
    return [[{k: v for k, v in e.items() if k != "_s"} for e in order[i : i + per]] for i in range(0, len(order), per)]


def test_traces(stateful, tmp_path):
    rng, events = random.Random(3), []
    for t in "abcdef":
        for s in range(rng.randint(5, 25)):
            kind = rng.choice(["point", "point", "point", "pause", "resume", "finish", "finish", "sync", "sync", "start", "other"]) if s > 1 else rng.choice(["start", "point"]) if s == 0 else "start"
            place = s * 20 + rng.randint(0, 9)
            events.append({"trace_id": t, "at": _moment(place), "seq": s, "kind": kind, "lat": 9.8 + s / 100 if rng.random() < 0.9 else None, "lng": -83.9, "_s": place})
    late = {"trace_id": "a", "at": _moment(1), "seq": 99, "kind": "finish", "lat": None, "lng": None}  # after the watermark: dropped
    end = [[{"trace_id": "z", "at": _moment(8000), "seq": 1, "kind": "point", "lat": 1.0, "lng": 1.0}, {"trace_id": None, "at": _moment(5), "seq": 1, "kind": "start"}], [late]]
    got = _run(stateful, tmp_path, _shuffled(rng, events, 12) + end, EVENTS, lambda read: ma.traces(read, "2 minutes"))
    table = stateful.read.schema(EVENTS).json(stateful.sparkContext.parallelize([json.dumps(e) for e in events + events[:5]]))
    want = Counter(map(tuple, ma.trace_table(table).collect()))
    assert got == want and {x[5] for x in want} >= {"recording", "paused", "synced"} and sum(x[1] == "point" for x in want) > 10
    assert ma.trace_table(table.limit(0)).count() == 0


def test_alerts(stateful, tmp_path):
    rng, events = random.Random(6), []
    for route in (1, 2, 3):
        for s in range(60):
            events.append({"route_id": route, "at": _moment(s * 15), "seq": s, "eta": rng.choice([None, *range(0, 18), *range(0, 6)]), "_s": s * 15})
    table = stateful.createDataFrame([(10, 1, [10, 5, 2]), (11, 1, [8, None, 3, 3]), (12, 2, [1, 12, 6]), (13, 3, []), (14, 3, [4]), (15, 9, [4])], "alert_id bigint, route_id bigint, thresholds array<int>")
    end = [[{"route_id": 1, "at": _moment(9000), "seq": 999, "eta": None}]]
    got = _run(stateful, tmp_path, _shuffled(rng, events, 30) + end, ETAS, lambda read: ma.alerts(read, table, "2 minutes"))
    etas = stateful.createDataFrame([(e["route_id"], e["seq"], e["eta"]) for e in events], "route_id bigint, tick bigint, eta int")
    want = Counter((r.alert_id, r.tick, r.threshold, r.eta) for r in al.threshold_alerts(etas, table).collect())
    assert got == want and len(want) > 10
