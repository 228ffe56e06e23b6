"""Nearest ranks against sorted lists."""

from __future__ import annotations

import math
import random

from wayloom.operators.windows import nearest_ranks


def test_against_sorted_lists(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([None, *range(40)])) for _ in range(2000)] + [(k, rng.randint(0, 9)) for k in "abc" for _ in range(rng.randint(1, 30))] + [(None, 5), (None, 7), ("none", None)]
    shares = {"p50": 0.5, "p95": 0.95, "least": 0.0, "top": 1.0}
    got = {r.k: tuple(r)[1:] for r in nearest_ranks(spark.createDataFrame(rows, "k string, v int").repartition(7), "k", "v", shares).collect()}
    want = {}
    for key in {k for k, v in rows if v is not None}:
        own = sorted(v for k, v in rows if k == key and v is not None)
        want[key] = tuple(own[max(1, math.ceil(s * len(own))) - 1] for s in shares.values())
    assert got == want
    assert nearest_ranks(spark.createDataFrame([], "k string, v int"), "k", "v", shares).count() == 0
