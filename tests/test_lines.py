"""Every pattern's line."""

from __future__ import annotations

from wayloom.plans import network
from wayloom.plans.registry import QUERIES


def test_every_line(spark, small):
    got = QUERIES["densify"](spark, small)
    segments = network._segments(spark, small)
    assert got.count() == 4 * segments.count()
    assert got.select("pattern_id").distinct().count() == segments.select("pattern_id").distinct().count() == QUERIES["densify"](spark, small).select("pattern_id").distinct().count()
