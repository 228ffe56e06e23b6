"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import wayloom.plans.access
import wayloom.plans.audit
import wayloom.plans.basics
import wayloom.plans.context
import wayloom.plans.decisions
import wayloom.plans.drafts
import wayloom.plans.edits
import wayloom.plans.itineraries
import wayloom.plans.journeys
import wayloom.plans.legs
import wayloom.plans.lines
import wayloom.plans.live
import wayloom.plans.matching
import wayloom.plans.metrics
import wayloom.plans.network
import wayloom.plans.ranking
import wayloom.plans.summaries  # noqa: F401  each module registers its queries
from wayloom.plans.registry import QUERIES, SQL

from .oracle import difference


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        assert difference(df, SQL[name], small) == ""
    else:
        assert df.count() > 0
