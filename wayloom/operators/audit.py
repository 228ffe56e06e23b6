"""Audits: what one table has and another lacks, and whether winners are the expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, labels


def stop_audit(listed: DataFrame, patterns: DataFrame, pattern_stops: DataFrame, stops: DataFrame) -> DataFrame:
    """route_id, direction, stop_id, listed_order, pattern_seq, pattern_ids, visible, issues: every stop of a route's list or of its active patterns.

    ``listed``: route_id, direction, stop_id, ord. ``patterns``: pattern_id, route_id, direction, active (null counts as active).
    """
    keys = ["route_id", "direction", "stop_id"]
    a = listed.groupBy(*keys).agg(F.min("ord").alias("listed_order"))
    live = patterns.filter(F.coalesce("active", F.lit(True))).select("pattern_id", "route_id", "direction")
    z = pattern_stops.join(live, "pattern_id").groupBy(*keys).agg(F.min("seq").alias("pattern_seq"), F.array_sort(F.collect_set("pattern_id")).alias("pattern_ids"))
    rows = a.join(z, keys, "full").join(stops.select("stop_id", F.trim(F.coalesce("name", F.lit(""))).alias("_name"), F.lit(True).alias("_known")), "stop_id", "left")
    issues = labels(
        (F.col("_known").isNull(), "unknown_stop"), (F.col("_known").isNotNull() & (F.col("_name") == ""), "no_name"), (F.col("listed_order").isNull(), "not_listed"), (F.col("pattern_seq").isNull(), "in_no_pattern")
    )
    return rows.select(*keys, "listed_order", "pattern_seq", F.coalesce("pattern_ids", F.array().cast("array<bigint>")).alias("pattern_ids"), F.col("pattern_seq").isNotNull().alias("visible"), issues.alias("issues"))


def stop_audit_summary(audit: DataFrame, listed: DataFrame) -> DataFrame:
    """Counts a route and direction, with how many places of the list are taken twice."""
    has = lambda x: F.count_if(F.array_contains("issues", x))
    twice = listed.groupBy("route_id", "direction", "ord").agg(F.count("*").alias("n")).filter("n > 1").groupBy("route_id", "direction").agg(F.count("*").alias("twice"))
    out = audit.groupBy("route_id", "direction").agg(
        F.count("listed_order").alias("listed"), F.count("pattern_seq").alias("in_patterns"), has("in_no_pattern").alias("in_no_pattern"), has("not_listed").alias("not_listed"), has("no_name").alias("no_name")
    )
    return out.join(twice, ["route_id", "direction"], "left").withColumns({"twice": F.coalesce("twice", F.lit(0)), "visible": (F.col("in_no_pattern") == 0) & (F.col("in_patterns") > 0)})


def coverage(official: DataFrame, current: DataFrame) -> DataFrame:
    """code, variants (of the official table, joined), n_current, status: covered, missing or extra."""
    a = official.groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("variant")), ",").alias("variants"))
    z = current.groupBy("code").agg(F.count("*").alias("n_current"))
    status = F.when(F.col("variants").isNull(), "extra").when(F.col("n_current").isNull(), "missing").otherwise("covered")
    return a.join(z, "code", "full").select("code", "variants", F.coalesce("n_current", F.lit(0)).alias("n_current"), status.alias("status"))


def matches(title: Column, rule: Column) -> Column:
    """One of both, folded, is part of the other; empty text matches nothing."""
    t, r = folded(title), folded(rule)
    return (t != "") & (r != "") & (F.contains(t, r) | F.contains(r, t))


def first_match(title: Column, rules: str) -> Column:
    return F.get(F.filter(F.coalesce(rules, F.array().cast("array<string>")), lambda r: matches(title, r)), F.lit(0))


def judged(cases: DataFrame) -> DataFrame:
    """``cases`` with status (empty, forbidden, pass, acceptable, unexpected) and matching_rule.

    A case: title, board, final of the winner (null without one) and lists of rules: never, never_board, never_final, expected, expected_board,
    expected_final, acceptable. What must never win comes first, then what is expected, at the stops expected, then what will do.
    """
    t, b, f = F.col("title"), F.col("board"), F.col("final")
    bad = F.coalesce(first_match(t, "never"), F.concat(F.lit("board: "), first_match(b, "never_board")), F.concat(F.lit("final: "), first_match(f, "never_final")))
    good, fair = first_match(t, "expected"), first_match(t, "acceptable")
    missed = lambda rules, at: (F.coalesce(F.size(rules), F.lit(0)) > 0) & first_match(at, rules).isNull()
    off = missed("expected_board", b) | missed("expected_final", f)
    empty = F.coalesce(F.trim(t), F.lit("")) == ""
    status = F.when(empty, "empty").when(bad.isNotNull(), "forbidden").when(good.isNotNull() & ~off, "pass").when(good.isNotNull(), "unexpected").when(fair.isNotNull(), "acceptable").otherwise("unexpected")
    rule = F.when(empty, F.lit(None)).when(bad.isNotNull(), bad).when(good.isNotNull() & ~off, good).when(good.isNull(), fair)
    return cases.withColumns({"status": status, "matching_rule": rule})
