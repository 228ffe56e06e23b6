"""Logs of edits, held against replays in Python."""

from __future__ import annotations

import random

from wayloom.operators import drafts as dr

STOPS = "stop_id bigint, lat double, lng double, name string, active boolean, source string"
ROWS = "route_id bigint, direction string, ord int, stop_id bigint, board boolean, alight boolean"
DRAFTS = "draft_id bigint, action string, stop_id bigint, route_id bigint, direction string, target_order int, lat double, lng double, name string, board boolean, alight boolean, undone boolean"


def _replay(rows: list, drafts: list) -> set:
    state = [list(r) for r in rows]
    for d in sorted(drafts, key=lambda d: d.draft_id):
        if d.status != "applied" or d.route_id is None:
            continue
        of = [r for r in state if r[0] == d.route_id]
        if d.action in ("create_stop", "attach_stop_to_route"):
            way = d.direction or "ida"
            ways = sorted({r[1] for r in of if r[1] in dr.WAYS}) or ["ambos"] if way == "ambos" else [way]
            at = max(0, d.target_order or 0)
            for w in ways:
                for r in of:
                    if r[1] == w and r[2] >= at:
                        r[2] += 1
                state.append([d.route_id, w, at, d.stop_id, d.board is not False, d.alight is not False])
        elif d.action == "detach_stop_from_route":
            way = d.direction or "ambos"
            for w in sorted({r[1] for r in of if r[3] == d.stop_id}) if way == "ambos" else [way]:
                for at in sorted((r[2] for r in of if r[1] == w and r[3] == d.stop_id), reverse=True):
                    state.remove(next(r for r in state if r[0] == d.route_id and r[1] == w and r[3] == d.stop_id and r[2] == at))
                    for r in state:
                        if r[0] == d.route_id and r[1] == w and r[2] > at:
                            r[2] -= 1
    return sorted(map(tuple, state))


def _apply(spark, rows, drafts, stops=((1, 9.0, -84.0, "a", True, "osm"), (2, 9.1, -84.1, "b", None, "gtfs"), (3, 9.2, -84.2, None, True, "osm"))):
    s, r = spark.createDataFrame(list(stops), STOPS), spark.createDataFrame(rows, ROWS)
    checked = dr.checked_drafts(spark.createDataFrame(drafts, DRAFTS), s)
    return checked, dr.drafted_stops(s, checked), dr.drafted_routes(r, checked), r


def _draft(k, action, stop=None, route=None, way=None, at=None, lat=None, lng=None, name=None, board=None, undone=None):
    return (k, action, stop, route, way, at, lat, lng, name, board, None, undone)


def test_two_drafts_at_one_place_a_detach_after_an_attach_and_an_undone_draft(spark):
    base = [(7, "ida", 0, 1, True, True), (7, "ida", 1, 2, True, True), (7, "vuelta", 0, 2, True, True), (8, "ida", 0, 3, True, True)]
    log = [
        _draft(1, "attach_stop_to_route", 3, 7, "ida", 1), _draft(2, "attach_stop_to_route", 1, 7, "ida", 1, board=False), _draft(3, "detach_stop_from_route", 3, 7), _draft(4, "attach_stop_to_route", 3, 7, "ambos", 0),
        _draft(5, "detach_stop_from_route", 2, 7, "ida", undone=True), _draft(6, "create_stop", route=7, way="vuelta", at=9, lat=1.0, lng=2.0), _draft(7, "detach_stop_from_route", 99, 7), _draft(8, "attach_stop_to_route", 1),
        _draft(9, "create_stop", lat=None, lng=1.0), _draft(10, "explode", 1), _draft(11, "attach_stop_to_route", 1, 9, "ambos", 3),
    ]
    checked, _, routes, _ = _apply(spark, base, log)
    by = {d.draft_id: d for d in checked.collect()}
    assert [by[k].status for k in range(1, 12)] == ["applied"] * 4 + ["undone", "applied"] + ["rejected"] * 4 + ["applied"]
    assert by[6].stop_id == 4
    got = sorted(map(tuple, routes.collect()))
    assert got == _replay(base, list(by.values()))
    assert [r[2:5] for r in got if r[:2] == (7, "ida")] == [(0, 3, True), (1, 1, True), (2, 1, False), (3, 2, True)]
    assert [r for r in got if r[0] == 9] == [(9, "ambos", 3, 1, True, True)]


def test_random_logs(spark):
    rng = random.Random(5)
    base = [(r, w, k, rng.randint(1, 3), True, True) for r in range(12) for w in ("ida", "vuelta") if rng.random() < 0.8 for k in range(rng.randint(1, 5))]
    log = [_draft(k, rng.choice(dr.ACTIONS), rng.choice([1, 2, 3, 3, None]), rng.choice([*range(13), None]), rng.choice(["ida", "vuelta", "loop", "ambos", None, ""]), rng.choice([None, -2, 0, 1, 2, 7]), 1.0, rng.choice([2.0, None]), rng.choice(["x", " ", None]), rng.choice([True, False, None]), rng.choice([None, False, True])) for k in range(300)]
    checked, _, routes, before = _apply(spark, base, log)
    known = checked.collect()
    got = sorted(map(tuple, routes.collect()))
    assert got == _replay(base, known)
    # only what changed is rebuilt
    pattern = lambda rows: {k: [r[3:] for r in sorted(x)] for k, x in {(r[0], r[1]): [y for y in rows if y[:2] == r[:2]] for r in rows}.items()}
    old, new = pattern(base), pattern(got)
    want = {(*k, i + 1, *x) for k, v in new.items() if old.get(k) != v for i, x in enumerate(v)}
    assert {tuple(r) for r in dr.changed_patterns(before, routes).collect()} == want and len(want) < len(got)


def test_stops_take_each_column_from_the_last_draft_that_sets_it(spark):
    log = [_draft(1, "rename_stop", 1, name=" new "), _draft(2, "move_stop", 1, lat=5.0, lng=6.0), _draft(3, "move_stop", 1, lat=7.0, lng=8.0, undone=True), _draft(4, "deactivate_stop", 2), _draft(5, "rename_stop", 3, name="  "), _draft(6, "create_stop", lat=1.0, lng=1.0)]
    _, stops, _, _ = _apply(spark, [], log)
    assert sorted(map(tuple, stops.collect())) == [(1, 5.0, 6.0, "new", True, "manual"), (2, 9.1, -84.1, "b", False, "gtfs"), (3, 9.2, -84.2, None, True, "osm"), (4, 1.0, 1.0, None, True, "manual")]


def test_empty_tables(spark):
    checked, stops, routes, before = _apply(spark, [], [], stops=())
    assert checked.count() == stops.count() == routes.count() == dr.changed_patterns(before, routes).count() == 0
    log = spark.createDataFrame([], "route_id bigint, event bigint, op string, version bigint")
    assert dr.geometry_log(log).count() == 0


def _walk(log: list) -> dict:
    """Each route's events in order on a plain state: what is shown, and the versions there are."""
    out, state = {}, {}
    for route, event, op, version in sorted(log):
        shown, versions = state.setdefault(route, [None, {}])
        ok, target = False, None
        if op == "apply":
            ok, new = True, event
            if shown is not None:
                versions[event] = shown
            state[route][0] = new
        elif op == "backup" and shown is not None:
            ok, versions[event] = True, shown
        elif op == "delete_version" and version in versions and version < event:
            ok = True
            del versions[version]
        elif op in ("restore", "undo"):
            target = version if op == "restore" else max(versions, default=None)
            if target in versions:
                ok, state[route][0] = True, versions[target]
                versions[event] = shown
        out[route, event] = (ok, state[route][0])
    return out


def test_versions(spark):
    rng = random.Random(11)
    fixed = [(1, 1, "undo", None), (1, 2, "backup", None), (1, 3, "apply", None), (1, 4, "apply", None), (1, 5, "undo", None), (1, 6, "undo", None), (1, 7, "delete_version", 6), (1, 8, "undo", None), (1, 9, "restore", 6), (1, 10, "restore", 4), (1, 11, "restore", None)]
    log = fixed + [(r, e, rng.choice(["apply", "undo", "undo", "restore", "delete_version", "delete_version", "backup"] if e > 2 else ["undo", "apply"]), rng.choice([None, *range(1, e + 2)])) for r in range(2, 40) for e in range(1, 30)]
    log += [(99, 1, "apply", None), (99, 2, "apply", None), (99, 3, "delete_version", 2), *((99, e, "undo", None) for e in range(4, 9)), (99, 9, "backup", None), (99, 10, "undo", None)]
    got = {(r.route_id, r.event): (r.ok, r.shown) for r in dr.geometry_log(spark.createDataFrame(log, "route_id bigint, event bigint, op string, version bigint").repartition(4)).collect()}
    assert got == _walk(log)
    assert [got[1, e][1] for e in range(1, 9)] == [None, None, 3, 4, 3, 4, 4, 4]  # an undo of an undo is back at 4


def test_long_log_in_one_pass(spark):
    """Versions that all will be deleted, and restoring events that find nothing: the log moves once, and no event meets another's rows."""
    log = [(1, 0, "apply", None)]
    for e in range(1, 3000, 3):
        log += [(1, e, "apply", None), (1, e + 1, "delete_version", e), (1, e + 2, "undo", None)]
    rows = dr.geometry_log(spark.createDataFrame(log, "route_id bigint, event bigint, op string, version bigint").repartition(4))
    got = {(r.route_id, r.event): (r.ok, r.shown) for r in rows.collect()}
    assert got == _walk(log)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_as_of(spark):
    shown = spark.createDataFrame([(1, 1, 10, 1), (1, 2, 20, None), (1, 3, 20, 3), (2, 1, 5, 1)], "route_id bigint, event bigint, at int, shown bigint")
    asked = spark.createDataFrame([(1, 9, "a"), (1, 10, "b"), (1, 19, "c"), (1, 20, "d"), (1, 99, "e"), (1, 99, "e"), (3, 1, "f")], "route_id bigint, at int, tag string")
    got = sorted((r.tag, r.shown) for r in dr.geometry_as_of(shown, asked).collect())
    assert got == [("a", None), ("b", 1), ("c", 1), ("d", 3), ("e", 3), ("e", 3), ("f", None)]
