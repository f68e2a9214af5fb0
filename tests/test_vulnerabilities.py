import json
import random

from fleetdrift.operators import graph
from fleetdrift.operators import vulnerabilities as vuln
from fleetdrift.sources import advisories

INSTALLED = "repo string, ecosystem string, name string, version string"


def record(advisory, *affected):
    return (json.dumps({"id": advisory, "affected": [
        {"package": {"name": n, "ecosystem": e}, "ranges": [{"type": t, "events": ev} for t, ev in ranges]} for n, e, ranges in affected
    ]}),)


def fixes(frame, records, installed):
    parsed = advisories.parse_advisories(frame("content string", *records))
    found = vuln.scan(frame(INSTALLED, *[("r", *i) for i in installed]), advisories.advisory_windows(parsed))
    return {(r.name, r.version): r.fixed_in for r in found.collect()}


def test_windows_of_two_packages(frame):
    rec = record(
        "G",
        ("lodash.trimend", "npm", [("SEMVER", [{"introduced": "0"}, {"fixed": "4.5.1"}])]),
        ("lodash", "npm", [("SEMVER", [{"introduced": "4.0.0"}, {"fixed": "4.17.21"}])]),
    )
    got = fixes(frame, [rec], [("npm", "lodash", "4.17.15"), ("npm", "lodash.trimend", "4.5.0"), ("npm", "underscore", "1.0.0"), ("PyPI", "lodash", "4.17.15"), ("npm", "lodash", "3.0.0")])
    assert got == {("lodash", "4.17.15"): "4.17.21", ("lodash.trimend", "4.5.0"): "4.5.1"}


def test_several_windows_and_last_affected(frame):
    rec = record("G", ("thing", "npm", [("SEMVER", [{"introduced": "1.0.0"}, {"fixed": "1.9.0"}, {"introduced": "2.0.0"}, {"fixed": "2.3.0"}])]))
    got = fixes(frame, [rec], [("npm", "thing", v) for v in ("1.4.0", "2.1.0", "1.9.5", "3.0.0")])
    assert got == {("thing", "1.4.0"): "1.9.0", ("thing", "2.1.0"): "2.3.0"}
    last = record("G", ("thing", "npm", [("SEMVER", [{"introduced": "1.0.0"}, {"last_affected": "2.5.0"}])]))
    assert fixes(frame, [last], [("npm", "thing", "1.4.0"), ("npm", "thing", "2.5.1")]) == {("thing", "1.4.0"): None}


def test_commit_ranges_are_left_out_and_open_windows_hold(frame):
    rec = record("G", ("t", "npm", [("GIT", [{"introduced": "0"}]), ("ECOSYSTEM", [{"introduced": "3.0.0"}])]))
    assert fixes(frame, [rec], [("npm", "t", "2.0.0"), ("npm", "t", "3.1.0")]) == {("t", "3.1.0"): None}


def test_reopened_window_voids_the_one_before(frame):
    rec = record("G", ("t", "npm", [("SEMVER", [{"introduced": "1.0.0"}, {"introduced": "2.0.0"}, {"fixed": "2.5.0"}])]))
    assert fixes(frame, [rec], [("npm", "t", "1.5.0"), ("npm", "t", "2.1.0")]) == {("t", "2.1.0"): "2.5.0"}


def test_unreadable_record_is_kept_with_a_status(frame, rows):
    parsed = advisories.parse_advisories(frame("content string", ("not json",), record("G")))
    assert rows(parsed, "status") == [("read",), ("unreadable",)]


def walk(events, v):
    """Brute force: the event list read one by one."""
    opened, held, fix, answered = False, False, None, False
    for e in events:
        if "introduced" in e:
            opened = e["introduced"] == "0" or v >= int(e["introduced"].split(".")[0])
        elif opened and "fixed" in e:
            if v < int(e["fixed"].split(".")[0]):
                held = True
                if not answered:
                    fix, answered = e["fixed"], True
            opened = False
        elif opened and "last_affected" in e:
            if v <= int(e["last_affected"].split(".")[0]):
                held, answered = True, True
            opened = False
    return held or opened, fix


def test_random_event_lists_against_brute_force(frame):
    rnd = random.Random(3)
    records, expected, installed = [], {}, set()
    for k in range(40):
        events = []
        for _ in range(rnd.randrange(1, 7)):
            kind = rnd.choice(["introduced", "introduced", "fixed", "last_affected", "limit"])
            events.append({kind: "0" if kind == "introduced" and rnd.random() < 0.2 else f"{rnd.randrange(1, 12)}.0.0"})
        records.append(record(f"A{k}", (f"n{k}", "npm", [("SEMVER", events)])))
        for v in range(0, 13):
            installed.add(("npm", f"n{k}", f"{v}.0.0"))
            affected, fix = walk(events, v)
            if affected:
                expected[(f"n{k}", f"{v}.0.0")] = fix
    assert fixes(frame, records, sorted(installed)) == expected


EDGE, DIRECT = "repo string, src string, dst string", "repo string, name string"


def test_paths(frame, rows):
    edges = frame(EDGE, ("r", "express", "qs"), ("r", "express", "body-parser"), ("r", "body-parser", "qs"), ("c", "a", "b"), ("c", "b", "a"), ("c", "b", "bad"))
    directs = frame(DIRECT, ("r", "express"), ("r", "lodash"), ("c", "a"))
    targets = frame("repo string, child string", ("r", "qs"), ("r", "lodash"), ("r", "unrelated"), ("c", "bad"))
    got = rows(graph.paths_to(edges, targets, directs), "child", "path")
    assert got == sorted([("qs", ["express", "qs"]), ("lodash", ["lodash"]), ("bad", ["a", "b", "bad"])], key=repr)


def test_plan(frame, rows):
    vulnerable = frame("repo string, name string, target string", ("r", "qs", "2"), ("r", "lodash", "3"), ("r", "x", None), ("r", "far", "1"))
    directs = frame(DIRECT, ("r", "express"), ("r", "lodash"))
    paths = frame("repo string, child string, direct string, path array<string>", ("r", "qs", "express", ["express", "qs"]))
    got = rows(graph.plan_remediation(vulnerable, directs, paths), "name", "kind", "first_parent")
    assert got == sorted([("qs", "parent", "express"), ("lodash", "direct", None), ("x", "none", None), ("far", "none", None)], key=repr)


def test_random_graph_paths_against_search(frame):
    rnd = random.Random(5)
    edges = sorted({(rnd.randrange(14), rnd.randrange(14)) for _ in range(40)})
    name = lambda k: f"n{k:02d}"
    best = {name(0): [name(0)]}
    frontier = [name(0)]
    while frontier:
        found = {}
        for a, b in edges:
            if name(b) in frontier and name(a) not in best and a != b:
                path = [name(a)] + best[name(b)]
                found[name(a)] = min(found.get(name(a), path), path)
        best.update(found)
        frontier = list(found)
    df = graph.ancestor_paths(frame(EDGE, *[("r", name(a), name(b)) for a, b in edges]), frame("repo string, child string", ("r", name(0))))
    assert {r.node: r.path for r in df.collect()} == best


def test_random_routes_of_many_targets_against_search(frame):
    """Chains and forks side by side, cycles, edges named twice, packages that nothing holds."""
    rnd = random.Random(11)
    name = lambda k: f"n{k:02d}"
    edges = [(name(rnd.randrange(24)), name(rnd.randrange(24))) for _ in range(34)]
    edges += edges[:4] + [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("loose", "n03"), ("looser", "loose")]
    targets, directs = [name(k) for k in range(0, 24, 3)] + ["c0"], [name(k) for k in range(0, 24, 2)] + ["c2"]
    best = {}
    for target in targets:
        paths = frontier = {target: [target]}
        while frontier:
            found = {}
            for a, b in edges:
                if b in frontier and a not in paths:
                    found[a] = min(found.get(a, [a, *frontier[b]]), [a, *frontier[b]])
            paths, frontier = {**paths, **found}, found
        best.update({(target, d): paths[d] for d in directs if d in paths})
    assert len(best) > 30
    got = graph.paths_to(
        frame(EDGE, *[("r", a, b) for a, b in edges]), frame("repo string, child string", *[("r", x) for x in targets]), frame(DIRECT, *[("r", x) for x in directs])
    ).collect()
    assert {(r.child, r.direct): r.path for r in got} == best and len(got) == len(best)


def test_levels_of_single_dependencies_are_not_compared_and_loose_edges_not_walked(frame, rows, monkeypatch):
    read = []
    whole = graph.Rounds.all
    monkeypatch.setattr(graph.Rounds, "all", lambda levels: read.append(levels) or whole(levels))
    edges = frame(EDGE, ("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "loose", "b"), ("r", "a", "b"))
    got = rows(graph.paths_to(edges, frame("repo string, child string", ("r", "c"), ("r", "a")), frame(DIRECT, ("r", "a"))), "child", "path")
    assert got == [("a", ["a"]), ("c", ["a", "b", "c"])]
    assert len(read) == 1
    assert {r.node for r in whole(read[0]).collect()} == {"a", "b", "c"}
