import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetdrift import skew
from fleetdrift.operators import lifecycle, reporting, scoring
from fleetdrift.operators.asof import as_of
from fleetdrift.session import work_path
from fleetdrift.streaming import scans as scan_stream
from fleetdrift.streaming import webhooks

FOUND, SCAN = "repo string, scan string, finding string", "repo string, scan string"


def replay(history):
    """Brute force: one scan after the other."""
    state, events = {}, []
    for n, (scan, found) in enumerate(history):
        for f in found:
            if n and f not in state:
                events.append((f, scan, "added"))
            if state.get(f, [0, 0, ""])[2] == "fixed":
                events.append((f, scan, "returned"))
            first = state[f][0] if f in state else scan
            state[f] = [first, scan, "open"]
        for f, s in state.items():
            if f not in found and s[2] == "open":
                state[f] = [s[0], scan, "fixed"]
                events.append((f, scan, "resolved"))
    return {f: tuple(s) for f, s in state.items()}, sorted(events)


@pytest.fixture
def history():
    rnd = random.Random(4)
    return [(f"s{n:02d}", {f for f in "abcdefg" if rnd.random() < 0.5} if n != 5 else set()) for n in range(12)]


def tables(frame, history):
    found = [("r", scan, f) for scan, fs in history for f in sorted(fs)]
    return frame(FOUND, *found), frame(SCAN, *[("r", scan) for scan, _ in history])


def test_states_and_deltas_against_replay(frame, history):
    found, scans = tables(frame, history)
    state, events = replay(history)
    assert {r.finding: (r.first_seen, r.last_seen, r.status) for r in lifecycle.finding_states(found, scans).collect()} == state
    assert sorted((r.finding, r.scan, r.event) for r in lifecycle.scan_deltas(found, scans).collect()) == events


def test_stream_equals_batch(spark, frame, history):
    source = work_path(spark, "scans")
    for scan, fs in history:
        rows = [("r", scan, f) for f in sorted(fs)] or [("r", scan, None)]
        frame(FOUND, *rows).coalesce(1).write.mode("append").parquet(source)
    run = scan_stream.ScanStream(spark, work_path(spark, "run")).run(scan_stream.read_scans(spark, source, 3))
    state, events = replay(history)
    assert {r.finding: (r.first_seen, r.last_seen, r.status) for r in run.state.read("findings", run.last).collect()} == state
    assert sorted((r.finding, r.scan, r.event) for r in run.state.log("deltas").collect()) == events


def test_batch_run_twice_counts_once(spark, frame, history):
    source = work_path(spark, "scans")
    rows = [("r", scan, f) for scan, fs in history for f in sorted(fs)]
    batch = frame(FOUND, *rows)
    stream = scan_stream.ScanStream(spark, work_path(spark, "run"))
    stream.handle(batch, 0)
    once = sorted(map(tuple, stream.state.read("findings", 0).collect()))
    stream.handle(batch, 0)
    assert sorted(map(tuple, stream.state.read("findings", 0).collect())) == once
    assert source


def test_restart_without_input_keeps_the_state(spark, frame):
    source, root = work_path(spark, "scans"), work_path(spark, "run")
    for scan in ("2024-01-01", "2024-01-02", "2024-01-03"):
        frame(FOUND, ("r", scan, "f" + scan)).coalesce(1).write.mode("append").parquet(source)
        run = scan_stream.ScanStream(spark, root).run(scan_stream.read_scans(spark, source))
    again = scan_stream.ScanStream(spark, root).run(scan_stream.read_scans(spark, source))
    assert again.last == run.last == 2
    assert again.state.read("findings", again.last).count() == 3
    assert again.state._versions("findings") == [1, 2]  # older ones are gone


def test_dismissed_findings_are_no_news_in_the_stream(frame, rows):
    stored = frame(scan_stream.STATE["findings"], ("r", "d", "1", "1", "dismissed"), ("r", "o", "1", "1", "open"))
    known, scans = frame(SCAN, ("r", "1")), frame(SCAN, ("r", "2"))
    found = frame(FOUND, ("r", "2", "d"), ("r", "2", "o"), ("r", "2", "n"))
    assert rows(scan_stream.batch_deltas(stored, known, scans, found), "finding", "event") == [("n", "added")]


def test_dismissed_stays_dismissed(frame, rows):
    stored = frame("repo string, finding string, first_seen string, last_seen string, status string", ("r", "d", "1", "1", "dismissed"), ("r", "f", "1", "1", "fixed"), ("r", "o", "1", "1", "open"), ("q", "x", "1", "1", "open"))
    scanned, found = frame(SCAN, ("r", "2")), frame("repo string, finding string", ("r", "d"), ("r", "f"), ("r", "n"))
    got = rows(lifecycle.upsert_findings(stored, scanned, found))
    assert got == [("q", "x", "1", "1", "open"), ("r", "d", "1", "2", "dismissed"), ("r", "f", "1", "2", "open"), ("r", "n", "2", "2", "open"), ("r", "o", "1", "2", "fixed")]
    delta = lifecycle.round_delta(stored, scanned, found, frame("repo string", ("r",)))
    assert rows(delta, "finding", "event") == [("f", "returned"), ("n", "added"), ("o", "resolved")]
    assert rows(lifecycle.round_delta(stored.limit(0), scanned, found, frame("repo string", ("q",)))) == []


def test_prune_refuses_an_empty_criterion(frame):
    with pytest.raises(ValueError):
        reporting.prune_artifacts(frame("pkg string, last_used int", ("a", 1)))


CASE = "case_id string, minimal_edits int"
OUTCOME = """case_id string, model string, harness string, verdict string, inconclusive string, edits_applied int, edits_withheld int, unresolved array<string>,
 uncheckable array<string>, errors_before int, errors_after int, type_escapes int, deprecation_gaps int, duration_ms bigint"""


def test_scores(frame):
    base = ("c", "m", None, "verified", None, 2, 0, None, None, 3, 0, 0, 0, 5)

    def score(**change):
        names = [p.split()[0] for p in OUTCOME.replace("\n", " ").split(", ")]
        row = tuple(change.get(n, v) for n, v in zip(names, base))
        return scoring.score_cases(frame(CASE, ("c", 2)), frame(OUTCOME, row)).first()

    r = score()
    assert (r.passed, r.clean, r.edit_ratio, r.error_reduction, r.penalties) == (True, True, 1.0, 1.0, [])
    assert score(edits_applied=6).edit_ratio == 3.0 and score(edits_applied=6).clean
    assert score(errors_before=None).error_reduction is None and score(errors_before=0).error_reduction is None
    for change in ({"type_escapes": 1}, {"deprecation_gaps": 1}, {"unresolved": ["x"]}, {"uncheckable": ["y"]}, {"verdict": "typecheck-only"}, {"inconclusive": "t"}):
        assert not score(**change).clean


def test_salted_join_equals_plain_join(frame, rows):
    big = frame("k string, v int", *[("hot", n) for n in range(50)], ("cold", 1), ("lost", 2))
    small = frame("k string, w string", ("hot", "a"), ("hot", "b"), ("cold", "c"))
    for how in ("inner", "left", "left_semi"):
        salted = skew.split_hot_join(big, small, ["k"], how, rows_per_task=7, salt=True)
        assert rows(salted) == rows(big.join(small, ["k"], how))


EVENT = "event string, delivery bigint, received_at string, action string, inst bigint, added array<string>, removed array<string>, repo string, ref string"


def events(frame, *items):
    from pyspark.sql import functions as F

    df = frame(EVENT, *items)
    listed = lambda c: F.transform(c, lambda n: F.struct(n.alias("full_name"), F.lit("main").alias("default_branch")))
    none = F.lit(None)
    return df.select(
        "event", "delivery", F.to_timestamp("received_at").alias("received_at"), "action",
        F.when(F.col("inst").isNotNull(), F.struct(F.col("inst").alias("id"), F.lit("acme").alias("account"))).alias("installation"),
        listed("added").alias("repositories"), listed("added").alias("repositories_added"), listed("removed").alias("repositories_removed"),
        F.when(F.col("repo").isNotNull(), F.struct(F.col("repo").alias("full_name"), F.lit("main").alias("default_branch"))).alias("repository"),
        "ref", none.cast("struct<status:string,conclusion:string,head_branch:string,head_sha:string>").alias("check_suite"),
        none.cast("struct<number:bigint,branch:string,url:string>").alias("pull_request"),
    )


def test_monitor_state(spark, frame, rows):
    at = "2024-01-01 00:00:%02d"
    e = lambda n, kind, **x: (kind, n, at % n, x.get("action"), x.get("inst"), x.get("added"), x.get("removed"), x.get("repo"), x.get("ref"))
    batches = [
        [e(1, "push", repo="a", ref="refs/heads/main"), e(2, "installation", action="created", inst=1, added=["a", "b"]), e(3, "push", repo="a", ref="refs/heads/main"), e(4, "push", repo="a", ref="refs/heads/dev")],
        [e(5, "installation_repositories", inst=1, removed=["b"]), e(6, "push", repo="b", ref="refs/heads/main"), e(7, "installation_repositories", inst=2, added=["a"])],
        [e(8, "installation", action="deleted", inst=1), e(9, "push", repo="a", ref="refs/heads/main"), e(10, "ping"), e(11, "installation", inst=None), e(12, "installation_repositories", inst=1, added=["b"])],
    ]
    stream = webhooks.WebhookStream(spark, work_path(spark, "monitor"))
    for n, items in enumerate(batches):
        stream.handle(events(frame, *items), n)
        stream.last = n
    assert rows(stream.table("actions"), "delivery", "action") == sorted([
        (1, "ignored: repository not tracked"), (2, "installation created"), (3, "scan queued"), (4, "ignored: not the default branch"), (5, "installation repositories changed"),
        (6, "ignored: repository not tracked"), (7, "installation repositories changed"), (8, "installation deleted"), (9, "scan queued"), (10, "ignored: ping"),
        (11, "ignored: no installation id"), (12, "installation repositories changed"),
    ], key=repr)
    got = {r.repo: (r.installation, r.removed_at is None) for r in stream.table("repos").collect()}
    assert got == {"a": (2, True), "b": (1, True)}
    assert rows(stream.table("jobs"), "repo", "job") == [("a", 2), ("b", 2)]
    assert [(r.installation, r.suspended_at is not None) for r in stream.table("installations").orderBy("installation").collect()] == [(1, True)]


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, frame, rows):
    root = work_path(spark, "monitor")
    stream = webhooks.WebhookStream(spark, root, buckets=8)
    at = "2024-01-01 00:00:%02d"
    many = [f"r{i}" for i in range(200)]
    stream.handle(events(frame, ("installation", 1, at % 1, "created", 1, many, None, None, None)), 0)
    stream.handle(events(frame, ("push", 2, at % 2, None, None, None, None, "r7", "refs/heads/main")), 1)
    stream.handle(events(frame, ("installation_repositories", 3, at % 3, None, 1, None, ["r7", "unknown"], None, None)), 2)
    holds = [stream.state._holds("repos", n) for n in range(3)]
    assert set(holds[0].values()) == {0} and len(holds[0]) == 8
    assert holds[1] == holds[0]  # a push changes no repository
    assert sorted(holds[2].values()) == [0] * 7 + [2]
    assert sorted(stream.state._holds("jobs", 1).values()) == [0] * 7 + [1]
    assert stream.state.read("repos", 2).filter("removed_at IS NULL").count() == 199
    # found after a restart with the number of buckets it was written with; the older version is still whole
    again = webhooks.WebhookStream(spark, root, buckets=64)
    again.state.expire(2)
    assert again.state.buckets == 8 and again.last == 2
    assert again.state.read("repos", 2).count() == again.state.read("repos", 1).count() == 200
    # a deleted installation reaches repositories that no event names
    again.handle(events(frame, ("installation", 4, at % 4, "deleted", 1, None, None, None, None)), 3)
    assert again.state.read("repos", 3).filter("removed_at IS NULL").count() == 0


def test_untouched_findings_keep_their_files(spark, frame):
    stream = scan_stream.ScanStream(spark, work_path(spark, "run"), buckets=8)
    stream.handle(frame(FOUND, *[(f"r{i}", "1", "f") for i in range(100)]), 0)
    stream.handle(frame(FOUND, ("r5", "2", "g")), 1)
    assert sorted(stream.state._holds("findings", 1).values()) == [0] * 7 + [1]
    got = {(r.repo, r.finding): r.status for r in stream.state.read("findings", 1).collect()}
    assert len(got) == 101 and got["r5", "f"] == "fixed" and got["r5", "g"] == "open" and got["r6", "f"] == "open"


def test_uninstalls_against_pairs(frame, rows):
    """What every deletion does to every repository it meets, without a row per repository and deletion."""
    rng = random.Random(3)
    at = lambda n: datetime(2024, 1, 1) + timedelta(seconds=n)
    n_repos, times = 40, rng.sample(range(5000), 900)
    defines = [(f"r{rng.randrange(n_repos)}", at(n), n, rng.randrange(2), 1) for n in times[:100]]
    deleted = [(rng.randrange(2), at(n), n) for n in times[100:]]
    given = frame("repo string, t timestamp, d bigint, installation bigint, step int", *defines).select("repo", F.struct("t", "d").alias("at"), "step", "installation")
    dropped = frame("installation bigint, t timestamp, d bigint", *deleted).select("installation", F.struct("t", "d").alias("at"))
    got = webhooks.uninstalls(given, dropped).select("repo", "at.d", "installation").collect()
    want = set()
    for repo, _, since, installation, _ in defines:
        until = min((d for r, _, d, _, _ in defines if r == repo and d > since), default=10_000)
        met = [d for i, _, d in deleted if i == installation and since < d < until]
        want |= {(repo, f(met), installation) for f in (min, max) if met}
    assert sorted(map(tuple, got)) == sorted(want)
    # one row per repository and deletion would be 10 times this and more
    events_ = dropped.select(
        F.lit("installation").alias("event"), F.col("at.d").alias("delivery"), F.col("at.t").alias("received_at"), F.lit("deleted").alias("action"),
        F.struct("installation", F.lit("o").alias("account")).cast("struct<id:bigint,account:string>").alias("installation"),
        *[F.lit(None).cast("array<struct<full_name:string,default_branch:string>>").alias(c) for c in ("repositories", "repositories_added", "repositories_removed")],
    )
    before = given.groupBy("repo").agg(F.max_by(F.struct("installation", "at"), "at").alias("s")).select(
        "repo", "s.installation", F.lit("main").alias("default_branch"), F.col("s.at.t").alias("changed_at"), F.col("s.at.d").alias("changed_by"), F.lit(None).cast("timestamp").alias("removed_at")
    )
    operations = webhooks.repo_operations(before, events_)
    assert operations.count() <= 3 * before.count()
    last = {r.repo: (r.changed_by, r.removed_at is None) for r in webhooks.next_repos(operations).collect()}
    for repo, installation, d in before.select("repo", "installation", "changed_by").collect():
        later = [x for i, _, x in deleted if i == installation and x > d]
        assert last[repo] == (max(later, default=d), not later)


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_against_pairs(spark, frame, strict):
    rng = random.Random(5)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), rng.choice([None, *range(60)])) for i in range(400)]
    right = [(key(), rng.choice([None, *range(60)]), i) for i in range(300)]
    asked = frame("id int, k string, at int", *left)
    got = as_of(asked, frame("k string, at int, v int", *right).repartition(7), ["k"], "at", ["v"], strict, ("v",))
    wanted = {}
    for i, k, at in left:
        before = sorted((t, v) for other, t, v in right if k is not None and at is not None and other == k and t is not None and (t < at or not strict and t == at))
        wanted[i] = (before[-1][1] if before else None, len(before))
    assert {r.id: (r.last.v if r.last else None, r.n_before) for r in got.collect()} == wanted
    none = as_of(asked, frame("k string, at int, v int"), ["k"], "at", ["v"])
    assert none.filter("last IS NOT NULL OR n_before > 0").count() == 0 and none.count() == 400
    assert as_of(asked.limit(0), frame("k string, at int, v int", *right), ["k"], "at", ["v"]).count() == 0


def test_as_of_with_one_hot_key(spark):
    """A hundred thousand pushes and as many spans of one repository: ten thousand million pairs, none of them made."""
    left = spark.range(100_000).selectExpr("id", "'r' AS k", "id * 2 + 1 AS at")
    right = spark.range(100_000).selectExpr("'r' AS k", "id * 2 AS at", "id AS v")
    got = as_of(left, right, ["k"], "at", ["v"])
    assert got.filter("last.v = id AND n_before = id + 1").count() == 100_000


def test_scan_deltas_are_not_dealt_out_by_repository(spark, frame, rows):
    """A fleet's findings may lie in few repositories: no exchange or join of them is by repository alone."""
    scans = frame("repo string, scan string", *[("r", s) for s in "abcd"], ("s", "a"))
    found = frame("repo string, scan string, finding string", ("r", "a", "x"), ("r", "c", "x"), ("r", "b", "y"), ("r", "d", "z"), ("s", "a", "x"), ("r", "nowhere", "x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        deltas = lifecycle.scan_deltas(found, scans)
        plan = deltas._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(repo" in plan and not re.search(r"hashpartitioning\(repo#\d+, \d+\)", plan)
    want = [("r", "x", "b", "resolved"), ("r", "x", "c", "returned"), ("r", "x", "d", "resolved"), ("r", "y", "b", "added"), ("r", "y", "c", "resolved"), ("r", "z", "d", "added")]
    assert rows(deltas, "repo", "finding", "scan", "event") == want
