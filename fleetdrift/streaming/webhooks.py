"""Webhook events to tracked repositories, installations, scan requests and CI verdicts.

The rules are functions from (state, events) to new state; the stream applies them per micro-batch. Events are
ordered by time and delivery, so several events of one repository in a batch take effect in order. Nothing is
deleted: a removed repository keeps its row with ``removed_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.asof import as_of
from .state import BUCKETS, VersionedState, run_available

STATE = {
    "repos": "repo string, installation bigint, default_branch string, changed_at timestamp, changed_by bigint, removed_at timestamp",
    "installations": "installation bigint, account string, changed_at timestamp, changed_by bigint, suspended_at timestamp",
    "jobs": "repo string, kind string, job bigint, ref string, created_at timestamp",
    "prs": "repo string, number bigint, branch string, url string, opened_at timestamp, opened_by bigint, reset_at timestamp, reset_by bigint, ci_status string, ci_checked_at timestamp",
    "actions": "delivery bigint, action string, jobs_queued int",
}


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schemas.WEBHOOK).option("maxFilesPerTrigger", files_per_batch).json(path)


def deduplicated(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Sources that deliver at least once: the same delivery within the watermark counts once."""
    return stream.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["delivery"])


def _at(when: str = "received_at", by: str = "delivery") -> Column:
    return F.struct(F.col(when).alias("t"), F.col(by).alias("d"))


def uninstalls(defines: DataFrame, deleted: DataFrame, path: str | None = None) -> DataFrame:
    """repo, at, installation: the deletions of an installation that meet a repository while it belongs to it.

    ``defines``: repo, at, step, installation, what gives a repository its installation until the next one. ``deleted``:
    at, installation. Of several deletions in one such stretch the first takes the repository away and the last dates the
    change; those in between change nothing and are left out, so there are at most two rows per stretch and no product of
    repositories and deletions.
    """

    def backwards(at):
        return F.struct(at["t"].isNull(), -F.unix_micros(at["t"]), at["d"].isNull(), -at["d"])

    until = F.lead("at").over(Window.partitionBy("repo").orderBy("at", "step"))
    stretches = defines.withColumn("until", until).select(
        "repo", "installation", F.col("at").alias("since"), backwards(F.col("at")).alias("since_back"),
        F.struct(F.col("until").isNull().alias("open"), F.col("until").alias("at")).alias("end"),
    )
    dated = deleted.select("installation", "at", backwards(F.col("at")).alias("back"), F.struct(F.lit(False).alias("open"), F.col("at")).alias("end"))
    last = as_of(stretches, dated.select("installation", "at", "end"), ["installation"], "end", ["at"], path=path and f"{path}-last")
    met = last.filter(F.col("last.at") > F.col("since")).select("repo", "installation", "since_back", F.col("last.at").alias("latest"))
    first = as_of(met, dated.select("installation", "at", F.col("back").alias("since_back")), ["installation"], "since_back", ["at"], strict=True, path=path and f"{path}-first")
    return first.select("repo", F.explode(F.array_distinct(F.array("last.at", "latest"))).alias("at"), "installation")


def repo_operations(repos: DataFrame, events: DataFrame, path: str | None = None) -> DataFrame:
    """repo, at, step, op (add, remove, state), installation, default_branch in order of effect.

    One event first removes, then adds. A deleted installation removes the repositories that belong to it then.
    """
    live = events.filter(F.col("installation.id").isNotNull())
    install = F.col("event") == "installation"
    change = F.col("event") == "installation_repositories"
    leaving = F.col("action").isin("deleted", "suspend")

    def listed(when, column, op, step):
        rows = live.filter(when).select(_at().alias("at"), F.col("installation.id").alias("installation"), F.explode(column).alias("r"))
        return rows.filter("r.full_name IS NOT NULL").select(
            F.col("r.full_name").alias("repo"), "at", F.lit(step).alias("step"), F.lit(op).alias("op"), "installation",
            F.coalesce("r.default_branch", F.lit("main")).alias("default_branch"),
        )

    adds = listed(install & ~F.coalesce(leaving, F.lit(False)), "repositories", "add", 1).unionByName(listed(change, "repositories_added", "add", 1))
    removes = listed(change, "repositories_removed", "remove", 0)
    before = repos.select(
        "repo",
        F.struct(F.col("changed_at").alias("t"), F.col("changed_by").alias("d")).alias("at"),
        F.lit(2).alias("step"),
        F.when(F.col("removed_at").isNull(), "state").otherwise("state-removed").alias("op"),
        "installation",
        "default_branch",
    )
    deleted = live.filter(install & (F.col("action") == "deleted")).select(_at().alias("at"), F.col("installation.id").alias("installation"))
    given = ["repo", "at", "step", "installation"]
    drops = uninstalls(before.select(*given).unionByName(adds.select(*given)), deleted, path).select(
        "repo", "at", F.lit(0).alias("step"), F.lit("uninstall").alias("op"), "installation", F.lit(None).cast("string").alias("default_branch")
    )
    every = before.unionByName(adds).unionByName(removes).unionByName(drops)
    order = Window.partitionBy("repo").orderBy("at", "step")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    defines = F.col("op").isin("add", "state", "state-removed")
    # a removal of a repository that was never added changes nothing
    return (
        every.withColumns(
            {
                "known": F.max(defines.cast("int")).over(up_to),
                "home": F.last(F.when(defines, F.col("installation")), ignorenulls=True).over(up_to),
                "branch": F.last(F.when(defines, F.col("default_branch")), ignorenulls=True).over(up_to),
            }
        )
        .filter("known = 1")
        .select(
            "repo", "at", "step", "op", F.col("home").alias("installation"), F.col("branch").alias("default_branch"),
            F.col("op").isin("add", "state").alias("tracked"),
        )
    )


def next_repos(operations: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("installation", "default_branch", "tracked", "at"), F.struct("at", "step")).alias("s")
    return operations.groupBy("repo").agg(last).select(
        "repo", "s.installation", "s.default_branch", F.col("s.at.t").alias("changed_at"), F.col("s.at.d").alias("changed_by"),
        F.when(~F.col("s.tracked"), F.col("s.at.t")).alias("removed_at"),
    )


def pushes(events: DataFrame, operations: DataFrame, path: str | None = None) -> DataFrame:
    """delivery, at, repo, branch, verdict of every push: what the last operation on its repository before it left.

    ``operations``: repo, at, step, tracked.
    """
    branch = F.col("repository.default_branch")
    rows = events.filter("event = 'push'").select("delivery", _at().alias("at"), F.col("repository.full_name").alias("repo"), branch.alias("branch"), "ref")
    seen = as_of(rows, operations, ["repo"], "at", ["tracked"], strict=True, order=("step",), path=path)
    verdict = (
        F.when(F.col("repo").isNull(), "ignored: unidentifiable repository")
        .when(F.col("branch").isNull() | ~F.col("ref").eqNullSafe(F.concat(F.lit("refs/heads/"), F.col("branch"))), "ignored: not the default branch")
        .when(F.coalesce("last.tracked", F.lit(False)), "scan queued")
        .otherwise("ignored: repository not tracked")
    )
    return seen.select("delivery", "at", "repo", "branch", verdict.alias("verdict"))


def next_installations(installations: DataFrame, events: DataFrame) -> DataFrame:
    """Last event per installation wins: an upsert clears the suspension, suspend and delete set it."""
    rows = events.filter((F.col("event") == "installation") & F.col("installation.id").isNotNull())
    off = F.coalesce(F.col("action").isin("deleted", "suspend"), F.lit(False))
    now = rows.select(
        F.col("installation.id").alias("installation"),
        F.when(~off, F.coalesce("installation.account", F.lit("unknown"))).alias("account"),
        F.col("received_at").alias("changed_at"),
        F.col("delivery").alias("changed_by"),
        F.when(off, F.col("received_at")).alias("suspended_at"),
    )
    old = installations.select(*now.columns)
    order = F.struct("changed_at", "changed_by")
    merged = old.unionByName(now).groupBy("installation").agg(
        F.max_by(F.struct("changed_at", "changed_by", "suspended_at"), order).alias("s"),
        F.max_by("account", F.when(F.col("account").isNotNull(), order)).alias("account"),
    )
    # suspending an installation nobody installed leaves nothing
    return merged.filter("account IS NOT NULL").select("installation", "account", "s.*")


def coalesce_requests(requests: DataFrame, claims: DataFrame) -> DataFrame:
    """One queued request per (repo, kind) between two claims: the first one's id, the newest one's ref.

    ``requests``: repo, kind, id, ref, at. ``claims``: repo, kind, at: the moments a runner took the queue. A
    request belongs to the run after the last claim by its time: run n follows n claims.
    """
    placed = as_of(requests, claims, ["repo", "kind"], "at", ["at"])
    return placed.groupBy("repo", "kind", F.col("n_before").cast("int").alias("run")).agg(
        F.min_by("id", "at").alias("job"), F.max_by("ref", "at").alias("ref"), F.max("at").alias("created_at"), F.count(F.lit(1)).alias("n_requests")
    )


def next_jobs(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Queued jobs after more requests: a queued one keeps its id and takes the newest ref. ``requests``: repo, kind, id, ref, at."""
    now = requests.groupBy("repo", "kind").agg(F.min_by("id", "at").alias("new_job"), F.max_by(F.struct("ref", "at"), "at").alias("n"))
    merged = jobs.join(now, ["repo", "kind"], "full_outer")
    return merged.select(
        "repo", "kind", F.coalesce("job", "new_job").alias("job"), F.coalesce("n.ref", "ref").alias("ref"), F.coalesce("n.at.t", "created_at").alias("created_at")
    )


def next_prs(prs: DataFrame, events: DataFrame) -> DataFrame:
    """Recorded pull requests, and CI verdicts by (repo, branch). Recording one again resets its CI to pending."""
    recorded = events.filter("event = 'pull_request_recorded'").select(
        F.col("repository.full_name").alias("repo"), "pull_request.number", "pull_request.branch", "pull_request.url", _at().alias("at")
    )
    fresh = recorded.groupBy("repo", "number").agg(
        F.min_by(F.struct("branch", "url", "at"), "at").alias("first"), F.max("at").alias("reset")
    )
    merged = prs.join(fresh, ["repo", "number"], "full_outer").select(
        "repo",
        "number",
        F.coalesce("branch", "first.branch").alias("branch"),
        F.coalesce("url", "first.url").alias("url"),
        F.coalesce("opened_at", "first.at.t").alias("opened_at"),
        F.coalesce("opened_by", "first.at.d").alias("opened_by"),
        F.coalesce("reset.t", "reset_at").alias("reset_at"),
        F.coalesce("reset.d", "reset_by").alias("reset_by"),
        F.when(F.col("reset").isNotNull(), "pending").otherwise(F.col("ci_status")).alias("ci_status"),
        F.when(F.col("reset").isNull(), F.col("ci_checked_at")).alias("ci_checked_at"),
    )
    last = finished_suites(events).groupBy("repo", "branch").agg(F.max_by(F.struct("conclusion", "at"), "at").alias("ci"))
    newer = F.col("ci.at") > F.struct(F.col("reset_at").alias("t"), F.col("reset_by").alias("d"))
    return merged.join(last, ["repo", "branch"], "left").select(
        "repo", "number", "branch", "url", "opened_at", "opened_by", "reset_at", "reset_by",
        F.when(newer, F.col("ci.conclusion")).otherwise(F.col("ci_status")).alias("ci_status"),
        F.when(newer, F.col("ci.at.t")).otherwise(F.col("ci_checked_at")).alias("ci_checked_at"),
    )


def finished_suites(events: DataFrame) -> DataFrame:
    rows = events.filter("event = 'check_suite' AND check_suite.status = 'completed'")
    return rows.select(
        "delivery", F.col("repository.full_name").alias("repo"), F.col("check_suite.head_branch").alias("branch"),
        F.coalesce("check_suite.conclusion", F.lit("unknown")).alias("conclusion"), _at().alias("at"),
    ).filter("repo IS NOT NULL AND branch IS NOT NULL")


def ci_matches(events: DataFrame, prs_after: DataFrame) -> DataFrame:
    """Deliveries of finished suites whose branch had a recorded pull request by then; a late or unknown one is no error."""
    opened = prs_after.groupBy("repo", "branch").agg(F.min(F.struct(F.col("opened_at").alias("t"), F.col("opened_by").alias("d"))).alias("since"))
    return finished_suites(events).join(opened, ["repo", "branch"]).filter(F.col("since") < F.col("at")).select("delivery")


def actions(events: DataFrame, push_rows: DataFrame, ci_hits: DataFrame) -> DataFrame:
    """delivery, action, jobs_queued: what each event led to, or why it was ignored."""
    pushed = push_rows.select("delivery", "verdict")
    hits = ci_hits.distinct().withColumn("ci", F.lit(True))
    no_id = F.col("installation.id").isNull()
    event, action = F.col("event"), F.col("action")
    suite = F.col("check_suite")
    conclusion = F.coalesce("check_suite.conclusion", F.lit("unknown"))

    def known(column):
        return F.size(F.filter(F.coalesce(column, F.array().cast("array<struct<full_name:string,default_branch:string>>")), lambda r: r["full_name"].isNotNull()))

    text = (
        F.when(event.isin("installation", "installation_repositories") & no_id, "ignored: no installation id")
        .when((event == "installation") & (action == "deleted"), "installation deleted")
        .when((event == "installation") & (action == "suspend"), "installation suspended")
        .when(event == "installation", F.concat(F.lit("installation "), F.coalesce(action, F.lit("event"))))
        .when(event == "installation_repositories", "installation repositories changed")
        .when(event == "push", F.col("verdict"))
        .when((event == "check_suite") & ~F.coalesce(suite["status"] == "completed", F.lit(False)), "ignored: check suite not completed")
        .when(
            (event == "check_suite") & (F.col("repository.full_name").isNull() | suite["head_branch"].isNull()), "ignored: incomplete check suite payload"
        )
        .when((event == "check_suite") & F.col("ci"), F.concat(F.lit("CI "), conclusion, F.lit(" recorded for "), suite["head_branch"]))
        .when(event == "check_suite", "ignored: not a repair branch")
        .when(event == "pull_request_recorded", "pull request recorded")
        .otherwise(F.concat(F.lit("ignored: "), event))
    )
    queued = (
        F.when(text == "scan queued", 1)
        .when((event == "installation") & ~no_id & ~F.coalesce(action.isin("deleted", "suspend"), F.lit(False)), known(F.col("repositories")))
        .when((event == "installation_repositories") & ~no_id, known(F.col("repositories_added")))
        .otherwise(0)
    )
    return (
        events.join(pushed, "delivery", "left")
        .join(hits, "delivery", "left")
        .select("delivery", text.alias("action"), queued.cast("int").alias("jobs_queued"))
    )


def scan_requests(operations: DataFrame, push_rows: DataFrame) -> DataFrame:
    """repo, kind, id, ref, at: a scan for each repository added and each push accepted."""
    added = operations.filter("op = 'add'").select("repo", F.col("at.d").alias("id"), F.col("default_branch").alias("ref"), "at")
    pushed = push_rows.filter("verdict = 'scan queued'").select("repo", F.col("delivery").alias("id"), F.col("branch").alias("ref"), "at")
    return added.unionByName(pushed).withColumn("kind", F.lit("scan"))


KEYS = {"repos": "repo", "installations": "installation", "jobs": "repo", "prs": "repo"}


def named_repos(events: DataFrame) -> DataFrame:
    """repo: those that an event adds, removes or pushes to."""
    lists = [F.coalesce(c, F.array()) for c in ("repositories", "repositories_added", "repositories_removed")]
    listed = events.filter("event IN ('installation', 'installation_repositories')").select(F.explode(F.concat(*[F.transform(c, lambda r: r["full_name"]) for c in lists])).alias("repo"))
    return listed.unionByName(events.filter("event = 'push'").select(F.col("repository.full_name").alias("repo"))).filter("repo IS NOT NULL")


class WebhookStream:
    """The monitor: one stream, four state tables by key and a log.

    A batch reads and rewrites the buckets its events name. Only a deleted installation asks the whole table of
    repositories which ones are its own; those alone are rewritten.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.state = VersionedState(spark, f"{root}/state", STATE, KEYS, buckets)
        self.checkpoint, self.ranges = f"{root}/checkpoint", f"{root}/ranges"
        self.last = self.state.last("prs")

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        state, before = self.state, batch_id - 1
        events = batch.persist()
        kept = [events]
        try:
            deleted = events.filter("event = 'installation' AND action = 'deleted'").select("installation.id").distinct()
            asked = state.touched("repos", named_repos(events))
            if not deleted.isEmpty():
                own = state.read("repos", before).join(deleted, F.col("installation") == F.col("id"), "left_semi")
                asked = sorted({*asked, *state.touched("repos", own)})
            operations = repo_operations(state.read("repos", before, asked), events, f"{self.ranges}-uninstalls").persist()
            kept.append(operations)
            push_rows = pushes(events, operations, self.ranges).persist()
            kept.append(push_rows)
            state.write("repos", batch_id, next_repos(operations), state.touched("repos", operations.filter("op NOT LIKE 'state%'")))
            installs = state.touched("installations", events.filter("event = 'installation'").select(F.col("installation.id").alias("installation")))
            state.write("installations", batch_id, next_installations(state.read("installations", before, installs), events), installs)
            requests = scan_requests(operations, push_rows)
            queues = state.touched("jobs", requests)
            state.write("jobs", batch_id, next_jobs(state.read("jobs", before, queues), requests), queues)
            suites = state.touched("prs", events.filter("event IN ('pull_request_recorded', 'check_suite')").select(F.col("repository.full_name").alias("repo")))
            state.write("prs", batch_id, next_prs(state.read("prs", before, suites), events), suites)
            hits = ci_matches(events, state.read("prs", batch_id, suites))
            state.append("actions", batch_id, actions(events, push_rows, hits))
        finally:
            for rows in reversed(kept):
                rows.unpersist()

    def run(self, stream: DataFrame) -> "WebhookStream":
        run_available(stream, self.handle, self.checkpoint)
        self.last = self.state.last("prs")
        self.state.expire(self.last)
        return self

    def table(self, name: str) -> DataFrame:
        return self.state.log(name) if name == "actions" else self.state.read(name, self.last)
