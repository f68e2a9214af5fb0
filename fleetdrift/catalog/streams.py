"""Streaming queries: events and scans replayed file by file, compared with the same history read at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..session import cut_lineage, work_path
from ..streaming import scans as scan_stream
from ..streaming import webhooks
from . import Tables, query
from .derive import view
from .lifecycles import DELTA_SQL, STATE_SQL

view(
    "feed",
    """
SELECT event_id AS d, ts AS t, event_type AS kind, user_id AS u, user_id % 10 AS inst, 'org' || CAST(user_id % 10 AS STRING) || '/r' || CAST(user_id AS STRING) AS repo
FROM events
""",
)
F_ = ("feed",)
BUCKETS = 32  # of the replayed state: some hundred repositories


def feed_events(t: Tables):
    """The events table as webhooks: sign-ups add or remove a repository, views push, clicks finish a CI suite,
    errors change an installation, purchases record a pull request or are unknown."""
    f = t.view("feed")
    d, kind = F.col("d"), F.col("kind")
    repo = F.struct(F.col("repo").alias("full_name"), F.lit("main").alias("default_branch"))
    none_repo = F.struct(F.lit(None).cast("string").alias("full_name"), F.lit("main").alias("default_branch"))
    event = (
        F.when(kind == "signup", "installation_repositories")
        .when(kind == "view", "push")
        .when(kind == "click", "check_suite")
        .when(kind == "error", "installation")
        .when(d % 2 == 0, "pull_request_recorded")
        .otherwise("ping")
    )
    return f.select(
        event.alias("event"),
        d.alias("delivery"),
        F.col("t").cast("timestamp").alias("received_at"),
        F.when(kind == "error", F.when(d % 29 == 0, "deleted").when(d % 11 == 0, "suspend").otherwise("created")).alias("action"),
        F.when(kind.isin("signup", "error") & (d % 53 != 0), F.struct(F.col("inst").cast("bigint").alias("id"), F.concat(F.lit("org"), F.col("inst").cast("string")).alias("account"))).alias("installation"),
        F.when((kind == "error") & (d % 3 == 0), F.array(repo)).alias("repositories"),
        F.when((kind == "signup") & (d % 4 != 0), F.array(repo)).alias("repositories_added"),
        F.when((kind == "signup") & (d % 4 == 0), F.array(repo)).alias("repositories_removed"),
        F.when(kind.isin("view", "click", "purchase"), F.when((kind == "view") & (d % 50 == 7), none_repo).otherwise(repo)).alias("repository"),
        F.when(kind == "view", F.when(d % 3 == 0, "refs/heads/dev").otherwise("refs/heads/main")).alias("ref"),
        F.when(
            kind == "click",
            F.struct(
                F.when(d % 5 == 0, "queued").otherwise("completed").alias("status"),
                F.when(d % 2 == 0, "success").otherwise("failure").alias("conclusion"),
                F.when(d % 41 != 0, F.concat(F.lit("fix-"), (d % 3).cast("string"))).alias("head_branch"),
                F.concat(F.lit("sha"), d.cast("string")).alias("head_sha"),
            ),
        ).alias("check_suite"),
        F.when(
            (kind == "purchase") & (d % 2 == 0),
            F.struct((d % 5).alias("number"), F.concat(F.lit("fix-"), (d % 3).cast("string")).alias("branch"), F.concat(F.lit("u"), d.cast("string")).alias("url")),
        ).alias("pull_request"),
    )


def in_slices(rows, order: str, n: int):
    """``n`` parts of the rows in time order, each as parallel as the rows are. The rows are worked out and written once."""
    rows = cut_lineage(rows, "slices")
    bounds = F.broadcast(rows.agg(F.min(order).alias("__low"), F.max(order).alias("__high")))  # one row
    at = lambda c: F.col(c).cast("timestamp").cast("double") if dict(rows.dtypes)[order] == "timestamp" else F.col(c).cast("double")
    share = (at(order) - at("__low")) / F.greatest(at("__high") - at("__low"), F.lit(1e-9))
    part = F.least(F.greatest(F.ceil(share * n) - 1, F.lit(0)), F.lit(n - 1))
    cut = rows.join(bounds, F.lit(True)).withColumn("__part", part)
    return [cut.filter(F.col("__part") == i).select(*rows.columns) for i in range(n)]


_RUNS: dict[tuple, object] = {}


def once(kind: str, t: Tables, run):
    """One replay per application and scale factor; the queries read its different tables."""
    key = (kind, t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _RUNS:
        _RUNS[key] = run(t)
    return _RUNS[key]


def monitor(t: Tables) -> webhooks.WebhookStream:
    return once("webhooks", t, replay_webhooks)


def replay_webhooks(t: Tables) -> webhooks.WebhookStream:
    source, run = work_path(t.spark, "webhooks"), webhooks.WebhookStream(t.spark, work_path(t.spark, "monitor"), BUCKETS)
    for part in in_slices(feed_events(t), "received_at", 4):
        part.write.mode("append").json(source)
        run.run(webhooks.read_events(t.spark, source, files_per_batch=100_000))
    return run


# The same rules over the whole history: what adds or removes a repository, in order.
OPS = """
ops AS (SELECT repo, t, d, 'remove' AS op, inst FROM feed WHERE kind = 'signup' AND d % 4 = 0 AND d % 53 <> 0
        UNION ALL SELECT repo, t, d, 'add', inst FROM feed WHERE d % 53 <> 0 AND ((kind = 'signup' AND d % 4 <> 0) OR (kind = 'error' AND d % 29 <> 0 AND d % 11 <> 0 AND d % 3 = 0))
        UNION ALL SELECT r.repo, f.t, f.d, 'remove', f.inst FROM feed f JOIN (SELECT DISTINCT repo, inst FROM feed) r ON f.inst = r.inst WHERE f.kind = 'error' AND f.d % 29 = 0 AND f.d % 53 <> 0),
firsts AS (SELECT repo, min(t) AS t0 FROM ops WHERE op = 'add' GROUP BY repo),
eff AS (SELECT o.*, lead(o.t) OVER (PARTITION BY o.repo ORDER BY o.t) AS until FROM ops o JOIN firsts f ON o.repo = f.repo AND o.t >= f.t0)
"""


@query(
    "stream_tracked_repos",
    f"""WITH {OPS} SELECT repo, inst AS installation, d AS changed_by, op = 'remove' AS removed FROM eff WHERE until IS NULL""",
    F_,
)
def _(t):
    return monitor(t).table("repos").select("repo", "installation", "changed_by", F.col("removed_at").isNotNull().alias("removed"))


@query(
    "stream_installations",
    """SELECT installation, account, changed_by, suspended FROM (SELECT inst AS installation, 'org' || inst AS account, max(d) AS changed_by, arg_max(d % 29 = 0 OR d % 11 = 0, d) AS suspended,
         count(*) FILTER (WHERE d % 29 <> 0 AND d % 11 <> 0) AS n FROM feed WHERE kind = 'error' AND d % 53 <> 0 GROUP BY inst) x WHERE n > 0""",
    F_,
)
def _(t):
    return monitor(t).table("installations").select("installation", "account", "changed_by", F.col("suspended_at").isNotNull().alias("suspended"))


ACTION_SQL = f"""
WITH {OPS}, prs AS (SELECT repo, 'fix-' || (first_d % 3) AS branch, first_t FROM (SELECT repo, d % 5 AS number, min(d) AS first_d, min(t) AS first_t FROM feed WHERE kind = 'purchase' AND d % 2 = 0 GROUP BY ALL) p)
SELECT f.d AS delivery, CASE kind
    WHEN 'purchase' THEN CASE WHEN d % 2 = 0 THEN 'pull request recorded' ELSE 'ignored: ping' END
    WHEN 'signup' THEN CASE WHEN d % 53 = 0 THEN 'ignored: no installation id' ELSE 'installation repositories changed' END
    WHEN 'error' THEN CASE WHEN d % 53 = 0 THEN 'ignored: no installation id' WHEN d % 29 = 0 THEN 'installation deleted' WHEN d % 11 = 0 THEN 'installation suspended' ELSE 'installation created' END
    WHEN 'view' THEN CASE WHEN d % 50 = 7 THEN 'ignored: unidentifiable repository' WHEN d % 3 = 0 THEN 'ignored: not the default branch'
      WHEN EXISTS (SELECT 1 FROM eff e WHERE e.repo = f.repo AND e.op = 'add' AND e.t < f.t AND (e.until IS NULL OR f.t < e.until)) THEN 'scan queued' ELSE 'ignored: repository not tracked' END
    ELSE CASE WHEN d % 5 = 0 THEN 'ignored: check suite not completed' WHEN d % 41 = 0 THEN 'ignored: incomplete check suite payload'
      WHEN EXISTS (SELECT 1 FROM prs WHERE prs.repo = f.repo AND prs.branch = 'fix-' || (d % 3) AND prs.first_t < f.t) THEN 'CI ' || CASE WHEN d % 2 = 0 THEN 'success' ELSE 'failure' END || ' recorded for fix-' || (d % 3)
      ELSE 'ignored: not a repair branch' END END AS action
FROM feed f
"""


@query("stream_event_actions", ACTION_SQL, F_)
def _(t):
    return monitor(t).table("actions").select("delivery", "action")


@query(
    "stream_scan_requests",
    f"""WITH a AS ({ACTION_SQL}), r AS (SELECT f.repo, f.d, f.t FROM feed f JOIN a ON f.d = a.delivery WHERE a.action = 'scan queued'
          OR (f.d % 53 <> 0 AND ((f.kind = 'signup' AND f.d % 4 <> 0) OR (f.kind = 'error' AND f.d % 29 <> 0 AND f.d % 11 <> 0 AND f.d % 3 = 0))))
        SELECT repo, 'scan' AS kind, min(d) AS job, 'main' AS ref FROM r GROUP BY repo""",
    F_,
)
def _(t):
    return monitor(t).table("jobs").select("repo", "kind", "job", "ref")


@query(
    "stream_ci_verdicts",
    """WITH p AS (SELECT repo, d % 5 AS number, 'fix-' || (min(d) % 3) AS branch, min(t) AS opened, max(t) AS reset FROM feed WHERE kind = 'purchase' AND d % 2 = 0 GROUP BY ALL),
            c AS (SELECT repo, 'fix-' || (d % 3) AS branch, max(t) AS t, arg_max(CASE WHEN d % 2 = 0 THEN 'success' ELSE 'failure' END, t) AS conclusion FROM feed
                  WHERE kind = 'click' AND d % 5 <> 0 AND d % 41 <> 0 GROUP BY ALL)
       SELECT p.repo, p.number, p.branch, CASE WHEN c.t > p.reset THEN c.conclusion ELSE 'pending' END AS ci_status FROM p LEFT JOIN c ON p.repo = c.repo AND p.branch = c.branch""",
    F_,
)
def _(t):
    return monitor(t).table("prs").select("repo", "number", "branch", "ci_status")


CLAIMS = "SELECT repo, 'scan' AS kind, d, t FROM feed WHERE kind = 'error'"
REQUESTS = "SELECT repo, 'scan' AS kind, d AS id, 'ref' || CAST(d AS STRING) AS ref, t FROM feed WHERE kind = 'view'"


@query(
    "coalesced_scan_requests",
    f"""WITH c AS ({CLAIMS}), r AS ({REQUESTS}), x AS (SELECT r.*, (SELECT count(*) FROM c WHERE c.repo = r.repo AND c.t <= r.t) AS run FROM r)
        SELECT repo, kind, CAST(run AS INT) AS run, arg_min(id, t) AS job, arg_max(ref, t) AS ref, count(*) AS n_requests FROM x GROUP BY repo, kind, run""",
    F_,
)
def _(t):
    claims = t.sql(CLAIMS, "feed").select("repo", "kind", F.col("t").alias("at"))
    requests = t.sql(REQUESTS, "feed").withColumnRenamed("t", "at")
    return webhooks.coalesce_requests(requests, claims).drop("created_at")


def scan_run(t: Tables) -> scan_stream.ScanStream:
    return once("scans", t, replay_scans)


def replay_scans(t: Tables) -> scan_stream.ScanStream:
    rows = t.view("event_scans").join(t.view("scan_found"), ["repo", "scan"], "left").select("repo", "scan", "finding")
    source = work_path(t.spark, "scans")
    dated = rows.withColumn("day", F.unix_date(F.col("scan").cast("date")))
    run = scan_stream.ScanStream(t.spark, work_path(t.spark, "scan-stream"), BUCKETS)
    for part in in_slices(dated, "day", 4):
        part.write.mode("append").parquet(source)
        run.run(scan_stream.read_scans(t.spark, source, files_per_batch=100_000))
    return run


@query("stream_finding_states", STATE_SQL, ("event_scans", "scan_found"))
def _(t):
    run = scan_run(t)
    return run.state.read("findings", run.last)


@query("stream_scan_deltas", DELTA_SQL, ("event_scans", "scan_found"))
def _(t):
    return scan_run(t).state.log("deltas")


@query("stream_deduplicated_events", "SELECT event_id AS delivery FROM events")
def _(t):
    """Every event delivered twice; each counts once."""
    source, target = work_path(t.spark, "twice"), work_path(t.spark, "once")
    rows = feed_events(t)
    rows.unionByName(rows).write.json(source)
    single = webhooks.deduplicated(t.spark.readStream.schema(schemas.WEBHOOK).json(source), "40 days")
    stream = single.select("delivery").writeStream.format("parquet").option("checkpointLocation", work_path(t.spark, "once-log"))
    stream.trigger(availableNow=True).start(target).awaitTermination()
    return t.spark.read.schema("delivery bigint").parquet(target)
