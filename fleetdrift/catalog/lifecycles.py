"""Finding lifecycle, history and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle, reporting
from ..session import work_path
from . import Tables, query

S = ("event_scans", "scan_found")

NUMBERED = "SELECT repo, scan, row_number() OVER (PARTITION BY repo ORDER BY scan) AS n FROM event_scans"
DELTA_SQL = f"""
WITH s AS ({NUMBERED}), f AS (SELECT f.repo, f.finding, s.n FROM scan_found f JOIN s ON f.repo = s.repo AND f.scan = s.scan),
     g AS (SELECT repo, finding, min(n) AS n0 FROM f GROUP BY ALL),
     grid AS (SELECT g.repo, g.finding, s.n, s.scan, f.n IS NOT NULL AS here, g.n0 FROM g JOIN s ON g.repo = s.repo LEFT JOIN f ON f.repo = g.repo AND f.finding = g.finding AND f.n = s.n),
     p AS (SELECT *, lag(here) OVER (PARTITION BY repo, finding ORDER BY n) AS prev FROM grid)
SELECT repo, finding, scan, CASE WHEN here AND n = n0 THEN 'added' WHEN here THEN 'returned' ELSE 'resolved' END AS event FROM p
WHERE n > 1 AND ((here AND n = n0) OR (here AND NOT prev AND n > n0) OR (NOT here AND prev))
"""
STATE_SQL = f"""
WITH s AS ({NUMBERED}), l AS (SELECT repo, max(n) AS last_n FROM s GROUP BY repo),
     f AS (SELECT f.repo, f.finding, min(f.scan) AS first_seen, max(s.n) AS n FROM scan_found f JOIN s ON f.repo = s.repo AND f.scan = s.scan GROUP BY ALL)
SELECT f.repo, f.finding, f.first_seen, s.scan AS last_seen, CASE WHEN f.n = l.last_n THEN 'open' ELSE 'fixed' END AS status
FROM f JOIN l ON f.repo = l.repo JOIN s ON s.repo = f.repo AND s.n = least(f.n + 1, l.last_n)
"""


def history(t: Tables):
    return t.view("scan_found"), t.view("event_scans")


@query("scan_deltas", DELTA_SQL, S)
def _(t):
    return lifecycle.scan_deltas(*history(t))


@query(
    "scan_delta_counts",
    f"""SELECT s.repo, s.scan, s.n = 1 AS first, count(*) FILTER (WHERE event = 'added') AS added, count(*) FILTER (WHERE event = 'returned') AS returned,
               count(*) FILTER (WHERE event = 'resolved') AS resolved FROM ({NUMBERED}) s LEFT JOIN ({DELTA_SQL}) d ON s.repo = d.repo AND s.scan = d.scan GROUP BY s.repo, s.scan, s.n""",
    S,
)
def _(t):
    found, scans = history(t)
    return lifecycle.scan_delta_counts(lifecycle.scan_deltas(found, scans), scans)


@query("finding_states", STATE_SQL, S)
def _(t):
    return lifecycle.finding_states(*history(t))


@query(
    "finding_states_dismissed",
    f"""SELECT s.repo, finding, first_seen, CASE WHEN finding LIKE '%:click' THEN (SELECT max(f.scan) FROM scan_found f WHERE f.repo = s.repo AND f.finding = s.finding) ELSE last_seen END AS last_seen,
               CASE WHEN finding LIKE '%:click' THEN 'dismissed' ELSE status END AS status FROM ({STATE_SQL}) s""",
    S,
)
def _(t):
    found, scans = history(t)
    return lifecycle.finding_states(found, scans, found.filter(F.col("finding").endswith(":click")))


def split_last(t: Tables):
    """Everything before each repository's last scan, and that scan."""
    found, scans = history(t)
    last = scans.groupBy("repo").agg(F.max("scan").alias("scan"))
    before = scans.join(last, ["repo", "scan"], "left_anti")
    older = found.join(last, ["repo", "scan"], "left_anti")
    return lifecycle.finding_states(older, before), last, found.join(last, ["repo", "scan"], "left_semi"), before


@query("findings_upsert", STATE_SQL, S)
def _(t):
    """Stored states, then one more scan per repository: the same as all scans at once."""
    stored, last, now, _before = split_last(t)
    return lifecycle.upsert_findings(stored, last, now)


@query(
    "round_delta",
    f"SELECT d.repo, d.finding, d.event FROM ({DELTA_SQL}) d JOIN (SELECT repo, max(scan) AS scan FROM event_scans GROUP BY repo) l ON d.repo = l.repo AND d.scan = l.scan",
    S,
)
def _(t):
    stored, last, now, before = split_last(t)
    return lifecycle.round_delta(stored, last, now, before)


SCANS = """
SELECT CAST(o_custkey % 60 AS STRING) AS repo, o_orderkey AS id, 'name' || CAST(o_orderkey % 7 AS STRING) AS repo_name, CAST(CAST(o_orderdate AS DATE) AS STRING) AS started_at FROM orders
"""


@query("latest_scans", f"SELECT repo, id, repo_name, started_at FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY id DESC) AS n FROM ({SCANS}) s) x WHERE n = 1")
def _(t):
    return reporting.latest_scans(t.sql(SCANS))


@query("newest_scans", f"SELECT * FROM ({SCANS}) s ORDER BY id DESC LIMIT 50")
def _(t):
    return reporting.newest(t.sql(SCANS), "id", 50)


@query(
    "stored_repos",
    f"""SELECT s.repo, s.scans, s.last_scanned, s.repo_name, coalesce(f.n, 0) AS findings, coalesce(r.n, 0) AS runs
        FROM (SELECT repo, count(*) AS scans, max(started_at) AS last_scanned, arg_max(repo_name, id) AS repo_name FROM ({SCANS}) x GROUP BY repo) s
        LEFT JOIN (SELECT CAST(l_orderkey % 50 AS VARCHAR) AS repo, count(*) AS n FROM lineitem GROUP BY 1) f ON s.repo = f.repo
        LEFT JOIN (SELECT CAST(user_id % 40 AS VARCHAR) AS repo, count(*) AS n FROM events GROUP BY 1) r ON s.repo = r.repo ORDER BY last_scanned DESC, s.repo""",
)
def _(t):
    findings = t.table("lineitem").select((F.col("l_orderkey") % 50).cast("string").alias("repo"))
    runs = t.table("events").select((F.col("user_id") % 40).cast("string").alias("repo"))
    return reporting.stored_repos(t.sql(SCANS), findings, runs)


@query("findings_listing", f"SELECT repo, finding, status FROM ({STATE_SQL}) s ORDER BY status, finding, repo", S)
def _(t):
    return lifecycle.finding_states(*history(t)).select("repo", "finding", "status").orderBy("status", "finding", "repo")


@query("scan_history", f"SELECT repo, id, repo_name, started_at FROM ({SCANS}) s")
def _(t):
    """Appended to a table partitioned by day in two rounds, then read back."""
    path = work_path(t.spark, "scan-history")
    rows = t.sql(SCANS).withColumn("scan_date", F.substring("started_at", 1, 4))
    early = F.col("scan_date") < "1998"
    lifecycle.append(rows.filter(early), path, "scan_date")
    lifecycle.append(rows.filter(~early), path, "scan_date")
    return t.spark.read.schema(rows.schema).parquet(path).drop("scan_date")


@query("verification_history", "SELECT doc_id AS id, model, harness, verdict AS outcome FROM repair_outcomes", ("repair_outcomes",))
def _(t):
    path = work_path(t.spark, "runs")
    rows = t.view("repair_outcomes").select(F.col("doc_id").alias("id"), "model", "harness", F.col("verdict").alias("outcome"), F.col("harness").alias("day"))
    lifecycle.append(rows, path, "day")
    return t.spark.read.schema(rows.schema).parquet(path).drop("day")


@query(
    "findings_partition_rewrite",
    "SELECT repo, finding, CASE WHEN repo IN ('1', '3') THEN 'new' ELSE 'old' END AS state FROM (SELECT DISTINCT repo, finding FROM scan_found) f",
    S,
)
def _(t):
    """Only the partitions of two repositories are replaced; the others are left as they are."""
    path = work_path(t.spark, "findings")
    rows = t.view("scan_found").select("repo", "finding").distinct()
    lifecycle.rewrite(rows.withColumn("state", F.lit("old")), path, "repo")
    lifecycle.rewrite(rows.filter("repo IN ('1', '3')").withColumn("state", F.lit("new")), path, "repo")
    return t.spark.read.schema("finding string, state string, repo string").parquet(path)


FIXED = "SELECT CAST(l_orderkey % 80 AS STRING) AS repo, 'pkg' || CAST(l_partkey % 50 AS STRING) AS pkg, l_linenumber AS fixed_at, l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey * 8 + l_linenumber AS recorded FROM lineitem"


@query("fixed_vulnerability_upsert", f"SELECT repo, pkg, arg_max(fixed_at, (recorded, fixed_at)) AS fixed_at, max(recorded) AS recorded FROM ({FIXED}) f GROUP BY repo, pkg")
def _(t):
    rows = t.sql(FIXED)
    old, new = rows.filter("fixed_at <= 3"), rows.filter("fixed_at > 3")
    merged = lifecycle.upsert_latest(lifecycle.upsert_latest(old.limit(0), old, ["repo", "pkg"], "recorded"), new, ["repo", "pkg"], "recorded")
    return merged.select("repo", "pkg", "fixed_at", "recorded")


@query(
    "retention_counts",
    f"""SELECT 'scans' AS "table", count(*) AS n_deleted FROM ({SCANS}) s WHERE repo IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)
        UNION ALL SELECT 'findings', count(*) FROM (SELECT DISTINCT repo, finding FROM scan_found) f WHERE repo IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)""",
    S,
)
def _(t):
    tables = {"scans": t.sql(SCANS), "findings": t.view("scan_found").select("repo", "finding").distinct()}
    doomed = t.table("nation").select(F.col("n_nationkey").cast("string").alias("repo"))
    return lifecycle.prune(tables, doomed)[1]


@query("retention_kept", f"SELECT * FROM ({SCANS}) s WHERE repo NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)")
def _(t):
    doomed = t.table("nation").select(F.col("n_nationkey").cast("string").alias("repo"))
    return lifecycle.prune({"scans": t.sql(SCANS)}, doomed)[0]["scans"]
