"""Advisory screening queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import vulnerabilities as vuln
from ..sources import advisories
from . import Tables, query

SIDE = ("expected_vulnerable",)


def advisory_documents(t: Tables):
    """Advisory records as JSON text, one per supplier."""
    a = t.view("advisory_rows")
    text = F.col

    def v(*parts):
        return F.concat_ws(".", *[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])

    none = F.lit(None).cast("string")

    def event(introduced=none, fixed=none, last=none):
        return F.struct(introduced.alias("introduced"), fixed.alias("fixed"), last.alias("last_affected"), none.alias("limit"))

    m, f, d = text("m"), text("f"), text("d")
    opened = event(introduced=F.when(f == 0, F.lit("0")).otherwise(v(m, "0", "0")))
    closed = F.when(d == 0, event(last=v(m + 1, "0", "0"))).when(d != 5, event(fixed=v(m + 1, f, "0")))
    second = F.when(m == 1, F.array(event(introduced=F.lit("4.1.0")), event(fixed=F.lit("4.3.0")))).otherwise(
        F.array().cast("array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>")
    )
    events = F.concat(F.array_compact(F.array(opened, closed)), second)
    ranges = F.array_compact(
        F.array(
            F.when(text("has_git"), F.struct(F.lit("GIT").alias("type"), F.array(event(introduced=F.lit("0"))).alias("events"))),
            F.struct(F.lit("SEMVER").alias("type"), events.alias("events")),
        )
    )
    package = F.struct(text("name").alias("name"), text("ecosystem").alias("ecosystem"))
    aliases = F.array_compact(F.array(F.concat(F.lit("X-"), text("s").cast("string")), F.when(text("s") % 3 != 0, F.concat(F.lit("CVE-2024-"), text("s").cast("string")))))
    severity = F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.concat(F.lit("AV:N/S:"), text("s").cast("string")).alias("score")))
    record = F.struct(
        text("advisory").alias("id"),
        aliases.alias("aliases"),
        text("s_name").alias("summary"),
        severity.alias("severity"),
        F.array(F.struct(package.alias("package"), ranges.alias("ranges"))).alias("affected"),
    )
    return a.select("s", F.to_json(record).alias("content"))


def records(t: Tables):
    return advisories.parse_advisories(advisory_documents(t))


def windows(t: Tables):
    return advisories.advisory_windows(records(t))


def vulnerabilities(t: Tables):
    return vuln.scan(t.view("installed"), windows(t))


FACTS_SQL = """
SELECT advisory, CASE s % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END AS severity,
       CASE WHEN s % 4 <> 0 THEN CAST(s % 10 AS DOUBLE) END AS cvss_score, CASE WHEN s % 3 = 0 THEN CAST(s % 100 AS DOUBLE) / 100 END AS epss_percentile,
       CASE WHEN s % 2 = 0 THEN 'CWE-' || CAST(s AS STRING) END AS cwe
FROM advisory_rows WHERE s_acctbal > 0
"""
URGENCY_SQL = """CASE WHEN f.advisory IS NULL THEN -1 ELSE coalesce(100 + f.epss_percentile * 100, f.cvss_score,
  CASE f.severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) END"""


def facts(t: Tables):
    rows = t.sql(FACTS_SQL, "advisory_rows")
    doc = F.struct(
        F.col("advisory").alias("ghsa_id"),
        "severity",
        F.struct(F.col("cvss_score").alias("score")).alias("cvss"),
        F.struct(F.col("epss_percentile").alias("percentile")).alias("epss"),
        F.when(F.col("cwe").isNotNull(), F.array(F.struct(F.col("cwe").alias("cwe_id")), F.struct(F.lit("CWE-0").alias("cwe_id")))).alias("cwes"),
    )
    return advisories.parse_facts(rows.select(F.to_json(doc).alias("content")))


@query("advisory_windows", "SELECT advisory, ecosystem, name, introduced, fixed, last_affected FROM expected_windows", ("expected_windows",))
def _(t):
    return windows(t).select("advisory", "ecosystem", "name", "introduced", "fixed", "last_affected")


@query(
    "advisory_names",
    """SELECT advisory, CASE WHEN s % 3 <> 0 THEN 'CVE-2024-' || CAST(s AS STRING) END AS cve, 'AV:N/S:' || CAST(s AS STRING) AS cvss_vector,
              s_name AS summary FROM advisory_rows""",
    ("advisory_rows",),
)
def _(t):
    return advisories.advisory_names(records(t))


@query("advisory_facts", FACTS_SQL, ("advisory_rows",))
def _(t):
    return facts(t)


@query("vulnerable_versions", "SELECT * FROM expected_vulnerable", SIDE)
def _(t):
    return vulnerabilities(t)


@query(
    "version_interval_join",
    """SELECT DISTINCT i.repo, i.ecosystem, i.name, i.version, e.advisory FROM installed i
       JOIN expected_vulnerable e ON i.ecosystem = e.ecosystem AND i.name = e.name AND i.version = e.version""",
    ("installed", "expected_vulnerable"),
)
def _(t):
    found = vulnerabilities(t).select(*vuln.VERSION, "advisory")
    return vuln.spread_to_repos(t.view("installed"), found)


@query(
    "screened_versions",
    """SELECT DISTINCT i.ecosystem, i.name, i.version FROM installed i
       JOIN (SELECT DISTINCT ecosystem, name FROM expected_windows) w ON i.ecosystem = w.ecosystem AND i.name = w.name""",
    ("installed", "expected_windows"),
)
def _(t):
    return vuln.screen(t.view("installed"), windows(t)).select(*vuln.VERSION)


TARGET_POS = "CAST(string_split(fixed_in, '.')[1] AS INT) * 100000 + CAST(string_split(fixed_in, '.')[2] AS INT) * 1000"


@query(
    "remediation_target",
    f"""SELECT ecosystem, name, version, count(*) AS n_advisories, arg_max(fixed_in, {TARGET_POS}) AS target, count(fixed_in) AS clears,
               coalesce(string_agg(CASE WHEN fixed_in IS NULL THEN advisory END, ',' ORDER BY advisory), '') AS leaves
        FROM expected_vulnerable GROUP BY ALL""",
    SIDE,
)
def _(t):
    return vuln.remediation_targets(vulnerabilities(t)).withColumn("leaves", F.array_join("leaves", ","))


@query(
    "advisory_enrichment",
    f"""SELECT e.ecosystem, e.name, e.version, e.advisory, f.severity, f.epss_percentile, round({URGENCY_SQL}, 6) AS urgency
        FROM expected_vulnerable e LEFT JOIN ({FACTS_SQL}) f ON e.advisory = f.advisory""",
    SIDE + ("advisory_rows",),
)
def _(t):
    return vuln.enrich(vulnerabilities(t), facts(t)).select(
        *vuln.VERSION, "advisory", "severity", "epss_percentile", F.round("urgency", 6).alias("urgency")
    )


@query(
    "vulnerable_by_urgency",
    f"""SELECT e.ecosystem, e.name, e.version, round(max({URGENCY_SQL}), 6) AS worst
        FROM expected_vulnerable e LEFT JOIN ({FACTS_SQL}) f ON e.advisory = f.advisory GROUP BY ALL ORDER BY worst DESC, ecosystem, name, version""",
    SIDE + ("advisory_rows",),
)
def _(t):
    worst = vuln.worst_urgency(vuln.enrich(vulnerabilities(t), facts(t)))
    return vuln.ranked(worst.withColumn("worst", F.round("worst", 6)))


@query(
    "advisory_budget",
    "SELECT advisory, row_number() OVER (ORDER BY advisory) <= 40 AS within FROM (SELECT DISTINCT advisory FROM expected_vulnerable) x",
    SIDE,
)
def _(t):
    return vuln.within_budget(vulnerabilities(t), 40)


@query(
    "vulnerability_findings",
    """SELECT ecosystem, name, version, string_agg(advisory, ',' ORDER BY advisory) AS advisories,
              string_agg(shown, ',' ORDER BY shown) AS names,
              substr(sha256('vulnerability|' || name || '|' || version || '|' || string_agg(advisory, ',' ORDER BY advisory)), 1, 12) AS finding_id
       FROM (SELECT e.*, CASE WHEN s % 3 <> 0 THEN 'CVE-2024-' || CAST(s AS STRING) ELSE e.advisory END AS shown
             FROM expected_vulnerable e JOIN advisory_rows a ON e.advisory = a.advisory) x GROUP BY ecosystem, name, version""",
    SIDE + ("advisory_rows",),
)
def _(t):
    found = vuln.package_findings(vulnerabilities(t), advisories.advisory_names(records(t)))
    return found.select(
        *vuln.VERSION, F.array_join("advisories", ",").alias("advisories"), F.array_join("names", ",").alias("names"), "finding_id"
    )


REACH_SQL = """
WITH used AS (SELECT repo, pkg AS name, count(*) AS n FROM imports GROUP BY ALL),
     locks AS (SELECT repo, name, version, min(line) AS lock_line FROM installed GROUP BY ALL),
     v AS (SELECT DISTINCT i.repo, i.ecosystem, i.name, i.version FROM installed i
           JOIN expected_vulnerable e ON i.ecosystem = e.ecosystem AND i.name = e.name AND i.version = e.version)
SELECT v.repo, v.ecosystem, v.name, v.version, CASE WHEN v.ecosystem = 'npm' THEN coalesce(n, 0) ELSE 0 END AS n_imports,
       CASE WHEN v.ecosystem = 'npm' AND n IS NOT NULL THEN NULL ELSE lock_line END AS lock_line,
       CASE WHEN v.ecosystem <> 'npm' THEN 'unchecked' WHEN n IS NOT NULL THEN 'imported' ELSE 'not-imported' END AS reach,
       CASE WHEN v.ecosystem <> 'npm' THEN 'whether this repository imports it could not be checked — nothing here reads PyPI imports'
            WHEN n IS NOT NULL THEN 'imported at ' || CAST(n AS STRING) || ' site(s) in this repository'
            ELSE 'not imported from this repository’s source — it runs because a dependency calls it' END AS reach_text
FROM v LEFT JOIN used ON v.repo = used.repo AND v.name = used.name
LEFT JOIN locks ON v.repo = locks.repo AND v.name = locks.name AND v.version = locks.version
"""


def reach(t: Tables):
    installed = t.view("installed")
    found = vuln.spread_to_repos(installed, vulnerabilities(t).select(*vuln.VERSION).distinct())
    locks = installed.select("repo", "name", "version", "line")
    return vuln.reachability(found, t.view("imports").select("repo", "pkg"), locks, ("npm",))


@query("vulnerability_reachability", REACH_SQL, ("installed", "expected_vulnerable", "imports"))
def _(t):
    return reach(t)


@query("manifest_sites", "SELECT repo, name, version, min(line) AS lock_line FROM installed GROUP BY ALL", ("installed",))
def _(t):
    return vuln.manifest_sites(t.view("installed"))


FIXED_SQL = """SELECT CAST(s_suppkey % 50 AS STRING) AS repo, 'pkg' || CAST(s_suppkey % 100 AS STRING) AS pkg,
  CAST(max(s_suppkey % 5) AS STRING) || '.2.0' AS fixed_at, max(s_suppkey % 5) AS maj FROM supplier GROUP BY 1, 2"""


@query(
    "reintroduced_fixes",
    f"""SELECT DISTINCT i.repo, i.name AS pkg, i.version AS now, f.fixed_at FROM installed i JOIN ({FIXED_SQL}) f ON i.repo = f.repo AND i.name = f.pkg
        WHERE i.pos < f.maj * 100000 + 2005 AND i.ecosystem = 'npm'""",
    ("installed",),
)
def _(t):
    fixed = t.sql(FIXED_SQL).drop("maj")
    return vuln.reintroduced(fixed, t.view("installed").filter("ecosystem = 'npm'"))


@query(
    "urgency_ordinals",
    """SELECT p_partkey AS k, CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 100 BETWEEN 11 AND 13 THEN 'th'
              ELSE CASE p_partkey % 10 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END END AS ordinal FROM part""",
)
def _(t):
    return t.table("part").select(F.col("p_partkey").alias("k"), scores.ordinal(F.col("p_partkey")).alias("ordinal"))
