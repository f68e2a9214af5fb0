"""Composite queries: whole jobs from text and tables to their report."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import contracts
from ..plans import contracts as contract_plan
from ..plans import detectors, ecosystems, reports
from ..plans import vulnerabilities as vuln_plan
from ..sources import advisories, httpcalls
from . import Tables, query, readers, scans
from .contracts import CALL_VIEWS, HITS_SQL, NODE_SQL, PIN_SQL, call_files, change_hits, image_versions, pin_files
from .lifecycles import STATE_SQL
from .repairs import SUMMARY_SQL, scores
from .vulnerabilities import FACTS_SQL, REACH_SQL, TARGET_POS, URGENCY_SQL, facts, records, windows

REPORT_SQL = f"""
WITH reach AS ({REACH_SQL}),
     v AS (SELECT e.ecosystem, e.name, e.version, count(*) AS n, arg_max(fixed_in, {TARGET_POS}) AS target, count(fixed_in) AS clears,
             string_agg(CASE WHEN fixed_in IS NULL THEN e.advisory END, ', ' ORDER BY e.advisory) AS leaves, count(*) - count(fixed_in) AS n_leaves,
             string_agg(shown, ', ' ORDER BY shown) AS names, round(max({URGENCY_SQL}), 6) AS worst,
             max(coalesce(f.epss_percentile, -1)) FILTER (WHERE f.advisory IS NOT NULL) AS p,
             arg_max(f.severity, (coalesce(f.epss_percentile, -1), coalesce(f.severity, ''))) FILTER (WHERE f.advisory IS NOT NULL) AS sev
           FROM expected_vulnerable e JOIN (SELECT advisory, CASE WHEN s % 3 <> 0 THEN 'CVE-2024-' || s ELSE advisory END AS shown FROM advisory_rows) a ON e.advisory = a.advisory
           LEFT JOIN ({FACTS_SQL}) f ON e.advisory = f.advisory GROUP BY ALL),
     u AS (SELECT *, CASE WHEN p >= 0 THEN ' Exploitation likelihood: ' || CAST(round(p * 100) AS BIGINT) || CASE WHEN CAST(round(p * 100) AS BIGINT) % 100 BETWEEN 11 AND 13 THEN 'th'
                    ELSE CASE CAST(round(p * 100) AS BIGINT) % 10 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END END || ' percentile' || coalesce(' (' || sev || ')', '') || '.'
                  WHEN sev IS NOT NULL THEN ' Severity: ' || sev || '.' ELSE '' END AS urg FROM v)
SELECT r.repo, r.name, r.version, u.target, u.worst, r.reach, CASE WHEN u.target IS NOT NULL THEN names || '. Upgrading to ' || u.target || ' clears ' || clears || ' of ' || n || '.'
         || CASE WHEN n_leaves > 0 THEN ' ' || n_leaves || ' has no published fix and survives the upgrade: ' || leaves || '.' ELSE '' END || urg || ' ' || reach_text || '.'
       ELSE names || '. No published fix, so no upgrade is proposed.' || urg || ' ' || reach_text || '.' END AS guidance
FROM reach r JOIN u ON r.ecosystem = u.ecosystem AND r.name = u.name AND r.version = u.version
"""


@query("vulnerability_report", REPORT_SQL, ("installed", "expected_vulnerable", "imports", "advisory_rows"))
def _(t):
    installed = t.view("installed")
    rows = vuln_plan.report(
        installed, windows(t), advisories.advisory_names(records(t)), facts(t), t.view("imports").select("repo", "pkg"),
        installed.select("repo", "name", "version", "line"), ("npm",),
    )
    return rows.select("repo", "name", "version", "target", F.round("worst", 6).alias("worst"), "reach", "guidance")


@query(
    "contract_report",
    """SELECT repo, host, CASE WHEN k % 7 = 0 OR k % 7 = 3 THEN 'matched'
                WHEN EXISTS (SELECT 1 FROM page_urls x WHERE x.host = u.host AND x.k % 7 IN (0, 3) AND string_split(x.path, '/')[2] = string_split(u.path, '/')[2]) THEN 'gone' ELSE 'uncovered' END AS outcome, count(*) AS n FROM page_urls u
       WHERE k % 7 IN (0, 1, 3) AND EXISTS (SELECT 1 FROM page_urls x WHERE x.repo = u.repo AND x.host = u.host AND x.k % 7 IN (0, 3)) GROUP BY ALL
       UNION ALL SELECT repo, host, 'not-aligned', count(*) FROM page_urls u WHERE k % 7 = 1
         AND EXISTS (SELECT 1 FROM page_urls x WHERE x.host = u.host AND x.k % 7 IN (0, 3))
         AND NOT EXISTS (SELECT 1 FROM page_urls x WHERE x.repo = u.repo AND x.host = u.host AND x.k % 7 IN (0, 3)) GROUP BY ALL
       UNION ALL SELECT repo, host, 'no-description', count(*) FROM page_urls u WHERE k % 7 = 1
         AND NOT EXISTS (SELECT 1 FROM page_urls x WHERE x.host = u.host AND x.k % 7 IN (0, 3)) GROUP BY ALL
       UNION ALL SELECT repo, 'api.' || repo || '.example.com', 'no-description', count(*) FROM page_urls WHERE k % 7 = 6 GROUP BY repo""",
    ("page_urls",),
)
def _(t):
    """From source text: the calls, and a description per host that holds the templates of the literal ones."""
    calls = httpcalls.http_calls(call_files(t))
    p = t.view("page_urls").filter("k % 7 IN (0, 3)")
    verb = F.when(F.col("k") % 7 == 0, "put").otherwise("patch")
    template = F.regexp_replace("path", r"[0-9]+(\.html)?", "{id}")
    docs = p.select("host", template.alias("route"), verb.alias("verb")).groupBy("host", "route").agg(F.array_sort(F.collect_set("verb")).alias("verbs"))
    ops = F.array_join(F.transform("verbs", lambda v: F.concat(F.lit('"'), v, F.lit('":{}'))), ",")
    bodies = docs.select("host", F.concat(F.lit('"'), "route", F.lit('":{'), ops, F.lit("}")).alias("item")).groupBy("host").agg(
        F.concat(F.lit('{"openapi":"3.0.0","paths":{'), F.array_join(F.array_sort(F.collect_list("item")), ","), F.lit("}}")).alias("body")
    )
    candidates = bodies.select(
        F.col("host").alias("vendor"), F.lit(1).alias("seq"), F.concat(F.lit("https://"), "host").alias("url"), F.lit("official-domain").alias("provenance"),
        F.lit(None).cast("string").alias("updated_at"), "body",
    )
    report = contract_plan.check(calls, candidates, F.lit("2024-06-01").cast("timestamp"))
    return report.checked.groupBy("repo", "host", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "contract_notes",
    """SELECT repo, host, CASE k3 WHEN 0 THEN 'not authoritative, so nothing is claimed from it — https://' || host || ' — community (50/100): a third-party copy, so a mismatch is a lead and not a finding'
              WHEN 1 THEN 'the description could not be read as OpenAPI or Swagger' ELSE 'no API description could be located, so its calls were not checked' END AS note
       FROM (SELECT DISTINCT repo, host, length(host) % 3 AS k3 FROM page_urls) x""",
    ("page_urls",),
)
def _(t):
    p = t.view("page_urls")
    calls = p.select("repo", "host", F.lit("GET").alias("method"), F.col("path").alias("route"), F.lit(True).alias("resolved"))
    k = F.length("host") % 3
    candidates = p.select("host").distinct().filter(k < 2).select(
        F.col("host").alias("vendor"), F.lit(1).alias("seq"), F.concat(F.lit("https://"), "host").alias("url"),
        F.when(k == 0, "community").otherwise("official-domain").alias("provenance"), F.lit(None).cast("string").alias("updated_at"), F.lit("<html>").alias("body"),
    )
    return contract_plan.check(calls, candidates, F.lit("2024-06-01").cast("timestamp")).notes


@query(
    "contract_paging_sites",
    f"""WITH h AS (SELECT DISTINCT repo, host, change_path FROM ({HITS_SQL}) x WHERE change_path LIKE '%:page'),
             s AS (SELECT p.repo, p.host, 'f' || p.k AS file FROM page_calls p)
        SELECT h.repo, h.host, h.change_path, s.file FROM h JOIN s ON h.repo = s.repo AND h.host = s.host""",
    CALL_VIEWS,
)
def _(t):
    """Paging parameters a vendor newly offers, with the repository's calls to that host."""
    hits = contracts.offered_parameters(change_hits(t)).filter(F.col("group") == "paging").select("repo", "host", "change_path").distinct()
    sites = t.view("page_calls").select("repo", "host", F.concat(F.lit("f"), F.col("k").cast("string")).alias("file"))
    return hits.join(sites, ["repo", "host"])


@query(
    "pin_report",
    f"""SELECT repo, subject, count(*) AS n_pins, count(expected) AS n_repairs FROM (
          SELECT repo, subject, expected FROM ({NODE_SQL}) n
          UNION ALL SELECT repo, subject, '2.1' FROM ({PIN_SQL}) p WHERE kind = 'docker-image' AND version <> '2.1' AND subject <> 'standard') x GROUP BY ALL""",
    ("pin_rows",),
)
def _(t):
    dependencies = image_versions(t).withColumn("source", F.lit("lockfile"))
    report = reports.pins(pin_files(t), dependencies)
    return report.conflicts.groupBy("repo", "subject").agg(F.count(F.lit(1)).alias("n_pins"), F.count("expected").alias("n_repairs"))


@query(
    "remediation_report",
    """WITH above AS (SELECT DISTINCT p_partkey >> i AS a FROM part, range(1, 62) r(i) WHERE p_type = 'PROMO')
       SELECT '2' AS repo, CASE WHEN p_partkey % 2 = 1 THEN 'none' WHEN p_type = 'PROMO' THEN 'direct' WHEN a IS NOT NULL THEN 'parent' ELSE 'none' END AS kind, count(*) AS n
       FROM part LEFT JOIN above ON p_partkey = a GROUP BY ALL""",
)
def _(t):
    """Halving edges only, every package vulnerable, every second one with a fix, promoted parts as direct dependencies."""
    edges = t.sql("SELECT '2' AS repo, 'p' || CAST(p_partkey AS STRING) AS src, 'p' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS dst FROM part")
    vulnerable = t.sql("SELECT '2' AS repo, 'p' || CAST(p_partkey AS STRING) AS name, CASE WHEN p_partkey % 2 = 0 THEN '9.9.9' END AS target FROM part")
    directs = t.sql("SELECT '2' AS repo, 'p' || CAST(p_partkey AS STRING) AS name FROM part WHERE p_type = 'PROMO'")
    plan, _routes = vuln_plan.remediation(vulnerable, directs, edges)
    return plan.groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("engine_report", f"SELECT model, harness, clean_rate, mean_error_reduction FROM ({SUMMARY_SQL}) s", ("repair_outcomes", "repair_cases"))
def _(t):
    from ..operators import scoring

    board = scoring.leaderboard(scoring.summarise(scores(t)))
    return board.select("model", "harness", F.round("clean_rate", 6).alias("clean_rate"), F.round("mean_error_reduction", 6).alias("mean_error_reduction"))


@query(
    "dashboard_repos",
    f"""SELECT e.repo, count(DISTINCT e.scan) AS scans, max(e.scan) AS last_scanned, any_value(f.n) AS findings, any_value(coalesce(r.n, 0)) AS runs FROM event_scans e
        JOIN (SELECT repo, count(*) AS n FROM ({STATE_SQL}) s GROUP BY repo) f ON e.repo = f.repo
        LEFT JOIN (SELECT CAST(doc_id % 4 AS VARCHAR) AS repo, count(*) AS n FROM documents GROUP BY 1) r ON e.repo = r.repo GROUP BY e.repo""",
    ("event_scans", "scan_found"),
)
def _(t):
    listed = t.view("event_scans").select("repo", F.col("scan").alias("id"), F.concat(F.lit("name"), "repo").alias("repo_name"), F.col("scan").alias("started_at"))
    runs = t.table("documents").select((F.col("doc_id") % 4).cast("string").alias("repo"))
    return reports.dashboard(listed, t.view("scan_found"), runs).repos.select("repo", "scans", "last_scanned", "findings", "runs")


def board(t: Tables):
    """The dashboard over scans whose ids name their repository, so that no two are alike."""
    found = t.sql("SELECT repo, scan || '/' || repo AS scan, finding FROM scan_found", "scan_found")
    scans_ = t.sql("SELECT repo, scan || '/' || repo AS id, 'name' || repo AS repo_name, scan AS started_at FROM event_scans", "event_scans")
    return reports.dashboard(scans_, found, t.table("documents").select((F.col("doc_id") % 4).cast("string").alias("repo")))


BOARD_SQL = "SELECT repo, scan || '/' || repo AS id, 'name' || repo AS repo_name, scan AS started_at FROM event_scans"


@query("dashboard_newest", f"SELECT * FROM ({BOARD_SQL}) s ORDER BY id DESC LIMIT 50", ("event_scans",))
def _(t):
    return board(t).newest_scans


@query("dashboard_latest", f"SELECT repo, max(id) AS id, 'name' || repo AS repo_name, max(started_at) AS started_at FROM ({BOARD_SQL}) s GROUP BY repo", ("event_scans",))
def _(t):
    return board(t).latest


@query(
    "dashboard_findings",
    f"SELECT repo, finding, first_seen || '/' || repo AS first_seen, last_seen || '/' || repo AS last_seen, status FROM ({STATE_SQL}) s",
    ("event_scans", "scan_found"),
)
def _(t):
    return board(t).findings.select("repo", "finding", "first_seen", "last_seen", "status")


@query(
    "impact_report",
    """WITH d AS (SELECT CAST(o_custkey % 50 AS STRING) AS repo, o_orderkey AS k, o_orderstatus = 'F' AS changed FROM orders),
            s AS (SELECT DISTINCT d.repo, r.sym, r.o, r.line FROM (SELECT l_orderkey AS o, l_linenumber AS line, l_partkey AS sym FROM lineitem) r JOIN d ON d.k = r.o AND NOT d.changed
                  JOIN d x ON x.repo = d.repo AND x.changed AND x.k = r.sym)
       SELECT repo, count(*) AS n_sites, count(DISTINCT o) AS n_files, count(DISTINCT sym) AS n_symbols FROM s GROUP BY repo""",
)
def _(t):
    d = t.sql("SELECT CAST(o_custkey % 50 AS STRING) AS repo, o_orderkey AS k, o_orderstatus = 'F' AS changed FROM orders")
    file = F.concat(F.lit("f"), F.col("k").cast("string")).alias("file")
    declared = d.select("repo", file, F.concat(F.lit("s"), F.col("k").cast("string")).alias("symbol"))
    lines = t.table("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("symbol"))
    references = lines.join(d.select("k", "repo"), "k").select("repo", file, "line", "symbol")
    return reports.impact(declared, references, d.filter("changed").select("repo", file))


@query(
    "unclaimed_ecosystems",
    """SELECT repo, ecosystem, n, 'no call-site search handles ' || ecosystem || ', so ' || n || ' package(s) were not examined' AS warning FROM (SELECT repo, ecosystem, count(*) AS n
       FROM (SELECT CAST(o_custkey % 50 AS VARCHAR) AS repo, CASE o_orderkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' WHEN 2 THEN 'Go' ELSE 'crates.io' END AS ecosystem FROM orders) x
       WHERE ecosystem IN ('Go', 'crates.io') GROUP BY repo, ecosystem) y""",
)
def _(t):
    rows = t.sql(
        "SELECT CAST(o_custkey % 50 AS STRING) AS repo, CASE o_orderkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' WHEN 2 THEN 'Go' ELSE 'crates.io' END AS ecosystem FROM orders"
    )
    routes = (detectors.Route("typescript", ("npm",), (".ts", ".tsx")), detectors.Route("python", ("PyPI",), (".py",)))
    return detectors.unclaimed_warnings(rows, routes, "call-site search")


def site_tables(t: Tables):
    """The tables of both call-site searches: bindings of parts, and calls of one Python package."""
    refs = t.sql(scans.REFERENCES).withColumn("chain", F.array(F.concat(F.lit("E"), (F.col("k") % 40).cast("string")), F.lit("use"))).drop("k")
    aliases = t.sql("SELECT DISTINCT p_brand AS pkg, 'none' AS spelling, 'none' AS canonical FROM part")
    c = t.sql(scans.PY)
    name = F.concat(F.lit("nm"), F.col("nm").cast("string"))
    calls = c.select("repo", "file", "line", "col", F.when(F.col("form") <= 1, "name").otherwise("attribute").alias("form"), name.alias("name"), F.lit("lib.sub").alias("receiver_module"))
    files = c.select("repo", "file").distinct()
    return {
        "references": refs,
        "bindings": t.sql(scans.BINDINGS),
        "aliases": aliases,
        "calls": calls,
        "names": files.select("repo", "file", F.lit("other").alias("local"), F.lit("lib.a").alias("module"), F.lit("other").alias("exported")),
        "stars": files.select("repo", "file", F.lit("lib").alias("module")),
        "modules": files.select("repo", "file", F.lit("lib.b").alias("module")),
        "roots": c.select(F.lit("lib").alias("pkg"), F.lit("lib").alias("root")).distinct(),
    }


# packages of three ecosystems: brands of two, and one Python package whose symbols are the names that lines call
WANTED = """
SELECT DISTINCT p_brand AS pkg, 'E' || CAST(p_partkey % 50 AS STRING) AS symbol, CASE WHEN length(p_type) % 2 = 0 THEN 'npm' ELSE 'Go' END AS ecosystem FROM part
UNION SELECT 'lib', 'nm' || CAST(l_partkey % 30 AS STRING), 'PyPI' FROM lineitem WHERE l_partkey % 30 % 2 = 0
"""


def resolved(t: Tables):
    return detectors.resolve_sites((detectors.BindingResolver(), detectors.PythonResolver()), t.sql(WANTED), site_tables(t))


@query(
    "resolver_sites",
    f"""WITH r AS (SELECT r.*, b.pkg, b.export FROM ({scans.REFERENCES}) r JOIN ({scans.BINDINGS}) b ON r.repo = b.repo AND r.file = b.file AND r.local = b.local),
             s AS (SELECT repo, pkg, file, line, col, CASE WHEN export = '*' THEN 'E' || CAST(k % 40 AS STRING) ELSE export END AS symbol FROM r)
        SELECT DISTINCT s.repo, s.pkg, s.symbol, s.file, s.line, s.col, 'typescript' AS resolver FROM s JOIN ({WANTED}) w ON w.ecosystem = 'npm' AND w.pkg = s.pkg AND w.symbol = s.symbol
        UNION ALL SELECT DISTINCT repo, 'lib', 'nm' || CAST(nm AS STRING), file, line, col, 'python' FROM ({scans.PY}) c WHERE nm % 2 = 0""",
)
def _(t):
    """Symbols of three ecosystems, routed to the two searches that claim one each."""
    return resolved(t)[0]


@query(
    "resolver_warnings",
    f"""SELECT ecosystem, count(*) AS n, 'no call-site search handles ' || ecosystem || ', so ' || count(*) || ' symbol(s) were not searched' AS warning
        FROM ({WANTED}) w WHERE ecosystem = 'Go' GROUP BY ecosystem""",
)
def _(t):
    return resolved(t)[1]


DETECTED = """
SELECT repo, CASE line % 4 WHEN 0 THEN 'vulnerability' WHEN 1 THEN 'lint' WHEN 2 THEN 'drift' ELSE 'breaking' END AS severity FROM call_sites
"""


@query(
    "scan_counts_detected",
    f"""WITH p AS ({scans.PACKAGE_SQL}), d AS ({DETECTED}),
             g AS (SELECT DISTINCT pkg FROM expected_changes WHERE kind = 'added' AND path NOT LIKE '%.%' AND coalesce(symbol_kind, 'unknown') IN ('function', 'class', 'variable', 'enum', 'unknown')),
             e AS (SELECT repo, severity FROM expected_findings UNION ALL SELECT repo, severity FROM d WHERE severity <> 'drift'
                   UNION ALL SELECT repo, 'freshness' FROM p WHERE status = 'analyzed' AND n_findings = 0
                   UNION ALL SELECT repo, 'feature' FROM scan_dependencies JOIN g ON scan_dependencies.pkg = g.pkg),
             n AS (SELECT repo, count(*) FILTER (WHERE severity = 'breaking') AS breaking, count(*) FILTER (WHERE severity = 'deprecation') AS deprecation,
                     count(*) FILTER (WHERE severity = 'vulnerability') AS vulnerabilities, count(*) FILTER (WHERE severity = 'lint') AS lint,
                     count(*) FILTER (WHERE severity = 'freshness') AS freshness, count(*) FILTER (WHERE severity = 'feature') AS features FROM e GROUP BY repo),
             k AS (SELECT repo, count(*) AS pin_conflicts FROM d WHERE severity = 'drift' GROUP BY repo),
             a AS (SELECT repo, count(*) FILTER (WHERE status = 'analyzed') AS packages_analyzed, count(*) FILTER (WHERE status <> 'analyzed') AS packages_skipped, CAST(sum(n_sites) AS BIGINT) AS call_sites
                   FROM p GROUP BY repo)
        SELECT a.repo, packages_analyzed, packages_skipped, coalesce(breaking, 0) AS breaking, coalesce(deprecation, 0) AS deprecation, coalesce(vulnerabilities, 0) AS vulnerabilities,
               coalesce(lint, 0) AS lint, coalesce(freshness, 0) AS freshness, coalesce(features, 0) AS features, call_sites, coalesce(pin_conflicts, 0) AS pin_conflicts
        FROM a LEFT JOIN n ON a.repo = n.repo LEFT JOIN k ON a.repo = k.repo""",
    (*scans.PACKAGE_VIEWS, "call_sites", "expected_changes"),
)
def _(t):
    """A scan that counts what detectors found along with its own findings, in all seven classes."""
    return scans.report(t, detected=t.sql(DETECTED, "call_sites")).counts


@query(
    "vulnerability_detector",
    f"SELECT repo, 'vulnerability' AS severity, name AS pkg, guidance, 'vulnerability' AS detector FROM ({REPORT_SQL}) r",
    ("installed", "expected_vulnerable", "imports", "advisory_rows"),
)
def _(t):
    installed = t.view("installed")
    tables = {
        "installed": installed, "windows": windows(t), "names": advisories.advisory_names(records(t)), "facts": facts(t),
        "imports": t.view("imports").select("repo", "pkg"), "locks": installed.select("repo", "name", "version", "line"),
    }
    run = detectors.run_detectors([detectors.VulnerabilityDetector(("npm",))], tables)
    return run.findings.select("repo", "severity", "pkg", "guidance", "detector")


# the language at the head of a page's path is an endpoint, whose description differs between two versions by language
LANGUAGE = "regexp_extract(path, '^/([a-z]+)/[0-9]+', 1)"
LANGUAGE_CALLS = f"""
SELECT repo, 'f' || CAST(k AS STRING) AS file, 1 AS line, host, 'GET' AS method,
       CASE WHEN k % 2 = 0 THEN '/' || {LANGUAGE} || '/{{id}}' ELSE regexp_extract(path, '^(/[a-z]+/[0-9]+)', 1) END AS route, {LANGUAGE} AS lang, k % 2 = 0 AS templated
FROM page_urls WHERE {LANGUAGE} <> ''
"""
SINCE_SQL = f"""
WITH c AS ({LANGUAGE_CALLS}), h AS (SELECT repo, host, lang, count(*) AS n_sites, bool_or(templated) AS templated FROM c GROUP BY repo, host, lang)
SELECT repo, host, 'GET /' || lang || '/{{id}}' || CASE lang WHEN 'en' THEN ' query:page' WHEN 'fr' THEN ' query:token' ELSE '' END AS change_path,
       CASE lang WHEN 'en' THEN 'added' WHEN 'fr' THEN 'signature-changed' WHEN 'de' THEN 'deprecated' ELSE 'removed' END AS kind,
       CASE lang WHEN 'en' THEN 'feature' WHEN 'de' THEN 'deprecation' ELSE 'breaking' END AS severity, n_sites FROM h
WHERE lang IN ('en', 'fr', 'de', 'es') AND (lang <> 'es' OR NOT templated OR NOT EXISTS (SELECT 1 FROM h x WHERE x.repo = h.repo AND x.host = h.host AND x.lang <> 'es'))
"""


def language_descriptions(t: Tables):
    """Per host, the description before and now: a parameter more, a required one, a deprecation, a longer route."""
    ops = t.sql(f"SELECT DISTINCT host, lang FROM ({LANGUAGE_CALLS}) c", "page_urls")
    route = F.concat(F.lit('"/'), "lang", F.lit('/{id}":{"get":{'))

    def parameter(name, required):
        return f'"parameters":[{{"name":"{name}","in":"query","required":{required},"schema":{{"type":"string"}}}}]}}}}'

    old = F.concat(route, F.lit("}}"))
    new = (
        F.when(F.col("lang") == "en", F.concat(route, F.lit(parameter("page", "false"))))
        .when(F.col("lang") == "fr", F.concat(route, F.lit(parameter("token", "true"))))
        .when(F.col("lang") == "de", F.concat(route, F.lit('"deprecated":true}}')))
        .when(F.col("lang") == "es", F.lit('"/es/{id}/more":{"get":{}}'))
        .otherwise(old)
    )

    def body(item):
        return F.concat(F.lit('{"openapi":"3.0.0","paths":{'), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("}}"))

    return ops.groupBy(F.col("host").alias("vendor")).agg(body(old).alias("before"), body(new).alias("body"))


@query("contract_since", SINCE_SQL, ("page_urls",))
def _(t):
    """What changed between two versions of a description and touches a call, less what is already reported as gone."""
    c = t.sql(LANGUAGE_CALLS, "page_urls").drop("lang", "templated")
    calls = c.withColumns({"params": F.array().cast("array<string>"), "resolved": F.lit(True), "col": F.lit(1), "text": F.lit("t"), "reason": F.lit(None).cast("string")})
    both = language_descriptions(t)
    candidates = both.select(
        "vendor", F.lit(1).alias("seq"), F.concat(F.lit("https://"), "vendor").alias("url"), F.lit("official-domain").alias("provenance"),
        F.lit(None).cast("string").alias("updated_at"), "body",
    )
    previous = both.select("vendor", F.col("before").alias("body"))
    hits = contract_plan.check(calls, candidates, F.lit("2024-06-01").cast("timestamp"), previous).hits
    return hits.select("repo", "host", "change_path", "kind", "severity", "n_sites")


class _SplitDetector:
    def __init__(self, detector_id: str, *flags: str):
        self.detector_id, self.flags = detector_id, flags

    def detect(self, tables):
        lines = tables["lines"].filter(F.col("l_returnflag").isin(*self.flags))
        return lines.select("repo", F.col("l_orderkey").alias("subject")), lines.select("repo").distinct()


class _BrokenDetector:
    detector_id = "broken"

    def detect(self, tables):
        raise RuntimeError("its database could not be reached")


@query(
    "detector_run",
    """SELECT detector, n, reason FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'first' ELSE 'second' END AS detector, count(*) AS n, CAST(NULL AS VARCHAR) AS reason FROM lineitem GROUP BY 1
       UNION ALL SELECT 'broken', 0, 'its database could not be reached') x""",
)
def _(t):
    """Two detectors and one that fails: its failure is a row, the others report."""
    lines = t.table("lineitem").select(F.col("l_suppkey").cast("string").alias("repo"), "l_orderkey", "l_returnflag")
    run = detectors.run_detectors([_SplitDetector("first", "A"), _BrokenDetector(), _SplitDetector("second", "N", "R")], {"lines": lines})
    counted = run.findings.groupBy("detector").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit(None).cast("string"))
    failed = t.spark.createDataFrame([(d, 0, r) for d, r in run.failures], "detector string, n bigint, reason string")
    return counted.unionByName(failed)


@query(
    "derived_finding_ids",
    """SELECT pkg, substr(sha256('feature|' || pkg || '|' || from_version || '|' || to_version), 1, 12) AS feature_id, substr(sha256('freshness|' || pkg || '|' || from_version || '|' || to_version), 1, 12) AS freshness_id,
              substr(sha256('http-drift|' || pkg || '|GET /x|removed'), 1, 12) AS drift_id FROM surface_headers""",
    ("surface_headers",),
)
def _(t):
    pkg, a, b = F.col("pkg"), F.col("from_version"), F.col("to_version")
    return t.view("surface_headers").select(
        "pkg", ids.tagged_id("feature", pkg, a, b).alias("feature_id"), ids.tagged_id("freshness", pkg, a, b).alias("freshness_id"),
        ids.tagged_id("http-drift", pkg, F.lit("GET /x"), F.lit("removed")).alias("drift_id"),
    )


def repository_files(t: Tables):
    """Repositories with one or two JavaScript lockfiles, and a Python lockfile or requirements."""
    n = F.col("repo").cast("bigint")
    c, name, version = readers.c, readers.name, readers.version
    kinds = {
        "package-lock.json": (n % 3 == 0, readers.npm_entry, *readers.NPM_TEXT),
        "yarn.lock": (n % 3 != 1, readers.yarn_block, readers.YARN_HEAD),
        "pnpm-lock.yaml": (n % 3 == 1, lambda of: c("  ", name(of), "@", version(of), ":\n"), "packages:\n"),
        "uv.lock": (n % 2 == 0, lambda of: c('[[package]]\nname = "', name(of), '"\nversion = "', version(of), '"\n')),
        "requirements.txt": (n % 4 != 0, lambda of: c(name(of), "==", version(of), "\n"), "-r more.txt\n"),
    }
    return readers.file_texts(t, {**kinds, "more.txt": (n % 4 != 0, lambda of: F.lit(""), "extra==1.0\n")})


@query(
    "ecosystem_inventories",
    f"""SELECT DISTINCT repo, ecosystem, name, version, file FROM (
          SELECT repo, o, 'npm' AS ecosystem, CASE WHEN k % 10 = 7 THEN 'alias-' || name ELSE CASE WHEN k % 4 = 1 THEN '@s/' ELSE '' END || name || '-' || n END AS name, version, 'package-lock.json' AS file
            FROM lock_entries WHERE o % 3 = 0 AND k % 10 NOT IN (3, 5)
          UNION ALL SELECT repo, o, 'npm', x.name, arg_min(version, n), 'yarn.lock' FROM (SELECT repo, o, unnest(['@s/' || name, name]) AS name, version, n FROM lock_entries WHERE o % 3 = 2) x GROUP BY repo, o, x.name
          UNION ALL SELECT repo, o, 'npm', name, arg_min(version, n), 'pnpm-lock.yaml' FROM lock_entries WHERE o % 3 = 1 GROUP BY repo, o, name
          UNION ALL SELECT repo, o, 'PyPI', name, arg_min(version, n), CASE WHEN o % 2 = 0 THEN 'uv.lock' ELSE 'requirements.txt' END FROM lock_entries GROUP BY repo, o, name
          UNION ALL SELECT DISTINCT repo, o, 'PyPI', 'extra', '1.0', 'requirements.txt' FROM lock_entries WHERE o % 2 = 1) z""",
    ("lock_entries",),
)
def _(t):
    return ecosystems.installed(repository_files(t))


@query(
    "lintable_files",
    "SELECT repo, file, tool FROM (SELECT repo, CASE k % 4 WHEN 0 THEN 'a/Dockerfile.' || name WHEN 1 THEN name || '.sh' WHEN 2 THEN name || '.ts' ELSE 'Dockerfile/' || name END AS file, CASE k % 4 WHEN 0 THEN 'hadolint' WHEN 1 THEN 'shellcheck' END AS tool FROM lock_entries) x WHERE tool IS NOT NULL",
    ("lock_entries",),
)
def _(t):
    k = readers.key() % 4
    file = F.when(k == 0, F.concat(F.lit("a/Dockerfile."), "name")).when(k == 1, F.concat("name", F.lit(".sh"))).when(k == 2, F.concat("name", F.lit(".ts"))).otherwise(F.concat(F.lit("Dockerfile/"), "name"))
    return detectors.lintable(t.view("lock_entries").select("repo", file.alias("file")))


@query(
    "detector_findings",
    f"""SELECT detector, severity, count(*) AS n, count(DISTINCT repo) AS n_repos FROM (
          SELECT 'version-pin' AS detector, 'drift' AS severity, repo FROM ({NODE_SQL}) n
          UNION ALL SELECT 'version-pin', 'drift', repo FROM ({PIN_SQL}) p WHERE kind = 'docker-image' AND version <> '2.1' AND subject <> 'standard'
          UNION ALL SELECT 'external-lint', 'lint', repo FROM lock_entries) x GROUP BY ALL""",
    ("pin_rows", "lock_entries"),
)
def _(t):
    """The pin and lint detectors over one set of tables."""
    shell = readers.c('{"file":"', readers.name(), '.sh","line":', F.col("n"), ',"code":', readers.key(), "}")
    lint = readers.joined(t, shell, '{"comments":[', "]}", ",").withColumn("tool", F.lit("shellcheck"))
    tables = {"files": pin_files(t), "dependencies": image_versions(t).withColumn("source", F.lit("lockfile")), "lint_reports": lint}
    run = detectors.run_detectors([detectors.PinDetector(), detectors.LintDetector()], tables)
    return run.findings.groupBy("detector", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("repo").alias("n_repos"))
