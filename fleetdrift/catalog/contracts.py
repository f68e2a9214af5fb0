"""HTTP contract queries: calls, descriptions, pins of wire versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import contracts, pinning
from ..sources import apispecs, httpcalls, pins
from . import Tables, query

# What the check does instead of shape keys: a pattern per pair, tried on every pair of a host.
MATCH_SQL = """
SELECT c.host, c.method, c.route AS call_route, d.route FROM (SELECT DISTINCT host, method, route FROM page_calls) c
JOIN (SELECT o.*, NOT EXISTS (SELECT 1 FROM page_operations x WHERE x.host = o.host AND starts_with(x.route, o.route || '/')) AS spans FROM page_operations o) d
  ON c.host = d.host AND c.method = d.method
WHERE regexp_full_match(d.route, array_to_string(list_transform(string_split(c.route, '/'), lambda s:
        CASE WHEN s = '{}' THEN '[{][^/]*[}](/[{][^/]*[}])*' WHEN s = '' THEN '(|[{][^/]*[}])' ELSE '(' || replace(s, '.', '[.]') || '|[{][^/]*[}])' END), '/'))
   OR (d.spans AND position('{}' IN c.route) = 0 AND regexp_full_match(d.route, '.*/[{][^/]*[}]')
       AND regexp_full_match(c.route, regexp_replace(replace(regexp_replace(d.route, '[{][^/]*[}]$', '@'), '.', '[.]'), '[{][^/]*[}]', '[^/]*', 'g').replace('@', '.*')))
   OR (d.spans AND position('{}' IN c.route) > 0 AND regexp_full_match(d.route, '.*/[{][^/]*[}]')
       AND regexp_full_match(c.route, regexp_replace(replace(regexp_replace(d.route, '[{][^/]*[}]$', '@'), '.', '[.]'), '[{][^/]*[}](/[{][^/]*[}])*', '([{][}]|[^/{}]*)', 'g').replace('@', '[^/{}]+(/.*)?')))
"""
CALL_VIEWS = ("page_calls", "page_operations")


def calls(t: Tables):
    return t.view("page_calls").drop("k")


def described(t: Tables):
    ops = t.view("page_operations")
    bases = ops.select("host").distinct().withColumn("base", F.lit(""))
    return contracts.described_endpoints(ops, bases, ["host"])


@query("route_matches", MATCH_SQL, CALL_VIEWS)
def _(t):
    return contracts.match_routes(calls(t), described(t), ["host"])


@query(
    "route_spans",
    """SELECT o.host, o.route, NOT EXISTS (SELECT 1 FROM page_operations x WHERE x.host = o.host AND starts_with(x.route, o.route || '/')) AS spans
       FROM (SELECT DISTINCT host, route FROM page_operations) o""",
    ("page_operations",),
)
def _(t):
    return contracts.spanning_routes(t.view("page_operations"), ["host"])


CHECK_SQL = f"""
WITH m AS (SELECT DISTINCT host, method, call_route FROM ({MATCH_SQL}) x),
     c AS (SELECT p.*, m.host IS NOT NULL AS matched, '/' || string_split(p.route, '/')[2] AS top FROM page_calls p
           LEFT JOIN m ON p.host = m.host AND p.method = m.method AND p.route = m.call_route),
     a AS (SELECT repo, host, bool_or(matched) AS aligned FROM c GROUP BY ALL),
     tops AS (SELECT DISTINCT host, '/' || string_split(route, '/')[2] AS top FROM page_operations)
SELECT c.repo, c.host, c.method, c.route, c.top, CASE WHEN matched THEN 'matched' WHEN NOT a.aligned THEN 'not-aligned' WHEN tops.top IS NOT NULL THEN 'gone'
       ELSE 'uncovered' END AS outcome
FROM c JOIN a ON c.repo = a.repo AND c.host = a.host LEFT JOIN tops ON c.host = tops.host AND c.top = tops.top
"""


@query("contract_outcomes", CHECK_SQL, CALL_VIEWS)
def _(t):
    return contracts.check_calls(calls(t), described(t))


@query(
    "contract_summary",
    f"""SELECT x.repo, x.host, count(*) FILTER (WHERE outcome = 'matched') AS n_matched, count(*) FILTER (WHERE outcome = 'gone') AS n_gone,
               count(*) FILTER (WHERE outcome = 'uncovered') AS n_uncovered, count(*) FILTER (WHERE outcome = 'not-aligned') AS n_not_aligned,
               count(*) FILTER (WHERE outcome = 'no-description') AS n_no_description,
               count(DISTINCT CASE WHEN outcome = 'uncovered' THEN top END) AS n_uncovered_segments,
               any_value(u.n) AS n_unresolved
        FROM ({CHECK_SQL}) x JOIN (SELECT repo, count(*) FILTER (WHERE route LIKE '%{{}}%') AS n FROM page_calls GROUP BY repo) u ON x.repo = u.repo GROUP BY x.repo, x.host""",
    CALL_VIEWS,
)
def _(t):
    c = calls(t)
    every = c.withColumn("resolved", ~F.col("route").contains("{}"))
    return contracts.contract_summary(contracts.check_calls(c, described(t)), every)


@query("contract_uncovered_segments", f"SELECT DISTINCT repo, host, top FROM ({CHECK_SQL}) x WHERE outcome = 'uncovered'", CALL_VIEWS)
def _(t):
    return contracts.uncovered_segments(contracts.check_calls(calls(t), described(t)))


@query(
    "contract_gone_findings",
    f"""SELECT repo, host, method, route, substr(sha256('http-contract|' || host || '|' || method || '|' || route), 1, 12) AS finding_id
        FROM ({CHECK_SQL}) x WHERE outcome = 'gone'""",
    CALL_VIEWS,
)
def _(t):
    return contracts.gone_findings(contracts.check_calls(calls(t), described(t))).select("repo", "host", "method", "route", "finding_id")


PAGE_CHANGES = """
SELECT host, method || ' ' || route AS path, 'removed' AS kind, 'breaking' AS severity FROM page_operations
UNION ALL SELECT host, method || ' ' || route || ' query:page', 'added', 'feature' FROM page_operations
UNION ALL SELECT host, method || ' ' || route || ' query:expand', 'added', 'feature' FROM page_operations
"""
HITS_SQL = f"""
WITH m AS (SELECT * FROM ({MATCH_SQL}) x), ch AS (SELECT o.host, o.method, o.route, c.path, c.kind, c.severity FROM ({PAGE_CHANGES}) c
           JOIN page_operations o ON c.host = o.host AND starts_with(c.path || ' ', o.method || ' ' || o.route || ' '))
SELECT p.repo, p.host, ch.path AS change_path, ch.kind, ch.severity, count(*) AS n_sites FROM ch JOIN m ON ch.host = m.host AND ch.method = m.method AND ch.route = m.route
JOIN page_calls p ON p.host = m.host AND p.method = m.method AND p.route = m.call_route
WHERE NOT (ch.path LIKE '% query:page' AND p.k % 2 = 0) GROUP BY ALL
"""


def change_hits(t: Tables):
    c = t.view("page_calls").withColumn("params", F.when(F.col("k") % 2 == 0, F.array(F.lit("page"))).otherwise(F.array().cast("array<string>")))
    ends = described(t).select("host", "route", F.col("route").alias("full"), "spans").distinct()
    return contracts.match_changes(c, t.sql(PAGE_CHANGES, "page_operations"), ends)


@query("contract_change_hits", HITS_SQL, CALL_VIEWS)
def _(t):
    return change_hits(t)


@query(
    "contract_offered_parameters",
    f"""SELECT repo, host, change_path, n_sites, CASE WHEN change_path LIKE '%:page' THEN 'paging' ELSE 'capability' END AS "group"
        FROM ({HITS_SQL}) h WHERE severity = 'feature'""",
    CALL_VIEWS,
)
def _(t):
    return contracts.offered_parameters(change_hits(t)).select("repo", "host", "change_path", "n_sites", "group")


@query(
    "contract_hits_not_reported",
    f"""SELECT repo, host, change_path, kind FROM ({HITS_SQL}) h WHERE NOT EXISTS (SELECT 1 FROM page_calls p WHERE p.repo = h.repo AND p.host = h.host
          AND p.k % 3 = 0 AND p.method || ' ' || regexp_replace(p.route, '[0-9]+', '{{id}}') = h.change_path)""",
    CALL_VIEWS,
)
def _(t):
    gone = t.view("page_calls").filter("k % 3 = 0").select("repo", "host", "method", F.regexp_replace("route", "^([^0-9]*)[0-9]+", "$1{id}").alias("route"))
    return contracts.not_reported(change_hits(t), gone).select("repo", "host", "change_path", "kind")


@query("distinct_hosts", "SELECT DISTINCT repo, host FROM page_calls", CALL_VIEWS)
def _(t):
    return calls(t).select("repo", "host").distinct()


@query(
    "host_budget",
    """SELECT repo, count(*) AS n_present, greatest(count(*) - 8, 0) AS n_unchecked FROM (SELECT DISTINCT repo, host FROM page_calls) x GROUP BY repo""",
    CALL_VIEWS,
)
def _(t):
    from ..operators.inventory import over_budget

    return over_budget(calls(t).select("repo", "host").distinct(), ["repo"], 8)


# --- call extraction --------------------------------------------------------------------------------------------

CLEAN_QUERY = "CASE WHEN query = '' THEN '' ELSE '?' || query END"


def call_files(t: Tables):
    """One source file per page: imports, constants, and one call in one of seven spellings on line 4."""
    p = t.view("page_urls")
    full = F.concat(F.lit("https://"), "host", "path", F.when(F.col("query") == "", "").otherwise(F.concat(F.lit("?"), "query")))
    k = F.col("k") % 7
    lit = F.lit
    call = (
        F.when(k == 0, F.concat(lit('  const r = await fetch("'), full, lit('", { method: "PUT" });')))
        .when(k == 1, F.concat(lit("  axios.post(`https://"), "host", "path", lit("/${item.id}?expand=${x}`);")))
        .when(k == 2, lit("  got(endpoint);"))
        .when(k == 3, F.concat(lit("  send({ url: '"), full, lit("', method: Method.Patch, params: { limit, cursor: c } });")))
        .when(k == 4, lit("  ky.get(`${host}/v1/things`);"))
        .when(k == 5, lit('  fetch("/local/api");'))
        .otherwise(F.concat(lit("  fetch(`${BASE}"), "path", lit("/${id}`);")))
    )
    content = F.concat(
        lit('import { ROOT as BASE } from "./config";\nimport x from "y";\nexport async function f() {\n'), call, lit("\n}\nconst s = "), F.col("k").cast("string"), lit(";\n")
    )
    main = p.select("repo", F.concat(lit("src/p"), F.col("k").cast("string"), lit(".ts")).alias("file"), content.alias("content"))
    shared = p.select("repo").distinct().select(
        "repo", lit("src/config.ts").alias("file"), F.concat(lit('export const ROOT = "https://api.'), "repo", lit('.example.com/v2";\nexport const OTHER = "x";\n')).alias("content")
    )
    return main.unionByName(shared)


@query(
    "http_calls",
    f"""SELECT repo, 'src/p' || CAST(k AS STRING) || '.ts' AS file, 4 AS line, CASE k % 7 WHEN 0 THEN 19 ELSE 3 END AS col,
              CASE k % 7 WHEN 0 THEN 'PUT' WHEN 1 THEN 'POST' WHEN 3 THEN 'PATCH' ELSE 'GET' END AS method, k % 7 IN (0, 1, 3, 6) AS resolved,
              CASE WHEN k % 7 IN (0, 1, 3) THEN host WHEN k % 7 = 6 THEN 'api.' || repo || '.example.com' END AS host,
              CASE k % 7 WHEN 0 THEN path WHEN 3 THEN path WHEN 1 THEN replace(path || '/{{}}', '//', '/') WHEN 6 THEN replace('/v2' || path || '/{{}}', '//', '/') END AS route,
              CASE WHEN k % 7 = 0 THEN names WHEN k % 7 = 1 THEN 'expand' WHEN k % 7 = 3 THEN concat_ws(',', nullif(names, ''), 'limit,cursor') ELSE '' END AS params,
              CASE k % 7 WHEN 2 THEN 'the URL is not a literal, so it cannot be read without running the code'
                WHEN 4 THEN 'the host is substituted at runtime, so which API this reaches is unknown'
                WHEN 5 THEN 'the URL is relative, so it reaches this application’s own server rather than a vendor' END AS reason
       FROM (SELECT *, array_to_string(list_transform(list_filter(string_split(query, '&'), lambda s: s <> ''), lambda s: string_split(s, '=')[1]), ',') AS names FROM page_urls) u""",
    ("page_urls",),
)
def _(t):
    return httpcalls.http_calls(call_files(t)).drop("text").withColumn("params", F.array_join("params", ","))


@query(
    "unresolved_calls",
    "SELECT repo, count(*) FILTER (WHERE k % 7 IN (2, 4, 5)) AS n_unresolved, count(*) AS n FROM page_urls GROUP BY repo",
    ("page_urls",),
)
def _(t):
    return httpcalls.http_calls(call_files(t)).groupBy("repo").agg(F.count_if(~F.col("resolved")).alias("n_unresolved"), F.count(F.lit(1)).alias("n"))


@query(
    "unambiguous_constants",
    """SELECT repo, name, min(value) AS value FROM (SELECT CAST(o_custkey % 50 AS STRING) AS repo, 'C' || CAST(o_orderkey % 997 AS STRING) AS name, o_orderstatus AS value FROM orders) x
       GROUP BY ALL HAVING count(DISTINCT value) = 1""",
)
def _(t):
    rows = t.sql("SELECT CAST(o_custkey % 50 AS STRING) AS repo, 'C' || CAST(o_orderkey % 997 AS STRING) AS name, o_orderstatus AS value FROM orders")
    return httpcalls.unambiguous(rows, ["repo", "name"])


@query(
    "url_parts",
    """SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS route,
              array_to_string(list_transform(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda s: s <> ''), lambda s: string_split(s, '=')[1]), ',') AS params,
              '/' || string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/')[2] AS top,
              array_to_string(list_slice(string_split(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '.'), -2, -1), '.') AS domain,
              string_split(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '.')[-2] AS vendor
       FROM pages""",
)
def _(t):
    read = urls.read_url(F.col("url"))
    return t.table("pages").select(
        "page_id",
        read["host"].alias("host"),
        read["route"].alias("route"),
        F.array_join(read["params"], ",").alias("params"),
        urls.top_segment(read["route"]).alias("top"),
        urls.registrable_domain(read["host"]).alias("domain"),
        F.lower(urls.vendor_label(F.col("url"))).alias("vendor"),
    )


# --- descriptions -----------------------------------------------------------------------------------------------


def spec_bodies(t: Tables, side: str):
    """One JSON description per vendor; parameters of one nation in three stand behind references."""
    p = t.view(f"op_params_{side}")
    lit = F.lit
    schema = F.when(F.col("type") != "unknown", F.concat(lit(',"schema":{"type":"'), "type", lit('"}'))).otherwise("")
    where = F.when(F.col("location") == "query", "").otherwise(F.concat(lit(',"in":"'), "location", lit('"')))
    inline = F.concat(lit('{"name":"'), "name", lit('"'), where, F.when(F.col("required"), lit(',"required":true')).otherwise(""), schema, lit("}"))
    key = F.concat(F.translate("route", "/", "_"), F.col("name"))
    by_ref = F.length("route") % 3 == 0
    entry = F.when(by_ref, F.concat(lit('{"$ref":"#/components/parameters/'), key, lit('"}'))).otherwise(inline)
    hop = F.concat(lit('"'), key, lit('":{"$ref":"#/components/parameters/x~1'), key, lit('"},"x/'), key, lit('":'), inline)
    ops = p.groupBy("vendor", "route", "deprecated").agg(
        F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("params"), F.array_join(F.array_sort(F.collect_list(F.when(by_ref, hop))), ",").alias("shared")
    )
    item = F.concat(
        lit('"'), "route", lit('":{"summary":"s","get":{"parameters":['), "params", lit("]"), F.when(F.col("deprecated"), lit(',"deprecated":true')).otherwise(""), lit("}}")
    )
    docs = ops.groupBy("vendor").agg(
        F.array_join(F.array_sort(F.collect_list(item)), ",").alias("paths"), F.array_join(F.array_sort(F.collect_list(F.nullif("shared", lit("")))), ",").alias("shared")
    )
    body = F.concat(
        lit('{"openapi":"3.0.0","servers":[{"url":"https://h.example.com/base/"},{"url":"/alt"}],"paths":{'), "paths", lit('},"components":{"parameters":{'), "shared", lit("}}}")
    )
    return docs.select("vendor", body.alias("body"))


def spec_tables(t: Tables, side: str):
    read = apispecs.read_operations(spec_bodies(t, side), ["vendor"])
    return apispecs.operations(read, ["vendor"]), apispecs.operation_params(read, ["vendor"])


@query(
    "spec_operations",
    "SELECT DISTINCT vendor, method, route, deprecated FROM op_params_to",
    ("op_params_to",),
)
def _(t):
    return spec_tables(t, "to")[0]


@query("spec_params", "SELECT DISTINCT vendor, method, route, name, location, required, type FROM op_params_to", ("op_params_to",))
def _(t):
    return spec_tables(t, "to")[1]


@query("spec_diff", "SELECT * FROM expected_spec_changes", ("expected_spec_changes",))
def _(t):
    (a, pa), (b, pb) = spec_tables(t, "from"), spec_tables(t, "to")
    return contracts.diff_specs(a, b, pa, pb)


@query("spec_base_paths", "SELECT vendor, unnest(['', '/base', '/alt']) AS base FROM (SELECT DISTINCT vendor FROM spec_params) v", ("spec_params",))
def _(t):
    return apispecs.read_bases(spec_bodies(t, "to"), ["vendor"])


@query(
    "spec_readable",
    """SELECT k, (k % 5 IN (0, 1)) AS readable FROM api_parts""",
    ("api_parts",),
)
def _(t):
    k = F.col("k") % 5
    body = (
        F.when(k == 0, F.concat(F.lit('{"openapi":"3.1.0","info":{"title":"'), "leaf", F.lit('"},"paths":{}}')))
        .when(k == 1, F.concat(F.lit('  {"swagger":"2.0","paths":{"/'), "leaf", F.lit('":{}}}')))
        .when(k == 2, F.concat(F.lit('{"paths":{"/'), "leaf", F.lit('":{}}}')))
        .when(k == 3, F.concat(F.lit('{"openapi":"3.0.0","x":"'), "leaf", F.lit('"}')))
        .otherwise(F.concat(F.lit('{"openapi":"3.0.0","paths":{'), "leaf"))
    )
    return t.view("api_parts").select("k", apispecs.is_spec(body).alias("readable"))


@query(
    "spec_diff_headers",
    """SELECT vendor, v % 3 <> 0 AS unanalyzable, CASE v % 3 WHEN 1 THEN 'the previous description could not be read as OpenAPI or Swagger'
              WHEN 2 THEN 'the current description could not be read as OpenAPI or Swagger' END AS note FROM (SELECT DISTINCT vendor, CAST(vendor AS INT) AS v FROM spec_params) x""",
    ("spec_params",),
)
def _(t):
    v = F.col("vendor").cast("int") % 3
    before = spec_bodies(t, "from").select("vendor", F.when(v == 1, F.lit("<html>")).otherwise(F.col("body")).alias("before"))
    after = spec_bodies(t, "to").select("vendor", F.when(v == 2, F.lit("")).otherwise(F.col("body")).alias("after"))
    both = before.join(after, "vendor").select("vendor", apispecs.is_spec(F.col("before")).alias("before_ok"), apispecs.is_spec(F.col("after")).alias("after_ok"))
    return contracts.spec_headers(both)


@query(
    "spec_manifest_urls",
    """SELECT s_suppkey AS k, u AS url FROM supplier, (VALUES ('/openapi.json'), ('/swagger.json'), ('/apis-spec')) x(p), LATERAL (SELECT 'https://' || s_name || p AS u) y
       WHERE s_suppkey % 4 <> 0""",
)
def _(t):
    def prop(kind, tail):
        return F.struct(F.lit(kind).alias("type"), F.concat(F.lit("https://"), "s_name", F.lit(tail)).alias("url"))

    def api(*props):
        return F.struct(F.lit("a").alias("name"), F.array(*props).alias("properties"))

    doc = F.struct(F.array(api(prop("OpenAPI", "/openapi.json"), prop("docs", "/docs")), api(prop("x-openapi", "/swagger.json"), prop("apis-spec", "/apis-spec"))).alias("apis"))
    body = F.when(F.col("s_suppkey") % 4 == 0, F.lit("not json")).otherwise(F.to_json(doc))
    return apispecs.spec_urls(t.table("supplier").select(F.col("s_suppkey").alias("k"), body.alias("body"))).select("k", "url")


CANDIDATES = """
SELECT CAST(s_nationkey AS STRING) AS vendor, s_suppkey AS seq, CASE s_suppkey % 8 WHEN 0 THEN 'official-domain' WHEN 1 THEN 'official-github' WHEN 2 THEN 'directory'
         WHEN 3 THEN 'verified-swaggerhub' WHEN 4 THEN 'verified-postman' WHEN 5 THEN 'curated' WHEN 6 THEN 'community' ELSE 'extracted-from-docs' END AS provenance,
       'https://v' || CAST(s_suppkey AS STRING) || '.example.com/openapi.json' AS url,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN 'last tuesday' WHEN s_suppkey % 5 = 2 THEN '2023-02-01T00:00:00Z' ELSE '2024-03-10T00:00:00Z' END AS updated_at
FROM supplier
"""
RANK_SQL = "CASE s % 8 WHEN 0 THEN 100 WHEN 1 THEN 95 WHEN 2 THEN 92 WHEN 3 THEN 90 WHEN 4 THEN 85 WHEN 5 THEN 75 WHEN 6 THEN 50 ELSE 30 END"


@query(
    "best_description",
    f"""SELECT vendor, seq, provenance FROM (SELECT vendor, seq, provenance, row_number() OVER (PARTITION BY vendor ORDER BY {RANK_SQL.replace('s %', 'seq %')} DESC, seq) AS n
        FROM ({CANDIDATES}) c) x WHERE n = 1""",
)
def _(t):
    return contracts.best_descriptions(t.sql(CANDIDATES)).select("vendor", "seq", "provenance")


@query("ranked_descriptions", f"SELECT vendor, seq, {RANK_SQL.replace('s %', 'seq %')} AS rank FROM ({CANDIDATES}) c")
def _(t):
    return contracts.ranked_descriptions(t.sql(CANDIDATES)).select("vendor", "seq", "rank")


NOW = "2024-06-01 00:00:00"
ASSERT_SQL = "(seq % 8 = 0 OR (seq % 8 IN (1, 3) AND seq % 5 IN (3, 4)))"


@query("authoritative_descriptions", f"SELECT seq, {ASSERT_SQL} AS authoritative FROM ({CANDIDATES}) c")
def _(t):
    now = F.lit(NOW).cast("timestamp")
    return t.sql(CANDIDATES).select("seq", urls.can_assert_breakage(F.col("provenance"), F.col("updated_at"), now).alias("authoritative"))


@query(
    "describe_provenance",
    f"""SELECT seq, url || ' — ' || provenance || ' (' || {RANK_SQL.replace('s %', 'seq %')} || '/100): ' || CASE WHEN seq % 8 NOT IN (0, 1, 3) THEN 'a third-party copy, so a mismatch is a lead and not a finding'
            WHEN seq % 8 = 0 THEN 'provider-controlled and served from their own origin, so a mismatch is evidence'
            WHEN seq % 5 IN (0, 1) THEN 'provider-controlled, but when they last changed it could not be established, so a mismatch is a lead and not a finding'
            WHEN seq % 5 = 2 THEN 'provider-controlled but last changed 486 day(s) ago, so it is not evidence about today''s API'
            ELSE 'provider-controlled and last changed 83 day(s) ago, so a mismatch is evidence' END AS text FROM ({CANDIDATES}) c""",
)
def _(t):
    now = F.lit(NOW).cast("timestamp")
    c = t.sql(CANDIDATES)
    return c.select("seq", urls.describe_provenance(F.col("url"), F.col("provenance"), F.col("updated_at"), now).alias("text"))


@query(
    "pointer_provenance",
    """SELECT k, CASE k % 5 WHEN 0 THEN 'official-domain' WHEN 1 THEN 'official-domain' WHEN 2 THEN 'official-github' ELSE 'directory' END AS provenance, k % 5 IN (0, 1) AS claims FROM page_urls""",
    ("page_urls",),
)
def _(t):
    p = t.view("page_urls")
    domain = urls.registrable_domain(F.col("host"))
    k = F.col("k") % 5
    url = (
        F.when(k == 0, F.concat(F.lit("https://docs."), "host", "path"))
        .when(k == 1, F.concat(F.lit("https://"), F.upper(domain), F.lit("/x")))
        .when(k == 2, F.lit("https://raw.githubusercontent.com/Org-X/repo/openapi.json"))
        .when(k == 3, F.lit("https://github.com/someone/else"))
        .otherwise(F.lit("not a url"))
    )
    return p.select(
        "k", urls.provenance_of_pointer(url, domain, F.lit("org-x")).alias("provenance"), urls.claims_vendor(F.when(k <= 1, url).otherwise(F.lit("https://nobody.dev")), domain).alias("claims")
    )


@query(
    "links_back",
    """SELECT k, k % 3 = 0 AS links FROM page_urls""",
    ("page_urls",),
)
def _(t):
    domain = urls.registrable_domain(F.col("host"))
    values = F.array(F.lit("text"), F.lit("https://elsewhere.dev/"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("http://www."), "host")).otherwise(F.concat(F.lit("https://not"), domain)))
    return t.view("page_urls").select("k", urls.links_back(values, domain).alias("links"))


@query(
    "host_organisations",
    """SELECT DISTINCT host, CASE WHEN host LIKE '%.example.com' THEN 'com-org' WHEN host LIKE '%.example.net' THEN 'net-org' END AS org FROM page_urls""",
    ("page_urls",),
)
def _(t):
    flag = t.table("region").filter("r_regionkey = 0").select(F.lit("Example.com = com-org, example.net=net-org,example.com=late,").alias("flag"))
    mapping = flag.select(F.inline(urls.parse_org_pairs(F.col("flag"))))
    return contracts.organisations(t.view("page_urls").select("host").distinct(), mapping)


@query(
    "description_files",
    """SELECT repo, arg_min(path, (-score, path)) AS path, max(score) AS score FROM (
         SELECT CAST(k % 40 AS STRING) AS repo, CASE k % 6 WHEN 0 THEN 'spec/openapi' || k || '.json' WHEN 1 THEN 'docs/swagger' || k || '.yaml' WHEN 2 THEN 'api' || k || '.v1.json'
                  WHEN 3 THEN 'test/openapi' || k || '.json' WHEN 4 THEN 'package-lock.json' ELSE 'readme' || k || '.md' END AS path,
                CASE k % 6 WHEN 0 THEN 9 WHEN 1 THEN 5 WHEN 2 THEN 1 ELSE -1 END AS score FROM api_parts) x WHERE score >= 0 GROUP BY repo""",
    ("api_parts",),
)
def _(t):
    k = F.col("k")
    n = k.cast("string")
    path = (
        F.when(k % 6 == 0, F.concat(F.lit("spec/openapi"), n, F.lit(".json")))
        .when(k % 6 == 1, F.concat(F.lit("docs/swagger"), n, F.lit(".yaml")))
        .when(k % 6 == 2, F.concat(F.lit("api"), n, F.lit(".v1.json")))
        .when(k % 6 == 3, F.concat(F.lit("test/openapi"), n, F.lit(".json")))
        .when(k % 6 == 4, F.lit("package-lock.json"))
        .otherwise(F.concat(F.lit("readme"), n, F.lit(".md")))
    )
    return contracts.best_description_files(t.view("api_parts").select((k % 40).cast("string").alias("repo"), path.alias("path")))


# --- pins -----------------------------------------------------------------------------------------------------------


def pin_files(t: Tables):
    p = t.view("pin_rows")
    lit = F.lit
    v, k = F.col("v").cast("string"), F.col("k")
    content = (
        F.when(k % 5 == 0, F.concat(lit("# build\nFROM reg.example.com/team/"), "image", lit(":v"), v, lit(".1-slim AS b\nFROM node:"), v, lit("-alpine\nFROM busybox:latest\n")))
        .when(k % 5 == 1, F.concat(lit("v"), v, lit(".2\n")))
        .when(k % 5 == 2, F.concat(lit('{\n  "name": "x",\n  "engines": {\n    "node": ">='), v, lit('.2"\n  }\n}\n')))
        .when(k % 5 == 3, F.concat(lit("jobs:\n  a:\n    with:\n      node-version: '"), v, lit("'\n")))
        .otherwise(
            F.concat(
                lit("import Stripe from 'stripe';\nconst h = { 'acme-version': '2024-0"), F.col("v").cast("string"), lit("' };\nconst c = new Stripe(key, {\n  apiVersion: '2023-1"),
                v, lit("-15',\n});\nget('https://api.vendor.com/x?api-version=2022-0"), (F.col("v") + 1).cast("string"), lit("-01');\n"),
            )
        )
    )
    return p.select("repo", F.concat(lit("d"), k.cast("string"), lit("/"), "base").alias("file"), content.alias("content"))


PIN_SQL = """
SELECT repo, 'd' || k || '/' || base AS file, 2 AS line, image AS subject, v || '.1' AS version, 'reg.example.com/team/' || image || ':v' || v || '.1-slim' AS text, 'docker-image' AS kind FROM pin_rows WHERE k % 5 = 0
UNION ALL SELECT repo, 'd' || k || '/' || base, 3, 'node', CAST(v AS STRING), 'node:' || v || '-alpine', 'node-version' FROM pin_rows WHERE k % 5 = 0
UNION ALL SELECT repo, 'd' || k || '/' || base, 1, 'node', v || '.2', 'v' || v || '.2', 'node-version' FROM pin_rows WHERE k % 5 = 1
UNION ALL SELECT repo, 'd' || k || '/' || base, 4, 'node', v || '.2', '>=' || v || '.2', 'node-version' FROM pin_rows WHERE k % 5 = 2
UNION ALL SELECT repo, 'd' || k || '/' || base, 4, 'node', CAST(v AS STRING), 'node-version: ''' || v || '''', 'node-version' FROM pin_rows WHERE k % 5 = 3
UNION ALL SELECT repo, 'd' || k || '/' || base, 2, 'acme', '2024-0' || v, '''acme-version'': ''2024-0' || v || '''', 'api-version' FROM pin_rows WHERE k % 5 = 4
UNION ALL SELECT repo, 'd' || k || '/' || base, 4, 'stripe', '2023-1' || v || '-15', 'apiVersion: ''2023-1' || v || '-15''', 'api-version' FROM pin_rows WHERE k % 5 = 4
UNION ALL SELECT repo, 'd' || k || '/' || base, 6, 'vendor', '2022-0' || (v + 1) || '-01', '?api-version=2022-0' || (v + 1) || '-01', 'api-version' FROM pin_rows WHERE k % 5 = 4
"""
P = ("pin_rows",)


def all_pins(t: Tables):
    return pins.extract_pins(pin_files(t))


def image_versions(t: Tables):
    return t.sql("SELECT DISTINCT repo, image AS name, '2.1' AS installed FROM pin_rows WHERE image <> 'standard'", "pin_rows")


@query("version_pins", PIN_SQL, P)
def _(t):
    return all_pins(t)


@query(
    "image_pin_conflicts",
    f"SELECT repo, subject, '2.1' AS expected, 'the installed ' || subject AS authority, file, line, version, text FROM ({PIN_SQL}) p WHERE kind = 'docker-image' AND version <> '2.1' AND subject <> 'standard'",
    P,
)
def _(t):
    return pinning.image_conflicts(all_pins(t), image_versions(t))


NODE_SQL = f"""
WITH n AS (SELECT * FROM ({PIN_SQL}) p WHERE kind = 'node-version'),
     g AS (SELECT repo, count(DISTINCT version) AS d, arg_min(version, file) FILTER (WHERE file LIKE '%package.json') AS expected FROM n GROUP BY repo)
SELECT n.repo, n.subject, g.expected, CASE WHEN g.expected IS NOT NULL THEN 'the declared engines.node' END AS authority, n.file, n.line, n.version, n.text
FROM n JOIN g ON n.repo = g.repo WHERE d > 1 AND (expected IS NULL OR version <> expected)
"""


@query("node_pin_conflicts", NODE_SQL, P)
def _(t):
    return pinning.node_conflicts(all_pins(t))


@query("unarbitrated_pins", f"SELECT * FROM ({PIN_SQL}) p WHERE kind = 'api-version'", P)
def _(t):
    return pinning.unarbitrated(all_pins(t))


@query(
    "pin_repairs",
    f"""SELECT repo, file, line, text AS find, regexp_replace(text, replace(version, '.', '[.]'), expected) AS replace, subject || ' is ' || expected || ' per ' || authority AS reason
        FROM ({NODE_SQL}) c WHERE expected IS NOT NULL""",
    P,
)
def _(t):
    return pinning.repairs(pinning.node_conflicts(all_pins(t)))


@query(
    "pin_descriptions",
    f"""SELECT repo, subject, CASE WHEN expected IS NOT NULL THEN '- `' || subject || '` should be ' || expected || ' per ' || authority || ', but '
               ELSE '- `' || subject || '` is pinned inconsistently and nothing declares the intended version: ' END AS head, file || ':' || line || ' (' || version || ')' AS site
        FROM ({NODE_SQL}) c""",
    P,
)
def _(t):
    return pinning.describe(pinning.node_conflicts(all_pins(t)))


@query(
    "pin_finding_ids",
    f"""SELECT repo, file, line, substr(sha256('version-pin|' || subject || '|' || version || '|' || coalesce(expected, '') || '|' || file), 1, 12) AS finding_id FROM ({NODE_SQL}) c""",
    P,
)
def _(t):
    return pinning.with_pin_ids(pinning.node_conflicts(all_pins(t))).select("repo", "file", "line", "finding_id")


@query(
    "api_version_currency",
    f"""SELECT repo, file, line, subject, CASE subject WHEN 'stripe' THEN '2023-12-01' WHEN 'vendor' THEN 'v9' END AS published,
               CASE WHEN subject = 'stripe' THEN CASE WHEN version < '2023-12-01' THEN 'behind' ELSE 'current' END ELSE 'unknown' END AS state FROM ({PIN_SQL}) p WHERE kind = 'api-version'""",
    P,
)
def _(t):
    d = t.table("region").select("r_regionkey").filter("r_regionkey < 3").select(
        F.when(F.col("r_regionkey") == 0, "stripe.com").when(F.col("r_regionkey") == 1, "api.stripe.io").otherwise("vendor.io").alias("domain"),
        F.when(F.col("r_regionkey") == 0, "2023-12-01").when(F.col("r_regionkey") == 1, "2030-01-01").otherwise("v9").alias("published"),
    )
    return contracts.published_versions(pinning.unarbitrated(all_pins(t)), d).select("repo", "file", "line", "subject", "published", "state")


@query(
    "pin_candidate_files",
    "SELECT DISTINCT repo, CASE WHEN k % 7 = 0 THEN 'Dockerfile' ELSE base END AS file FROM pin_rows UNION SELECT DISTINCT repo, 'Dockerfile' FROM pin_rows",
    P,
)
def _(t):
    p = t.view("pin_rows")
    return pins.pin_candidates(p.select("repo", F.lit("Dockerfile").alias("file")), p.select("repo", F.when(F.col("k") % 7 == 0, "Dockerfile").otherwise(F.col("base")).alias("file")))
