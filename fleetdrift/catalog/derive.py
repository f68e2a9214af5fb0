"""Views that give the driver tables the shapes of dependency data.

Each text is portable SQL, used word for word by the Spark query and by its check. Every view reads its
whole table: what differs between two snapshots is a spelling chosen by CASE, never a dropped row.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def view(name: str, text: str) -> None:
    if name in VIEWS:
        raise ValueError(f"view {name} is defined twice")
    VIEWS[name] = text.strip()


def _closure(names) -> list[str]:
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
                visit(other)
        order.append(name)

    for name in names:
        visit(name)
    return order


def with_views(text: str, names=()) -> str:
    """``text`` with the named views, and the views they read, as common table expressions in front."""
    text = text.strip()
    if not names:
        return text
    heads = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _closure(names))
    if re.match(r"(?i)with\s", text):
        recursive = re.match(r"(?i)with\s+recursive\s", text)
        rest = re.sub(r"(?i)^with\s+(recursive\s+)?", "", text)
        return f"WITH {'RECURSIVE ' if recursive else ''}{heads},\n{rest}"
    return f"WITH {heads}\n{text}"


# --- API snapshots from part -----------------------------------------------------------------------------

view(
    "api_parts",
    """
SELECT p_partkey AS k, p_brand AS pkg, p_type AS t,
       lower(replace(p_name, ' ', '_')) || '_x' || CAST(p_partkey AS STRING) AS leaf,
       CASE WHEN p_size % 4 = 0 THEN '' ELSE 'ns' || CAST(p_size % 4 AS STRING) || '.' END AS ns,
       CASE WHEN p_size % 5 = 0 THEN 'function' WHEN p_size % 5 = 1 THEN 'class' WHEN p_size % 5 = 2 THEN 'interface'
            WHEN p_size % 5 = 3 THEN 'variable' END AS kind,
       CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'R' || CAST(p_partkey AS STRING) END AS ret
FROM part
""",
)

view(
    "symbols_from",
    """
SELECT k, pkg, kind, false AS deprecated, '' AS doc,
       CASE WHEN k % 17 = 0 THEN ns || leaf WHEN k % 11 = 0 THEN ns || leaf || '_old' ELSE ns || leaf END AS path,
       CASE WHEN k % 17 = 0 THEN 'typeof ' || leaf WHEN k % 23 = 0 THEN 'Box<T>' WHEN k % 29 = 0 THEN 'Cfg<T>'
            ELSE '(a: ' || t || ', b: number) => ' || ret END AS signature,
       CASE WHEN k % 17 = 0 THEN '' WHEN k % 23 = 0 OR k % 29 = 0 THEN 'T' ELSE '' END AS tps
FROM api_parts
""",
)

view(
    "symbols_to",
    """
SELECT k, pkg, kind, k % 9 = 0 AS deprecated,
       CASE WHEN k % 18 = 0 THEN 'Use ' || leaf || 'Next instead' ELSE '' END AS doc,
       CASE WHEN k % 17 = 0 THEN 'moved.' || leaf WHEN k % 11 = 0 THEN ns || leaf || '_new'
            WHEN k % 19 = 0 THEN ns || leaf || '_canon' ELSE ns || leaf END AS path,
       CASE WHEN k % 17 = 0 THEN 'typeof ' || leaf WHEN k % 23 = 0 THEN 'Box<T, U>' WHEN k % 29 = 0 THEN 'Cfg<T, U>'
            WHEN k % 7 = 0 THEN '(a: ' || t || ', b: number, c: string) => ' || ret
            WHEN k % 5 = 0 THEN '(a: ' || t || ', b?: number) => ' || ret
            WHEN k % 22 = 0 THEN '(a:  ' || t || ',  b: number) => ' || ret
            WHEN k % 13 = 0 THEN '(x: ' || t || ', y: number) => ' || ret
            WHEN k % 31 = 0 THEN '({ q, r }: ' || t || ', b: number) => ' || ret
            ELSE '(a: ' || t || ', b: number) => ' || ret END AS signature,
       CASE WHEN k % 17 = 0 THEN '' WHEN k % 23 = 0 THEN 'T,U=' WHEN k % 29 = 0 THEN 'T,U' ELSE '' END AS tps
FROM api_parts
UNION ALL
SELECT k, pkg, kind, false, '', 'moved2.' || leaf, 'typeof ' || leaf, '' FROM api_parts WHERE k % 51 = 0
""",
)

view(
    "symbol_aliases",
    """
SELECT pkg, ns || leaf AS spelling, ns || leaf || '_canon' AS canonical
FROM api_parts WHERE k % 19 = 0 AND k % 17 <> 0 AND k % 11 <> 0
""",
)

view(
    "surface_headers",
    """
SELECT pkg, '1.' || CAST(n AS STRING) || '.0' AS from_version, '2.0.' || CAST(n AS STRING) AS to_version,
       'index.d.ts' AS from_entry, CASE WHEN n % 10 = 9 THEN NULL ELSE 'index.d.ts' END AS to_entry,
       n % 8 = 7 AS from_truncated, n % 6 = 5 AS to_truncated
FROM (SELECT DISTINCT p_brand AS pkg, CAST(replace(p_brand, 'Brand#', '') AS INT) AS n FROM part) b
""",
)

# How the check states the diff: by the arithmetic that made the snapshots, not by reading signatures.
view(
    "expected_changes",
    """
SELECT f.pkg, f.path, CAST(NULL AS STRING) AS symbol_kind, 'removed' AS kind, 'breaking' AS severity, 'high' AS confidence,
       f.signature AS before, CAST(NULL AS STRING) AS after, CAST(NULL AS STRING) AS guidance
FROM symbols_from f JOIN surface_headers h ON f.pkg = h.pkg
WHERE h.to_entry IS NOT NULL AND NOT h.to_truncated AND ((f.k % 11 = 0 AND f.k % 17 <> 0) OR f.k % 51 = 0)
UNION ALL
SELECT f.pkg, f.path, NULL, 'deprecated', 'deprecation', 'high', f.signature, t.signature,
       CASE WHEN t.doc = '' THEN NULL ELSE t.doc END
FROM symbols_from f JOIN symbols_to t ON f.k = t.k JOIN surface_headers h ON f.pkg = h.pkg
WHERE h.to_entry IS NOT NULL AND f.k % 11 <> 0 AND f.k % 17 <> 0 AND t.deprecated
UNION ALL
SELECT f.pkg, f.path, NULL, 'signature-changed',
       CASE WHEN f.k % 23 = 0 THEN 'feature' WHEN f.k % 29 = 0 OR f.k % 7 = 0 THEN 'breaking' ELSE 'drift' END,
       CASE WHEN f.k % 23 = 0 OR f.k % 29 = 0 OR f.k % 7 = 0 THEN 'high' ELSE 'medium' END,
       f.signature, t.signature, NULL
FROM symbols_from f JOIN symbols_to t ON f.k = t.k JOIN surface_headers h ON f.pkg = h.pkg
WHERE h.to_entry IS NOT NULL AND f.k % 11 <> 0 AND f.k % 17 <> 0
  AND (f.k % 23 = 0 OR f.k % 29 = 0 OR f.k % 7 = 0 OR f.k % 5 = 0)
UNION ALL
SELECT t.pkg, t.path, t.kind, 'added', 'feature', 'high', NULL, t.signature, NULL
FROM symbols_to t JOIN surface_headers h ON t.pkg = h.pkg
WHERE h.to_entry IS NOT NULL AND NOT h.from_truncated AND (t.k % 11 = 0 OR t.k % 17 = 0 OR t.k % 19 = 0)
""",
)

view(
    "impacting_changes",
    "SELECT * FROM expected_changes WHERE kind IN ('removed', 'deprecated', 'signature-changed')",
)

# --- call sites from lineitem ---------------------------------------------------------------------------

view(
    "call_sites",
    """
SELECT CAST(l_suppkey AS STRING) AS repo, p.pkg,
       CASE WHEN p.k % 4 = 1 THEN f.path || '.inner' ELSE f.path END AS symbol,
       'src/f' || CAST(l_orderkey AS STRING) || '.ts' AS file, l_linenumber AS line, CAST(l_quantity AS INT) AS col,
       CASE WHEN l_linenumber % 2 = 0 THEN 'type' ELSE 'import' END AS via
FROM lineitem JOIN api_parts p ON l_partkey = p.k JOIN symbols_from f ON p.k = f.k
""",
)

# --- versions from part -----------------------------------------------------------------------------------

view(
    "version_rows",
    """
SELECT p_partkey AS k, p_brand AS pkg, CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'PyPI' END AS ecosystem,
       p_size % 4 AS maj, p_partkey % 12 AS mnr, p_size % 5 AS pat, p_partkey % 9 AS flavour
FROM part
""",
)

view(
    "versions",
    """
SELECT k, pkg, ecosystem, maj, mnr, pat, flavour,
       CASE WHEN ecosystem = 'npm' THEN
              CASE WHEN flavour = 0 THEN 'v' ELSE '' END || CAST(maj AS STRING) || '.' || CAST(mnr AS STRING) || '.' || CAST(pat AS STRING)
              || CASE flavour WHEN 1 THEN '-rc.1' WHEN 2 THEN '-beta.2' WHEN 3 THEN '-rc.10' WHEN 4 THEN '-a-b' ELSE '' END
            WHEN flavour = 7 THEN 'not-a-version'
            ELSE CASE WHEN flavour = 1 THEN '1!' ELSE '' END || CAST(maj AS STRING) || '.' || CAST(mnr AS STRING)
              || CASE WHEN flavour = 8 THEN '' ELSE '.' || CAST(pat AS STRING) END
              || CASE flavour WHEN 2 THEN 'a1' WHEN 3 THEN 'rc2' WHEN 4 THEN '.post1' WHEN 5 THEN '.dev3' WHEN 6 THEN '+local.1' ELSE '' END
       END AS version
FROM version_rows
""",
)

# Sort position by integer arithmetic: what the check orders by instead of reading the text.
view(
    "version_ranks",
    """
SELECT k, pkg, ecosystem, version, flavour,
       CASE WHEN ecosystem = 'npm' THEN ((maj * 100 + mnr) * 100 + pat) * 100
              + CASE flavour WHEN 1 THEN 20 WHEN 2 THEN 10 WHEN 3 THEN 30 WHEN 4 THEN 5 ELSE 90 END
            WHEN flavour = 7 THEN -1
            ELSE CASE WHEN flavour = 1 THEN 100000000 ELSE 0 END
              + ((maj * 100 + mnr) * 100 + CASE WHEN flavour = 8 THEN 0 ELSE pat END) * 100
              + CASE flavour WHEN 5 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 30 WHEN 6 THEN 50 WHEN 4 THEN 60 ELSE 40 END
       END AS pos,
       CASE WHEN ecosystem = 'npm' THEN flavour IN (1, 2, 3, 4) ELSE flavour IN (2, 3, 5, 7) END AS pre
FROM versions
""",
)

# --- installed packages from orders, advisories from supplier ----------------------------------------------

view(
    "installed",
    """
SELECT CAST(o_custkey % 50 AS STRING) AS repo, CASE WHEN o_orderkey % 2 = 0 THEN 'npm' ELSE 'PyPI' END AS ecosystem,
       'pkg' || CAST(o_orderkey % 100 AS STRING) AS name,
       CAST(o_orderkey % 5 AS STRING) || '.' || CAST(o_orderkey % 7 AS STRING) || '.' || CAST(o_orderkey % 11 AS STRING)
         || CASE WHEN o_orderkey % 23 <> 0 THEN '' WHEN o_orderkey % 2 = 0 THEN '-rc.1' ELSE 'rc1' END AS version,
       (o_orderkey % 5) * 100000 + (o_orderkey % 7) * 1000 + (o_orderkey % 11) * 10
         + CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE 5 END AS pos,
       o_orderkey AS line
FROM orders
""",
)

view(
    "advisory_rows",
    """
SELECT s_suppkey AS s, 'ADV-' || CAST(s_suppkey AS STRING) AS advisory, 'pkg' || CAST(s_suppkey % 100 AS STRING) AS name,
       CASE WHEN s_suppkey % 10 = 7 THEN 'crates.io' WHEN s_suppkey % 2 = 0 THEN 'npm' ELSE 'PyPI' END AS ecosystem,
       s_suppkey % 3 AS m, s_suppkey % 4 AS f, s_suppkey % 10 AS d, s_suppkey % 6 = 0 AS has_git, s_name, s_acctbal
FROM supplier
""",
)

view(
    "expected_windows",
    """
SELECT s, advisory, ecosystem, name, CASE WHEN f = 0 THEN '0' ELSE CAST(m AS STRING) || '.0.0' END AS introduced,
       CASE WHEN d IN (0, 5) THEN NULL ELSE CAST(m + 1 AS STRING) || '.' || CAST(f AS STRING) || '.0' END AS fixed,
       CASE WHEN d = 0 THEN CAST(m + 1 AS STRING) || '.0.0' END AS last_affected,
       CASE WHEN f = 0 THEN -1 ELSE m * 100000 + 5 END AS lo, CASE WHEN d IN (0, 5) THEN NULL ELSE (m + 1) * 100000 + f * 1000 + 5 END AS hi,
       CASE WHEN d = 0 THEN (m + 1) * 100000 + 5 END AS last_pos, 1 AS w
FROM advisory_rows WHERE NOT (d = 5 AND m = 1)
UNION ALL
SELECT s, advisory, ecosystem, name, '4.1.0', '4.3.0', NULL, 401005, 403005, NULL, 2 FROM advisory_rows WHERE m = 1
""",
)

view(
    "expected_vulnerable",
    """
SELECT i.ecosystem, i.name, i.version, w.advisory,
       (array_agg(w.fixed ORDER BY w.w) FILTER (WHERE w.fixed IS NOT NULL OR w.last_affected IS NOT NULL))[1] AS fixed_in
FROM (SELECT DISTINCT ecosystem, name, version, pos FROM installed) i
JOIN expected_windows w ON i.ecosystem = w.ecosystem AND i.name = w.name AND w.lo <= i.pos
  AND CASE WHEN w.hi IS NOT NULL THEN i.pos < w.hi WHEN w.last_pos IS NOT NULL THEN i.pos <= w.last_pos ELSE true END
GROUP BY ALL
""",
)

view(
    "imports",
    """
SELECT CAST(l_orderkey % 50 AS STRING) AS repo, 'pkg' || CAST((l_orderkey * 7 + l_linenumber * 13) % 300 AS STRING) AS pkg,
       'src/f' || CAST(l_orderkey AS STRING) || '.ts' AS file, l_linenumber AS line
FROM lineitem
""",
)

# --- locating -----------------------------------------------------------------------------------------------

view(
    "expected_findings",
    """
SELECT c.pkg, c.path AS symbol, c.kind, c.severity, c.confidence, s.repo, s.n_sites
FROM impacting_changes c
JOIN (SELECT repo, pkg, symbol, count(*) AS n_sites
      FROM (SELECT DISTINCT repo, pkg, symbol, file, line, col FROM call_sites) d GROUP BY repo, pkg, symbol) s
  ON c.pkg = s.pkg AND c.path = s.symbol
""",
)

view("scan_dependencies", "SELECT DISTINCT repo, pkg FROM call_sites")

# --- repositories, workspaces and declarations from orders and customer ---------------------------------------

view(
    "declared_rows",
    """
SELECT CAST(o_custkey AS STRING) AS repo, 'ws' || CAST(o_orderkey % 4 AS STRING) AS workspace, o_orderkey AS seq,
       'dep' || CAST(o_orderkey % 23 AS STRING) AS name, o_orderkey % 3 <> 0 AS dev,
       CASE o_orderkey % 8 WHEN 0 THEN '^' || CAST(o_orderkey % 4 AS STRING) || '.1.0' WHEN 1 THEN CAST(o_orderkey % 5 AS STRING) || '.0.2'
            WHEN 2 THEN 'workspace:*' WHEN 3 THEN '*' WHEN 4 THEN '~1.' || CAST(o_orderkey % 9 AS STRING) || '.3'
            WHEN 5 THEN 'file:../x' WHEN 6 THEN '=2.2.2' ELSE 'latest' END AS declared
FROM orders
""",
)

view(
    "resolved_rows",
    """
SELECT repo, name, CASE WHEN max(seq) % 5 = 0 THEN '9.0.' || CAST(max(seq) % 7 AS STRING) END AS node_modules,
       CASE WHEN max(seq) % 3 = 0 THEN '8.0.' || CAST(max(seq) % 7 AS STRING) END AS locked
FROM declared_rows GROUP BY repo, name
""",
)

# --- outbound calls and descriptions from pages ----------------------------------------------------------------

view(
    "page_urls",
    """
SELECT page_id AS k, CAST(page_id % 20 AS STRING) AS repo, url,
       lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
       regexp_extract(url, '[?]([^#]*)', 1) AS query
FROM pages
""",
)

view(
    "page_calls",
    """
SELECT k, repo, host, CASE WHEN k % 4 = 0 THEN 'POST' ELSE 'GET' END AS method,
       CASE WHEN k % 5 = 0 THEN regexp_replace(path, '[0-9]+', '{}') WHEN k % 7 = 0 THEN path || '/deep/er'
            WHEN k % 11 = 0 THEN regexp_replace(path, '[0-9]+', '{}/tail') WHEN k % 13 = 0 THEN '/zz' || path ELSE path END AS route
FROM page_urls
""",
)

view(
    "page_operations",
    """
SELECT DISTINCT host, method, CASE WHEN k % 3 = 0 THEN regexp_replace(path, '[0-9]+', '{id}/{part}')
       WHEN k % 17 = 0 THEN regexp_replace(path, '/[0-9]+', '') ELSE regexp_replace(path, '[0-9]+', '{id}') END AS route
FROM (SELECT k, host, path, CASE WHEN k % 4 = 0 THEN 'POST' ELSE 'GET' END AS method FROM page_urls) p
""",
)

# --- two descriptions of one API from customer and nation --------------------------------------------------------

view(
    "spec_params",
    """
SELECT DISTINCT CAST(n_regionkey AS STRING) AS vendor, n_nationkey AS nk, '/' || lower(n_name) AS r, CAST(c_custkey % 12 AS INT) AS pk
FROM customer JOIN nation ON c_nationkey = n_nationkey
""",
)

view(
    "op_params_from",
    """
SELECT vendor, 'GET' AS method, r || CASE WHEN nk % 6 = 0 THEN '/old' ELSE '' END AS route, nk % 4 = 0 AS deprecated,
       'p' || CAST(pk AS STRING) || CASE WHEN (nk + pk) % 5 = 0 THEN 'old' ELSE '' END AS name, CASE WHEN pk % 4 = 0 THEN 'header' ELSE 'query' END AS location,
       pk % 3 = 0 AS required, CASE WHEN pk = 7 THEN 'unknown' WHEN pk % 2 = 0 THEN 'string' ELSE 'integer' END AS type
FROM spec_params
""",
)

view(
    "op_params_to",
    """
SELECT vendor, 'GET' AS method, r || CASE WHEN nk % 6 = 0 THEN '/new' ELSE '' END AS route, nk % 4 = 0 OR nk % 5 = 1 AS deprecated,
       'p' || CAST(pk AS STRING) || CASE WHEN (nk + pk) % 5 = 0 THEN 'new' ELSE '' END AS name, CASE WHEN pk % 4 = 0 THEN 'header' ELSE 'query' END AS location,
       pk % 3 = 0 OR (nk + pk) % 4 = 0 AS required,
       CASE WHEN (nk * pk) % 11 = 3 THEN 'number' WHEN pk = 7 THEN 'boolean' WHEN pk % 2 = 0 THEN 'string' ELSE 'integer' END AS type
FROM spec_params
""",
)

view(
    "expected_spec_changes",
    """
SELECT DISTINCT vendor, 'GET ' || r || '/old' AS path, 'removed' AS kind, 'breaking' AS severity, 'high' AS confidence, 'present' AS before, CAST(NULL AS STRING) AS after
FROM spec_params WHERE nk % 6 = 0
UNION ALL SELECT DISTINCT vendor, 'GET ' || r || '/new', 'added', 'feature', 'high', NULL, 'present' FROM spec_params WHERE nk % 6 = 0
UNION ALL SELECT DISTINCT vendor, 'GET ' || r, 'deprecated', 'deprecation', 'high', 'current', 'deprecated' FROM spec_params WHERE nk % 6 <> 0 AND nk % 5 = 1 AND nk % 4 <> 0
UNION ALL SELECT vendor, route || ' ' || loc || ':' || p || 'old', 'removed', 'breaking', 'medium', CASE WHEN old_req THEN 'required' ELSE 'optional' END, NULL FROM spec_pairs WHERE renamed
UNION ALL SELECT vendor, route || ' ' || loc || ':' || p || 'new', CASE WHEN new_req THEN 'signature-changed' ELSE 'added' END, CASE WHEN new_req THEN 'breaking' ELSE 'feature' END,
       'high', NULL, CASE WHEN new_req THEN 'required' ELSE 'optional' END FROM spec_pairs WHERE renamed
UNION ALL SELECT vendor, route || ' ' || loc || ':' || p, 'signature-changed', 'breaking', 'high', 'optional', 'required' FROM spec_pairs WHERE NOT renamed AND new_req AND NOT old_req
UNION ALL SELECT vendor, route || ' ' || loc || ':' || p, 'signature-changed', 'breaking', 'high', old_type, new_type FROM spec_pairs
WHERE NOT renamed AND old_type <> new_type AND old_type <> 'unknown'
""",
)

view(
    "spec_pairs",
    """
SELECT vendor, 'GET ' || r AS route, 'p' || CAST(pk AS STRING) AS p, CASE WHEN pk % 4 = 0 THEN 'header' ELSE 'query' END AS loc, (nk + pk) % 5 = 0 AS renamed,
       pk % 3 = 0 AS old_req, pk % 3 = 0 OR (nk + pk) % 4 = 0 AS new_req, CASE WHEN pk = 7 THEN 'unknown' WHEN pk % 2 = 0 THEN 'string' ELSE 'integer' END AS old_type,
       CASE WHEN (nk * pk) % 11 = 3 THEN 'number' WHEN pk = 7 THEN 'boolean' WHEN pk % 2 = 0 THEN 'string' ELSE 'integer' END AS new_type
FROM spec_params WHERE nk % 6 <> 0
""",
)

# --- pins from part ------------------------------------------------------------------------------------------------

view(
    "pin_rows",
    """
SELECT p_partkey AS k, CAST(p_partkey % 120 AS STRING) AS repo, lower(p_type) AS image, p_size % 4 AS v,
       CASE p_partkey % 5 WHEN 0 THEN 'Dockerfile' WHEN 1 THEN '.nvmrc' WHEN 2 THEN 'package.json' WHEN 3 THEN '.github/workflows/ci.yml' ELSE 'src/client.ts' END AS base
FROM part
""",
)

# --- hunks and anchors from orders and lineitem --------------------------------------------------------------------

view(
    "hunk_rows",
    """
SELECT CAST(o_custkey % 30 AS STRING) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'app/src/f' ELSE 'src/f' END || CAST(o_orderkey % 400 AS STRING) || '.ts' AS file,
       o_orderkey % 200 + 1 AS start_line, o_orderkey % 200 + 1 + o_custkey % 90 AS end_line
FROM orders
""",
)
view(
    "anchor_rows",
    """
SELECT CASE WHEN o_custkey % 30 = 7 THEN '6' ELSE CAST(o_custkey % 30 AS STRING) END AS id, CASE WHEN l_partkey % 2 = 0 THEN 'src/f' ELSE 'app/src/f' END || CAST(l_orderkey % 400 AS STRING) || '.ts' AS file,
       l_partkey % 900 AS line
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
)

# --- scans and findings from events -------------------------------------------------------------------------------

view(
    "event_scans",
    "SELECT DISTINCT CAST(user_id % 5 AS STRING) AS repo, CAST(CAST(ts AS DATE) AS STRING) AS scan FROM events",
)
view(
    "scan_found",
    """
SELECT DISTINCT CAST(user_id % 5 AS STRING) AS repo, CAST(CAST(ts AS DATE) AS STRING) AS scan, CAST(user_id AS STRING) || ':' || event_type AS finding
FROM events
""",
)

# --- repair outcomes from documents and labels --------------------------------------------------------------------

view(
    "repair_outcomes",
    """
SELECT d.doc_id, d.source AS model, CASE WHEN d.doc_id % 2 = 0 THEN 'agent' ELSE 'plain' END AS harness, CAST(d.doc_id % 23 AS STRING) AS case_id,
       CASE WHEN l.quality = 1 THEN CASE WHEN d.n_chars % 5 = 0 THEN 'typecheck-only' ELSE 'verified' END WHEN d.n_chars % 2 = 0 THEN 'regression' ELSE 'unverified' END AS verdict,
       CASE WHEN d.doc_id % 19 = 0 THEN 'timeout' END AS inconclusive, CAST(d.n_chars % 7 AS INT) AS edits_applied, CAST(d.n_chars % 3 AS INT) AS edits_withheld,
       CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE CAST(d.n_chars % 10 AS INT) END AS errors_before, CAST(d.n_chars % 4 AS INT) AS errors_after,
       l.toxic AS type_escapes, CASE WHEN d.n_chars % 11 = 0 THEN 2 ELSE 0 END AS deprecation_gaps, CASE WHEN d.n_chars % 13 = 0 THEN 1 ELSE 0 END AS n_unresolved,
       CASE WHEN d.n_chars % 17 = 0 THEN 2 ELSE 0 END AS n_uncheckable, d.n_chars AS duration_ms
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""",
)
view("repair_cases", "SELECT DISTINCT CAST(doc_id % 21 AS STRING) AS case_id, CAST(doc_id % 21 % 4 AS INT) AS minimal_edits FROM documents")

# --- lockfile entries from lineitem ---------------------------------------------------------------------------------

view(
    "lock_entries",
    """
SELECT l_orderkey AS o, CAST(l_orderkey AS STRING) AS repo, 'pkg' || CAST(l_partkey % 700 AS STRING) AS name,
       CAST(l_linenumber AS STRING) || '.' || CAST(l_suppkey % 9 AS STRING) || '.' || CAST(l_partkey % 10 AS STRING) AS version, l_partkey AS k, l_linestatus = 'F' AS dev,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n
FROM lineitem
""",
)
