"""Gating, graph, rename, quality and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gating, graph, quality, renames, scoring
from ..sources import diffs, imports
from . import Tables, query
from .snapshots import changes, symbols

# --- gating ------------------------------------------------------------------------------------------------------

H = ("hunk_rows", "anchor_rows")
SAME = "(h.file = a.file OR h.file LIKE '%/' || a.file OR a.file LIKE '%/' || h.file)"


def hunk_rows(t: Tables):
    return t.view("hunk_rows").select("id", "file", F.col("start_line").alias("start"), F.col("end_line").alias("end"))


@query(
    "anchored_hunks",
    f"""SELECT DISTINCT h.id, h.file, h.start_line AS start, h.end_line AS "end" FROM hunk_rows h
        JOIN anchor_rows a ON h.id = a.id AND {SAME} AND a.line BETWEEN h.start_line - 3 AND h.end_line + 3""",
    H,
)
def _(t):
    return gating.hunks_with_anchor(hunk_rows(t), t.view("anchor_rows"), 3)


ALLOWED = "SELECT DISTINCT id, 'f' || CAST(CAST(id AS INT) * 13 AS STRING) || '.ts' AS file FROM hunk_rows"


@query(
    "classified_hunks",
    f"""WITH x AS (SELECT h.id, h.file, h.start_line, h.end_line, EXISTS (SELECT 1 FROM anchor_rows a WHERE a.id = h.id) AS pts,
                     EXISTS (SELECT 1 FROM anchor_rows a WHERE a.id = h.id AND {SAME} AND a.line BETWEEN h.start_line AND h.end_line) AS hit,
                     h.file LIKE '%/f' || CAST(CAST(id AS INT) * 13 AS STRING) || '.ts' AS whole FROM (SELECT DISTINCT * FROM hunk_rows) h)
        SELECT id, file, start_line AS start, end_line AS "end", CASE WHEN whole OR hit THEN 'evidenced' ELSE 'unrequested' END AS evidence,
               CASE WHEN whole THEN file || ' is a file the migration changed' WHEN hit THEN 'the migration points into ' || file || ':' || start_line
                    ELSE file || ':' || start_line || ' is not anywhere the migration pointed' END AS reason FROM x""",
    H,
)
def _(t):
    allowed = t.sql(ALLOWED, "hunk_rows")
    return gating.classify_hunks(hunk_rows(t).distinct(), t.view("anchor_rows"), gating.MIGRATION, allowed)


@query(
    "reviewer_gate",
    f"""SELECT h.id, evidence, reason, count(*) AS n FROM (SELECT h.id, 'evidenced' AS evidence, CASE WHEN id = '7' THEN 'the failure reports no locations to judge against'
              WHEN EXISTS (SELECT 1 FROM anchor_rows a WHERE a.id = h.id AND {SAME} AND a.line BETWEEN h.start_line AND h.end_line) THEN 'pointed' ELSE 'open' END AS reason
            FROM (SELECT DISTINCT * FROM hunk_rows) h) h GROUP BY ALL""",
    H,
)
def _(t):
    out = gating.classify_hunks(hunk_rows(t).distinct(), t.view("anchor_rows"), gating.REVIEWER)
    reason = F.when(F.col("reason").startswith("the reviewer points"), "pointed").when(F.col("reason").startswith("nothing"), "open").otherwise(F.col("reason"))
    return out.groupBy("id", "evidence", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "review_anchors",
    "SELECT id, file, line FROM anchor_rows UNION SELECT id, file, start_line FROM hunk_rows",
    H,
)
def _(t):
    return gating.review_anchors(t.view("anchor_rows"), hunk_rows(t).withColumnRenamed("start", "line"))


# Diffs made of the lines of documents: one file per document, one hunk per paragraph.

PARAGRAPHS = """
SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INT) AS i, unnest(string_split(text, chr(10))) AS line FROM documents
"""


def diff_rows(t: Tables):
    """Each document as a diff: line i is a hunk at 10 * i + 1 with one context line, the line itself added, one removed."""
    lines = F.split("text", "\n")
    hunk = lambda l, i: F.concat(
        F.lit("@@ -"), (i * 10 + 1).cast("string"), F.lit(",2 +"), (i * 10 + 1).cast("string"), F.lit(",2 @@ x\n ctx\n+"), F.regexp_replace(l, "[\r]", ""), F.lit("\n-old\n")
    )
    n = F.col("doc_id").cast("string")
    body = F.array_join(F.transform(lines, hunk), "")
    gone = F.col("doc_id") % 5 == 0
    head = F.concat(
        F.lit("diff --git a/d"), n, F.lit(".txt b/d"), n, F.lit(".txt\n--- a/d"), n, F.lit(".txt\n+++ "), F.when(gone, "/dev/null").otherwise(F.concat(F.lit("b/d"), n, F.lit(".txt"))), F.lit("\n")
    )
    return t.table("documents").select(n.alias("id"), F.concat(head, body).alias("diff"))


@query(
    "diff_hunks",
    f"""SELECT CAST(doc_id AS VARCHAR) AS id, 'd' || doc_id || '.txt' AS file, i * 10 + 1 AS start, i * 10 + 2 AS "end" FROM ({PARAGRAPHS}) p""",
)
def _(t):
    return diffs.hunks(diff_rows(t))


@query(
    "diff_touched_lines",
    f"""SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 5 = 0 THEN '/dev/null' ELSE 'd' || doc_id || '.txt' END AS file, i * 10 + 2 AS line FROM ({PARAGRAPHS}) p""",
)
def _(t):
    return diffs.touched_lines(diff_rows(t))


@query(
    "diff_kept_hunks",
    f"""SELECT id, coalesce(string_agg(h, '' ORDER BY i), '') AS diff FROM (
          SELECT CAST(doc_id AS VARCHAR) AS id, -1 AS i, CASE WHEN count(*) FILTER (WHERE i % 2 = 1) > 0 THEN 'diff --git a/d' || doc_id || '.txt b/d' || doc_id || '.txt' || chr(10) || '--- a/d' || doc_id || '.txt' || chr(10) || '+++ '
                 || CASE WHEN doc_id % 5 = 0 THEN '/dev/null' ELSE 'b/d' || doc_id || '.txt' END || chr(10) ELSE '' END AS h FROM ({PARAGRAPHS}) p GROUP BY doc_id
          UNION ALL SELECT CAST(doc_id AS VARCHAR), i, '@@ -' || (i * 10 + 1) || ',2 +' || (i * 10 + 1) || ',2 @@ x' || chr(10) || ' ctx' || chr(10) || '+' || replace(line, chr(13), '') || chr(10) || '-old' || chr(10)
            FROM ({PARAGRAPHS}) q WHERE i % 2 = 1) z GROUP BY id""",
)
def _(t):
    d = diff_rows(t)
    kept = diffs.hunks(d).filter("start % 20 = 11").select("id", "file", "start")
    return diffs.keep_hunks(d, kept)


@query(
    "diff_type_escapes",
    """SELECT CAST(doc_id AS VARCHAR) AS id, len(string_split(text, chr(10))) - CAST(floor((len(string_split(text, chr(10))) + 2) / 3) AS BIGINT) AS n_escapes FROM documents""",
)
def _(t):
    """Two added lines of three silence the checker; the one removed in each hunk never counts."""
    lines = F.split("text", "\n")
    body = F.array_join(
        F.transform(
            lines,
            lambda l, i: F.concat(F.when(i % 3 == 0, "+x: anything = 1").when(i % 3 == 1, "+f(x as any)").otherwise("+let y: any = 2"), F.lit("\n-z: any\n+++ as any\n")),
        ),
        "",
    )
    return diffs.type_escapes(t.table("documents").select(F.col("doc_id").cast("string").alias("id"), body.alias("diff"))).withColumn(
        "n_escapes", F.col("n_escapes").cast("bigint")
    )


@query("diff_changed_files", "SELECT CAST(doc_id AS VARCHAR) AS id, 'd' || doc_id || '.txt' AS file FROM documents WHERE doc_id % 5 <> 0")
def _(t):
    return diffs.changed_files(diff_rows(t))


@query(
    "evidence_files",
    """SELECT CAST(doc_id AS VARCHAR) AS id, 'd' || doc_id || '.txt' AS file FROM documents WHERE doc_id % 5 <> 0
       UNION SELECT CAST(doc_id AS VARCHAR), 'd' || CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1 END || '.txt' FROM documents""",
)
def _(t):
    k = F.col("doc_id")
    sites = t.table("documents").select(k.cast("string").alias("id"), F.concat(F.lit("d"), F.when(k % 2 == 0, k).otherwise(k + 1).cast("string"), F.lit(".txt")).alias("file"))
    return quality.evidence_files(sites, diffs.changed_files(diff_rows(t)))


# --- edits -------------------------------------------------------------------------------------------------------


def line_edits(t: Tables):
    """Two edits per conversation turn: one that still fits its line, one whose text moved on, or past the end."""
    c = t.table("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("repo"), F.lit("f").alias("file"), F.regexp_replace("text", "[\r]", "").alias("content"), "conv_id", "turn"
    )
    lines = F.split("content", "\n")
    n = F.size(lines)
    fit = F.struct(F.lit(1).alias("edit"), n.alias("line"), F.lit(1).alias("col"), F.substring(F.element_at(lines, -1), 1, 3).alias("find"), F.lit("NEW").alias("replace"))
    second = F.struct(
        F.lit(2).alias("edit"),
        F.when(F.col("turn") % 2 == 0, 1).otherwise(n + 5).alias("line"),
        F.lit(2).alias("col"),
        F.lit("@@@@").alias("find"),
        F.lit("X").alias("replace"),
    )
    edits = c.select("repo", "file", F.inline(F.array(fit, second)))
    return edits, c.select("repo", "file", "content")


CONV = "SELECT conv_id || '-' || turn AS repo, turn, replace(text, chr(13), '') AS text, string_split(replace(text, chr(13), ''), chr(10)) AS ls FROM conversations"


@query(
    "line_edit_outcomes",
    f"""SELECT repo, CAST(1 AS BIGINT) AS edit, true AS ok, NULL AS reason FROM ({CONV}) c
        UNION ALL SELECT repo, 2, false, CASE WHEN turn % 2 = 1 THEN 'f has no line ' || (len(ls) + 5) ELSE 'expected "@@@@" at f:1:2 but found "'
          || substr(ls[1], 2, 4) || '" — file changed since the scan' END FROM ({CONV}) c""",
)
def _(t):
    outcomes, _texts = gating.apply_line_edits(*line_edits(t))
    # an edit further right on the same line is applied first, so the second edit of a one-line text sees the original
    return outcomes.select("repo", "edit", "ok", "reason")


@query(
    "line_edit_texts",
    f"""SELECT repo, array_to_string(list_concat(ls[:-2], ['NEW' || substr(ls[-1], 4)]), chr(10)) AS content FROM ({CONV}) c""",
)
def _(t):
    _outcomes, texts = gating.apply_line_edits(*line_edits(t))
    return texts.select("repo", "content")


@query(
    "text_edit_outcomes",
    f"""SELECT repo, CASE WHEN n = 1 THEN replace(text, ' et ', ' AND ') ELSE text END || ' tail!' AS content, n = 1 AS first_ok,
               CASE WHEN n = 0 THEN 'text not found in f' WHEN n > 1 THEN 'text appears ' || n || ' times in f; needs more surrounding context to be unambiguous' END AS first_reason
        FROM (SELECT repo, text, CAST((length(text) - length(replace(text, ' et ', ''))) / 4 AS INT) AS n FROM ({CONV}) c) x""",
)
def _(t):
    c = t.table("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("repo"), F.lit("f").alias("file"), F.concat(F.regexp_replace("text", "[\r]", ""), F.lit(" tail.")).alias("content"))
    edits = c.select(
        "repo",
        "file",
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("edit"), F.lit(" et ").alias("find"), F.lit(" AND ").alias("replace")),
                F.struct(F.lit(2).alias("edit"), F.lit(" tail.").alias("find"), F.lit(" tail!").alias("replace")),
            )
        ),
    )
    out = gating.apply_text_edits(edits, c)
    return out.select("repo", "content", F.get("results", 0)["ok"].alias("first_ok"), F.get("results", 0)["reason"].alias("first_reason"))


# --- graph -------------------------------------------------------------------------------------------------------

EDGES = """
SELECT repo, 'p' || CAST(p_partkey AS STRING) AS src, 'p' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS dst
FROM part CROSS JOIN (SELECT DISTINCT CAST(r_regionkey % 2 AS STRING) AS repo FROM region) r
UNION SELECT '0', 'p' || CAST(p_partkey AS STRING), 'p' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING) FROM part
UNION SELECT '1', 'p1', 'p' || CAST(p_size AS STRING) FROM part
"""
PATHS_SQL = f"""
WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({EDGES}) x WHERE src <> dst),
  walk(repo, child, node, path, depth) AS (
    SELECT DISTINCT repo, 'p0' AS child, 'p0' AS node, ['p0'] AS path, 0 AS depth FROM e
    UNION SELECT e.repo, w.child, e.src, list_prepend(e.src, w.path), w.depth + 1 FROM walk w JOIN e ON e.repo = w.repo AND e.dst = w.node
    WHERE NOT list_contains(w.path, e.src) AND w.depth < 20)
SELECT repo, child, node AS direct, array_to_string(arg_min(path, (depth, path)), '>') AS path, min(depth) AS depth FROM walk
WHERE node IN (SELECT 'p' || CAST(p_partkey AS STRING) FROM part WHERE p_type = 'PROMO' OR p_partkey = 0) GROUP BY repo, child, node
"""


def graph_inputs(t: Tables):
    edges = t.sql(EDGES)
    repos = edges.select("repo").distinct()
    targets = repos.withColumn("child", F.lit("p0"))
    directs = t.sql("SELECT 'p' || CAST(p_partkey AS STRING) AS name FROM part WHERE p_type = 'PROMO' OR p_partkey = 0")
    return edges, targets, edges.select("repo", F.explode(F.array("src", "dst")).alias("name")).distinct().join(directs, "name", "left_semi")


@query("dependency_paths", PATHS_SQL)
def _(t):
    edges, targets, directs = graph_inputs(t)
    return graph.paths_to(edges, targets, directs).withColumn("path", F.array_join("path", ">"))


@query(
    "remediation_plan",
    f"""WITH r AS ({PATHS_SQL.replace("WITH RECURSIVE", "WITH RECURSIVE")}), v AS (
          SELECT DISTINCT repo, name, CASE WHEN name = 'p8' THEN NULL ELSE '2.0.0' END AS target FROM (SELECT repo, unnest(['p0', 'p8', 'gone', 'p16']) AS name FROM (SELECT DISTINCT repo FROM ({EDGES}) e1) q) w)
        SELECT v.repo, v.name, v.target, CASE WHEN target IS NULL THEN 'none' WHEN v.name = 'p16' THEN 'direct' WHEN v.name = 'gone' THEN 'none' ELSE 'parent' END AS kind,
               CASE WHEN v.name = 'p0' THEN (SELECT count(*) FROM r WHERE r.repo = v.repo AND direct <> 'p0') ELSE 0 END AS n_parents,
               CASE WHEN v.name = 'p0' THEN (SELECT min(direct) FROM r WHERE r.repo = v.repo AND direct <> 'p0') END AS first_parent,
               CASE WHEN target IS NULL THEN v.name || ' has no published fix' WHEN v.name = 'gone' THEN 'no direct dependency''s tree reaches gone, so nothing can be bumped to move it' END AS reason FROM v""",
)
def _(t):
    edges, targets, directs = graph_inputs(t)
    repos = edges.select("repo").distinct()
    names = F.explode(F.array(F.lit("p0"), F.lit("p8"), F.lit("gone"), F.lit("p16"))).alias("name")
    vulnerable = repos.select("repo", names).withColumn("target", F.when(F.col("name") != "p8", "2.0.0"))
    own = directs.filter("name <> 'p0'").unionByName(repos.withColumn("name", F.lit("p16")))
    paths = graph.paths_to(edges, targets, directs.filter("name <> 'p0'"))
    return graph.plan_remediation(vulnerable, own, paths)


@query(
    "override_plan",
    """SELECT repo, name, '3.1.0' AS version, stated, 'force ' || name || ' to 3.1.0, which no dependency''s own range selects' AS reason FROM (
         SELECT CAST(p_partkey AS STRING) AS repo, 'pkg' || p_size AS name, CASE p_partkey % 3 WHEN 0 THEN '3.1.0' WHEN 1 THEN '2.0.0' END AS stated FROM part) x WHERE stated IS DISTINCT FROM '3.1.0'""",
)
def _(t):
    from ..sources.manifests import overrides

    p = t.table("part")
    repo, name = F.col("p_partkey").cast("string"), F.concat(F.lit("pkg"), F.col("p_size").cast("string"))
    stated = F.when(F.col("p_partkey") % 3 == 0, "3.1.0").when(F.col("p_partkey") % 3 == 1, "2.0.0")
    manifest = F.when(stated.isNull(), F.lit('{"name":"x"}')).otherwise(F.concat(F.lit('{"overrides":{"'), name, F.lit('":"'), stated, F.lit('"}}')))
    have = overrides(p.select(repo.alias("repo"), manifest.alias("content")))
    return graph.plan_overrides(p.select(repo.alias("repo"), name.alias("name"), F.lit("3.1.0").alias("version")), have)


# --- renames -----------------------------------------------------------------------------------------------------

RENAME_SQL = """
WITH rm AS (SELECT pkg, path, before FROM expected_changes WHERE kind = 'removed'),
     tt AS (SELECT pkg, path, signature, lower(regexp_replace(signature, '[$_ ]', '', 'g')) AS loose, CASE WHEN path LIKE '%.%' THEN string_split(path, '.')[1] ELSE '' END AS parent
            FROM symbols_to WHERE NOT deprecated),
     x AS (SELECT rm.pkg, rm.path, count(*) FILTER (WHERE tt.signature = rm.before) AS ne, count(*) AS nl, min(tt.path) FILTER (WHERE tt.signature = rm.before) AS pe, min(tt.path) AS pl
           FROM rm JOIN tt ON rm.pkg = tt.pkg AND tt.parent = CASE WHEN rm.path LIKE '%.%' THEN string_split(rm.path, '.')[1] ELSE '' END
             AND tt.loose = lower(regexp_replace(rm.before, '[$_ ]', '', 'g')) GROUP BY rm.pkg, rm.path)
SELECT pkg, path, CASE WHEN ne = 1 THEN pe ELSE pl END AS renamed_to, CASE WHEN ne = 1 THEN 100 ELSE 80 END AS score FROM x WHERE ne = 1 OR (ne = 0 AND nl = 1)
"""
R = ("expected_changes", "symbols_to")


def found_renames(t: Tables):
    removed = changes(t).filter("kind = 'removed'").select("pkg", "path", "before")
    return renames.find_renames(removed, symbols(t, "to"))


@query("rename_candidates", RENAME_SQL, R)
def _(t):
    return found_renames(t)


@query(
    "rename_edits",
    f"""SELECT s.repo, s.file, s.line, s.col, string_split(r.path, '.')[-1] AS find, string_split(r.renamed_to, '.')[-1] AS replace,
               r.path || ' was removed in ' || h.to_version || '; ' || r.renamed_to || ' has the equivalent signature' AS reason, s.pkg, s.symbol, r.score
        FROM (SELECT DISTINCT * FROM call_sites WHERE via = 'type') s JOIN ({RENAME_SQL}) r ON s.pkg = r.pkg AND s.symbol = r.path JOIN surface_headers h ON s.pkg = h.pkg""",
    R + ("call_sites", "surface_headers"),
)
def _(t):
    sites = t.view("call_sites").distinct()
    return renames.rename_edits(found_renames(t), sites, t.view("surface_headers"))


@query(
    "name_words",
    """SELECT k, leaf || '_next_more' AS longer, true AS inserts, false AS reversed FROM api_parts""",
    ("api_parts",),
)
def _(t):
    longer = F.concat("leaf", F.lit("_next_more"))
    a, b = renames.words(F.col("leaf")), renames.words(longer)
    return t.view("api_parts").select("k", longer.alias("longer"), renames.inserts_into(a, b).alias("inserts"), renames.inserts_into(b, a).alias("reversed"))


SUGGEST = """
SELECT p_brand AS pkg, 'c' || CAST(p_size % 6 AS STRING) || '.' || lower(replace(p_name, ' ', '_')) || CASE WHEN p_size % 3 = 0 THEN '' ELSE '_' || lower(p_type) END AS path,
       bool_and(p_size % 7 = 0) AS deprecated FROM part GROUP BY 1, 2
"""
ASKED = "SELECT DISTINCT p_brand AS pkg, 'c' || CAST(p_size % 6 AS STRING) || '.' || lower(replace(p_name, ' ', '_')) AS path FROM part"
SCORE_SQL = """CASE WHEN n = l AND cp = pp THEN 0 WHEN n = l THEN 1 WHEN contains(n, l) THEN 2 WHEN contains(l, n) THEN 3
  WHEN len(string_split(l, '_')) >= 2 AND regexp_matches('_' || n || '_', '_' || replace(l, '_', '_(.*_)?') || '_') THEN 4 ELSE 5 END"""
SUGGEST_SQL = f"""
SELECT pkg, path, candidate, {SCORE_SQL} AS score FROM (
  SELECT a.pkg, a.path, s.path AS candidate, string_split(s.path, '.')[2] AS n, string_split(a.path, '.')[2] AS l, string_split(s.path, '.')[1] AS cp, string_split(a.path, '.')[1] AS pp
  FROM ({ASKED}) a JOIN ({SUGGEST}) s ON a.pkg = s.pkg AND NOT s.deprecated
    AND (string_split(s.path, '.')[1] = string_split(a.path, '.')[1] OR string_split(s.path, '.')[2] = string_split(a.path, '.')[2])) x
"""


@query("related_symbols", f"SELECT * FROM ({SUGGEST_SQL}) s WHERE score < 5")
def _(t):
    return renames.related_symbols(t.sql(ASKED), t.sql(SUGGEST))


@query(
    "top_suggestions",
    f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pkg, path ORDER BY score, candidate) AS rank FROM ({SUGGEST_SQL}) s) x WHERE rank <= 8",
)
def _(t):
    return renames.top_suggestions(t.sql(ASKED), t.sql(SUGGEST), 8).withColumn("rank", F.col("rank").cast("bigint"))


# --- completeness and compiler output ----------------------------------------------------------------------------

CHECK_FILES = """
SELECT lang AS repo, 'd' || CAST(doc_id AS STRING) AS file, CASE WHEN doc_id % 4 = 0 THEN 'import { Old as O, type Other } from "lib/sub";' ELSE '' END || text AS content FROM documents
"""
CHECKS = """
SELECT repo, check_id, kind, pattern, symbol, pkg FROM (SELECT DISTINCT lang AS repo FROM documents) r,
  (VALUES ('gone', 'absent', 'zzz[0-9]+zzz', NULL, NULL), ('the', 'absent', 'the [a-z]+ion', NULL, NULL), ('bad', 'absent', '(unclosed', NULL, NULL),
          ('old', 'import', NULL, 'Old', 'lib'), ('other', 'import', NULL, 'O', 'lib'), ('lone', 'absent', '[[]x', NULL, NULL)) c(check_id, kind, pattern, symbol, pkg)
"""


@query(
    "completeness_checks",
    f"""WITH f AS ({CHECK_FILES}), n AS (SELECT repo, count(*) FILTER (WHERE regexp_matches(content, 'zzz[0-9]+zzz')) AS gone, count(*) FILTER (WHERE regexp_matches(content, 'the [a-z]+ion')) AS the,
            count(*) FILTER (WHERE content LIKE 'import %') AS old, count(*) FILTER (WHERE contains(content, '[x')) AS lone FROM f GROUP BY repo)
        SELECT repo, check_id, CASE WHEN check_id = 'bad' THEN 'unknown' WHEN v > 0 THEN 'unresolved' ELSE 'resolved' END AS state, v AS n_files,
               CASE WHEN check_id = 'bad' THEN 'the pattern could not be read' END AS reason
        FROM (SELECT repo, unnest(['gone', 'the', 'bad', 'old', 'other', 'lone']) AS check_id, unnest([gone, the, 0, old, 0, lone]) AS v FROM n) x""",
)
def _(t):
    repos = t.table("documents").select(F.col("lang").alias("repo")).distinct()

    def check(check_id, kind, pattern=None, symbol=None, pkg=None):
        return F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("check_id", "kind", "pattern", "symbol", "pkg"), (check_id, kind, pattern, symbol, pkg))])

    checks = repos.select(
        "repo",
        F.inline(
            F.array(
                check("gone", "absent", "zzz[0-9]+zzz"),
                check("the", "absent", "the [a-z]+ion"),
                check("bad", "absent", "(unclosed"),
                check("old", "import", None, "Old", "lib"),
                check("other", "import", None, "O", "lib"),
                check("lone", "absent", "[[]x"),
            )
        ),
    )
    return quality.resolve_checks(checks, t.sql(CHECK_FILES))


@query(
    "deprecation_still_present",
    f"""SELECT file, CAST(substr(file, 2) AS BIGINT) % 4 = 0 AS imported, regexp_matches(content, '[.]\\s*The\\b') AS accessed FROM ({CHECK_FILES}) f""",
)
def _(t):
    f = t.sql(CHECK_FILES)
    return f.select(
        "file",
        imports.deprecation_still_present(F.lit("Old"), F.lit("lib"), F.col("content")).alias("imported"),
        imports.deprecation_still_present(F.lit("Box.The"), F.lit("lib"), F.col("content")).alias("accessed"),
    )


@query(
    "missing_symbols",
    """SELECT k, CASE WHEN k % 3 = 0 THEN leaf || ',' || ret ELSE leaf END AS missing FROM api_parts""",
    ("api_parts",),
)
def _(t):
    p = t.view("api_parts")
    line = F.concat(F.lit("src/a.ts(1,2): error TS2305: Module has no exported member '"), "leaf", F.lit("'.\nsrc/b.ts(3,4): error TS2304: Cannot find name '"), "leaf", F.lit("'.\n"))
    more = F.when(F.col("k") % 3 == 0, F.concat(F.lit("x.ts(1,1): error: Property '"), "ret", F.lit("' does not exist on type 'Q'."))).otherwise("")
    return p.select("k", F.array_join(quality.missing_symbols(F.concat(line, more)), ",").alias("missing"))


@query(
    "files_named_in_output",
    """SELECT DISTINCT repo, CASE WHEN k % 4 = 0 THEN 'web/' ELSE '' END || 'src/' || leaf || '.tsx' AS file FROM (SELECT *, CAST(k % 25 AS STRING) AS repo FROM api_parts) x WHERE k % 5 <> 0""",
    ("api_parts",),
)
def _(t):
    p = t.view("api_parts").withColumn("repo", (F.col("k") % 25).cast("string"))
    name = F.concat(F.lit("src/"), "leaf", F.lit(".tsx"))
    outputs = p.select("repo", F.concat(F.lit("node_modules/x/y.ts:1:1 bad\n  "), name, F.lit("(3,4): error TS1: no\nsee '"), name, F.lit("' and readme.md")).alias("output"))
    files = p.filter("k % 5 <> 0").select("repo", F.concat(F.when(F.col("k") % 4 == 0, "web/").otherwise(""), name).alias("file"))
    spaces = p.select("repo", F.explode(F.array(F.lit(""), F.lit("web"))).alias("workspace"))
    return quality.files_named_in_output(outputs, files, spaces)


@query(
    "strip_parameter_any",
    """SELECT k, '(a, b?: ' || t || ', c?, d: any[]) => any' AS text, 2 AS removed FROM api_parts""",
    ("api_parts",),
)
def _(t):
    source = F.concat(F.lit("(a: any, b?: "), "t", F.lit(", c? : any, d: any[]) => any"))
    return t.view("api_parts").select("k", quality.strip_parameter_any(source).alias("s")).select("k", "s.text", "s.removed")


@query(
    "deprecation_gap_texts",
    """SELECT DISTINCT repo, '- `' || string_split(symbol, '.')[-1] || '` is deprecated in ' || pkg || ' and is still imported by: ' AS head, file FROM call_sites""",
    ("call_sites",),
)
def _(t):
    return quality.describe_gaps(t.view("call_sites"))


# --- verdicts ------------------------------------------------------------------------------------------------------

RUNS = """
SELECT CAST(l_orderkey AS STRING) AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'baseline' ELSE 'post' END AS phase, CASE WHEN l_linenumber % 4 < 2 THEN 'typecheck' ELSE 'test' END AS command,
       l_returnflag <> 'R' AS ok, l_linestatus = 'F' AS skipped FROM lineitem
"""


@query(
    "verification_verdicts",
    f"""WITH w AS (SELECT id, {", ".join(f"bool_or({f}) FILTER (WHERE phase = '{p}' AND command = '{c}') AS {p[0]}{c[0:2]}{f[0]}" for p in ("baseline", "post") for c in ("typecheck", "test") for f in ("ok", "skipped"))}
          FROM ({RUNS}) r GROUP BY id),
        x AS (SELECT id, (coalesce(btys, true) OR btyo) AND (coalesce(btes, true) OR bteo) AS b, (coalesce(ptys, true) OR ptyo) AND (coalesce(ptes, true) OR pteo) AS p,
                     coalesce(ptys, true) AS ty, coalesce(ptes, true) AS te FROM w)
        SELECT id, CASE WHEN ty AND te THEN 'unverified' WHEN NOT b AND NOT p THEN 'pre-existing-failure' WHEN b AND NOT p THEN 'regression' WHEN te AND NOT ty THEN 'typecheck-only' ELSE 'verified' END AS outcome FROM x""",
)
def _(t):
    return quality.verdicts(t.sql(RUNS))


@query(
    "repair_errors",
    """SELECT l_orderkey AS id, max(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 9 END) AS after_bump, max(CASE WHEN l_linenumber % 2 = 1 THEN l_partkey % 9 END) AS after_repair FROM lineitem GROUP BY 1""",
)
def _(t):
    runs = t.table("lineitem").select(
        F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "bump").otherwise("repair").alias("stage"), (F.col("l_partkey") % 9).alias("n_errors")
    )
    return quality.repair_errors(runs)


O = ("repair_outcomes", "repair_cases")


@query(
    "repair_routes",
    """SELECT doc_id, doc_id % 4 = 0 AS needs_source_repair, (doc_id % 3 = 0 AND verdict NOT IN ('verified', 'typecheck-only')) AS repairable_after_bump FROM repair_outcomes""",
    O,
)
def _(t):
    o = t.view("repair_outcomes").select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, "http-contract").otherwise("surface").alias("detector"), (F.col("doc_id") % 3 == 0).alias("resolved"), F.col("verdict").alias("outcome")
    )
    return quality.repair_routes(o).select("doc_id", "needs_source_repair", "repairable_after_bump")


PROPOSE = "SELECT model AS repo, doc_id AS seq, verdict AS outcome, edits_applied AS n_changed FROM repair_outcomes"


@query(
    "proposals",
    f"""SELECT repo, seq, row_number() OVER (PARTITION BY repo ORDER BY seq) <= 3 AS within FROM ({PROPOSE}) p WHERE outcome IN ('verified', 'typecheck-only') AND n_changed > 0""",
    O,
)
def _(t):
    return quality.proposals(t.sql(PROPOSE, "repair_outcomes"), 3)[0].select("repo", "seq", "within")


@query(
    "proposals_skipped",
    f"SELECT repo, greatest(count(*) - 3, 0) AS n_skipped FROM ({PROPOSE}) p WHERE outcome IN ('verified', 'typecheck-only') AND n_changed > 0 GROUP BY repo",
    O,
)
def _(t):
    return quality.proposals(t.sql(PROPOSE, "repair_outcomes"), 3)[1]


# --- scoring -------------------------------------------------------------------------------------------------------


def scores(t: Tables):
    o = t.view("repair_outcomes")

    def names(column, tag):
        n = F.col(column)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit(tag), i.cast("string"))))

    return scoring.score_cases(
        t.view("repair_cases"), o.withColumns({"unresolved": names("n_unresolved", "s"), "uncheckable": names("n_uncheckable", "q")}).drop("n_unresolved", "n_uncheckable")
    )


SCORE_ROWS = """
SELECT *, verdict IN ('verified', 'typecheck-only') AS passed, edits_applied / greatest(1, minimal_edits) AS edit_ratio,
       CASE WHEN errors_before IS NULL OR errors_before = 0 THEN NULL ELSE greatest(0, (errors_before - errors_after) / errors_before) END AS error_reduction,
       verdict = 'verified' AND inconclusive IS NULL AND deprecation_gaps = 0 AND type_escapes = 0 AND n_unresolved = 0 AND n_uncheckable = 0 AS clean
FROM repair_outcomes JOIN repair_cases USING (case_id)
"""


@query(
    "case_scores",
    f"""SELECT doc_id, passed, clean, round(edit_ratio, 6) AS edit_ratio, round(error_reduction, 6) AS error_reduction, concat_ws(' | ',
          CASE WHEN inconclusive IS NOT NULL THEN 'INCONCLUSIVE — ' || inconclusive WHEN NOT passed THEN 'did not verify (' || verdict || ')' END,
          CASE WHEN deprecation_gaps > 0 THEN deprecation_gaps || ' deprecation(s) reported and left in place' END,
          CASE WHEN type_escapes > 0 THEN type_escapes || ' type escape(s) — a green build bought with `any`' END,
          CASE WHEN n_unresolved > 0 THEN '1 symbol(s) left in their pre-migration form: s1' END,
          CASE WHEN n_uncheckable > 0 THEN 'could not check 2 completeness requirement(s): q1, q2' END,
          CASE WHEN verdict = 'typecheck-only' THEN 'the tests did not run, so behaviour is unverified' END) AS penalties FROM ({SCORE_ROWS}) s""",
    O,
)
def _(t):
    return scores(t).select(
        "doc_id", "passed", "clean", F.round("edit_ratio", 6).alias("edit_ratio"), F.round("error_reduction", 6).alias("error_reduction"), F.array_join("penalties", " | ").alias("penalties")
    )


SUMMARY_SQL = f"""
SELECT model, harness, count(*) AS runs, count(DISTINCT case_id) AS cases_run, count(inconclusive) AS inconclusive,
       round(count(*) FILTER (WHERE inconclusive IS NULL AND passed) / greatest(1, count(*) - count(inconclusive)), 6) AS pass_rate,
       round(count(*) FILTER (WHERE inconclusive IS NULL AND clean) / greatest(1, count(*) - count(inconclusive)), 6) AS clean_rate,
       round(avg(error_reduction) FILTER (WHERE inconclusive IS NULL AND NOT passed), 6) AS mean_error_reduction,
       round(coalesce(avg(edit_ratio) FILTER (WHERE inconclusive IS NULL AND passed), 0), 6) AS mean_edit_ratio,
       CAST(sum(type_escapes) AS BIGINT) AS total_type_escapes, CAST(sum(deprecation_gaps) AS BIGINT) AS total_deprecation_gaps,
       CAST(sum(edits_withheld) AS BIGINT) AS total_edits_withheld, CAST(sum(n_unresolved) AS BIGINT) AS total_unresolved, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms
FROM ({SCORE_ROWS}) s GROUP BY model, harness
"""


def rounded_summary(t: Tables):
    out = scoring.summarise(scores(t))
    for c in ("pass_rate", "clean_rate", "mean_error_reduction", "mean_edit_ratio"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("engine_summary", SUMMARY_SQL, O)
def _(t):
    return rounded_summary(t)


@query(
    "engine_leaderboard",
    f"SELECT model, harness, clean_rate, round(greatest(mean_edit_ratio - 1, 0), 6) AS over_edit FROM ({SUMMARY_SQL}) s ORDER BY clean_rate DESC, over_edit, model, harness",
    O,
)
def _(t):
    return scoring.leaderboard(rounded_summary(t)).select("model", "harness", "clean_rate", F.round("over_edit", 6).alias("over_edit"))
