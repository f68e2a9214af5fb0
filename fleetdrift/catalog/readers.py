"""Reader queries: text that Spark builds from the tables is read back and compared with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reporting
from ..sources import files as file_source
from ..sources import imports, lockfiles, logs, manifests, requirements, symbols
from . import Tables, query

L = ("lock_entries",)


def joined(t: Tables, piece, head: str = "", tail: str = "", separator: str = ""):
    """repo, content: one text per order, made of its entries in order."""
    rows = t.view("lock_entries").select("repo", "n", piece.alias("piece"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"])
    return rows.groupBy("repo").agg(F.concat(F.lit(head), F.array_join(parts, separator), F.lit(tail)).alias("content"))


def c(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def name(of=F.col):
    return of("name")


def version(of=F.col):
    return of("version")


def key(of=F.col):
    return of("k")


def file_texts(t: Tables, kinds):
    """repo, file, content of several kinds of files, of one pass over the entries.

    ``kinds``: per file (when, piece, head, tail, separator); ``piece`` makes an entry's text of its fields, as ``name`` does.
    """
    entries = t.view("lock_entries").groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("n", "name", "version", "k", "dev"))).alias("e"))

    def text(file, when, piece, head="", tail="", separator=""):
        content = F.concat(F.lit(head), F.array_join(F.transform("e", lambda e: piece(e.__getitem__)), separator), F.lit(tail))
        return F.when(when, F.struct(F.lit(file).alias("file"), content.alias("content")))

    texts = F.array(*[text(file, *kind) for file, kind in kinds.items()])
    return entries.select("repo", F.inline_outer(texts)).filter("file IS NOT NULL")


YARN_HEAD = "# yarn lockfile v1\n\n__metadata:\n  version: 6\n\n"


def yarn_block(of=F.col):
    return c('"@s/', name(of), '@^1.0.0", ', name(of), "@npm:~1, w", name(of), "@workspace:.:\n  version ", F.when(key(of) % 2 == 0, c('"', version(of), '"')).otherwise(version(of)), "\n  dependencies:\n    version \"9.9.9\"\n\n")


def yarn_files(t: Tables):
    return joined(t, yarn_block(), YARN_HEAD).withColumn("file", F.lit("yarn.lock"))


@query(
    "yarn_lock",
    """SELECT repo, 'yarn.lock' AS file, x.name, arg_min(version, n) AS version, CAST(min(n) * 5 + 1 AS INT) AS line
       FROM (SELECT repo, unnest(['@s/' || name, name]) AS name, version, n FROM lock_entries) x GROUP BY repo, x.name""",
    L,
)
def _(t):
    return lockfiles.yarn_lock(yarn_files(t))


@query(
    "pnpm_lock",
    """SELECT repo, 'pnpm-lock.yaml' AS file, name, arg_min(version, n) AS version, CAST(min(n) * 2 + 2 AS INT) AS line FROM lock_entries GROUP BY repo, name""",
    L,
)
def _(t):
    entry = F.when(key() % 3 == 0, c("  /", name(), "/", version(), "(peer@1.0.0):")).when(key() % 3 == 1, c("  '", name(), "@", version(), "':")).otherwise(c("  ", name(), "@", version(), "(react@18.0.0):"))
    text = joined(t, c(entry, "\n    resolution: {x: y}\n"), "lockfileVersion: 6\nimporters:\n  ghost@9.9.9:\npackages:\n", "settings:\n  late@1.0.0:\n")
    return lockfiles.pnpm_lock(text.withColumn("file", F.lit("pnpm-lock.yaml")).withColumn("content", F.regexp_replace("content", "^lockfileVersion: 6\nimporters:\n  ghost@9.9.9:\n", "importers:\n  ghost@9.9.9:\n")))


@query(
    "toml_lock",
    """SELECT repo, 'uv.lock' AS file, name, arg_min(version, n) AS version, CAST(min(n) * 5 - 1 AS INT) AS line FROM lock_entries GROUP BY repo, name""",
    L,
)
def _(t):
    block = c('[[package]]\nname = "', name(), '"\nversion = "', version(), '"\n[package.optional]\nversion = "0.0.0"\n')
    return lockfiles.toml_lock(joined(t, block, 'version = 1\nname = "root"\n\n').withColumn("file", F.lit("uv.lock")))


@query(
    "bun_lock",
    """SELECT repo, 'bun.lock' AS file, name, arg_min(version, n) AS version, CAST(arg_min(n, n) + 2 AS INT) AS line
       FROM (SELECT *, min(n) OVER (PARTITION BY repo, name, version) AS first_same FROM lock_entries) e GROUP BY repo, name""",
    L,
)
def _(t):
    entry = c('    "', name(), "/", F.col("n"), '": ', F.when(key() % 2 == 0, c('["', name(), "@", version(), '", "", {}, "sha"]')).otherwise(c('"', name(), "@", version(), '"')), ",\n")
    return lockfiles.bun_lock(joined(t, entry, '{\n  "packages": {\n', "  },\n}\n").withColumn("file", F.lit("bun.lock")))


@query(
    "pipfile_lock",
    """SELECT repo, 'Pipfile.lock' AS file, name, coalesce(max(CASE WHEN NOT dev THEN version END), max(version)) AS version
       FROM (SELECT repo, name || '-' || n AS name, dev, version, k FROM lock_entries UNION ALL SELECT repo, 'both', dev, CASE WHEN dev THEN '2.0' ELSE '1.0' END, 0 FROM lock_entries) e
       WHERE k % 5 <> 1 GROUP BY repo, name""",
    L,
)
def _(t):
    """Entries in ``default`` or ``develop``, one name in both; a version without ``==`` is no pin."""
    e = t.view("lock_entries")

    def group(dev):
        entry = c('"', name(), "-", F.col("n"), '": {"version": "', F.when(key() % 5 == 1, ">=").otherwise("=="), version(), '"}')
        both = c('"both": {"version": "==', "2.0" if dev else "1.0", '"}')
        mine = F.when(F.col("dev") == dev, entry)
        return F.array_join(F.concat(F.array_sort(F.collect_list(mine)), F.collect_set(F.when(F.col("dev") == dev, both))), ",")

    text = e.groupBy("repo").agg(c('{"_meta": {}, "default": {', group(False), '}, "develop": {', group(True), "}}").alias("content"))
    return lockfiles.pipfile_lock(text.withColumn("file", F.lit("Pipfile.lock")))


NPM_TEXT = ('{"lockfileVersion":3,"packages":{"":{"name":"root","version":"1.0.0"},', "}}", ",")


def npm_entry(of=F.col):
    k, n = key(of), name(of)
    place = F.when(k % 4 == 0, c("node_modules/host/node_modules/", n)).when(k % 4 == 1, c("node_modules/@s/", n)).otherwise(c("node_modules/", n))
    more = (
        F.when(k % 10 == 3, ',"link":true')
        .when(k % 10 == 5, ',"resolved":"git+ssh://x"')
        .when(k % 10 == 7, c(',"resolved":"https://r/x.tgz","name":"alias-', n, '"'))
        .otherwise(',"resolved":"https://r/y.tgz"')
    )
    deps = c(',"dependencies":{"dep', k % 7, '":"^1","other":"*"}')
    return c('"', place, "-", of("n"), '":{"version":"', version(of), '"', F.when(of("dev"), ',"dev":true').otherwise(""), more, deps, "}")


def npm_files(t: Tables):
    return joined(t, npm_entry(), *NPM_TEXT)


NPM_PLACE = "CASE k % 4 WHEN 0 THEN 'node_modules/host/node_modules/' || name WHEN 1 THEN 'node_modules/@s/' || name ELSE 'node_modules/' || name END || '-' || n"


@query(
    "npm_lock",
    f"""SELECT repo, {NPM_PLACE} AS install_path, CASE WHEN k % 10 = 7 THEN 'alias-' || name ELSE CASE WHEN k % 4 = 1 THEN '@s/' ELSE '' END || name || '-' || n END AS name, version, dev,
              CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '@s/' || name || '-' || n ELSE name || '-' || n END AS top_name FROM lock_entries
        WHERE k % 10 NOT IN (3, 5) AND (k % 4 <> 9)""",
    L,
)
def _(t):
    return lockfiles.npm_lock(npm_files(t))


@query(
    "npm_lock_edges",
    """SELECT repo, CASE WHEN k % 4 = 1 THEN '@s/' ELSE '' END || name || '-' || n AS src, unnest(['dep' || k % 7, 'other']) AS dst FROM lock_entries""",
    L,
)
def _(t):
    return lockfiles.npm_edges(npm_files(t))


@query(
    "npm_lock_old_layout",
    "SELECT DISTINCT repo, 'node_modules/' || name || '-' || n AS install_path, name || '-' || n AS name, version, false AS dev, name || '-' || n AS top_name FROM lock_entries",
    L,
)
def _(t):
    return lockfiles.npm_lock(joined(t, c('"', name(), "-", F.col("n"), '":{"version":"', version(), '"}'), '{"lockfileVersion":1,"dependencies":{', "}}", ","))


@query(
    "lockfile_status",
    """SELECT repo, 'yarn.lock' AS file, CASE WHEN o % 3 = 0 THEN 2 * count(DISTINCT name) ELSE 0 END AS n_versions, CASE WHEN o % 3 = 1 THEN 'unsupported' ELSE 'read' END AS status FROM lock_entries GROUP BY repo, o""",
    L,
)
def _(t):
    k = F.col("repo").cast("bigint") % 3
    texts = yarn_files(t).withColumn("content", F.when(k == 0, F.col("content")).when(k == 1, F.lit("<<<<<<< merge\n")).otherwise(F.lit(" \n")))
    return lockfiles.lockfile_status(texts, lockfiles.yarn_lock(texts)).withColumn("n_versions", F.col("n_versions").cast("bigint"))


# --- requirements --------------------------------------------------------------------------------------------------


def requirement_text():
    form = key() % 6
    return (
        F.when(form == 0, c(name(), "==", version(), " # pinned\n"))
        .when(form == 1, c(name(), "[extra]>=", version(), ",<9 ; python_version < '3.9'\n"))
        .when(form == 2, c(name(), "==", version(), " \\\n    --hash=sha256:abc\n"))
        .when(form == 3, c("  ", name(), "==1.*\n"))
        .when(form == 4, c("# ", name(), "==0\n", name(), " === ", version(), "\n"))
        .otherwise(c("--no-binary ", name(), "\n", name(), "\n"))
    )


REQ_SQL = """
SELECT repo, name, n, CASE WHEN k % 6 IN (0, 2, 4) THEN version END AS version, CASE k % 6 WHEN 1 THEN '>=' || version || ',<9' WHEN 3 THEN '==1.*' WHEN 5 THEN '' END AS declared FROM lock_entries
"""


@query(
    "requirements",
    f"""SELECT repo, name, version, declared FROM (SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY n) AS r FROM ({REQ_SQL}) q) x WHERE r = 1""",
    L,
)
def _(t):
    texts = joined(t, requirement_text(), "-i https://index\n\n").withColumn("file", F.lit("requirements.txt"))
    return requirements.requirements(texts).select("repo", "name", "version", "declared")


@query(
    "requirement_includes",
    """SELECT repo, CASE WHEN k % 2 = 0 THEN 'requirements' ELSE 'constraints' END AS kind, 'r/' || name || '.txt' AS target FROM lock_entries""",
    L,
)
def _(t):
    form = key() % 4
    text = F.when(form == 0, "-r ").when(form == 1, "-c ").when(form == 2, "--requirement=").otherwise("--constraint ")
    texts = joined(t, c(text, "r/", name(), ".txt # see\n"), "pkg==1\n").withColumn("file", F.lit("requirements.txt"))
    return requirements.includes(texts).select("repo", "kind", "target")


# Every customer is a repository: the root includes its orders' files in order, and each file includes the next.
TREE = """
SELECT o_custkey AS cust, CAST(o_custkey AS STRING) AS repo, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i,
       lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt, o_orderstatus = 'P' AS constrains_next,
       'Pkg_' || CAST(o_orderkey % 12 AS STRING) AS name, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS STRING) || '.0' END AS version
FROM orders
"""


def tree_files(t: Tables):
    rows = t.sql(TREE)
    own = F.when(F.col("version").isNull(), c(F.col("name"), ">=1\n")).otherwise(c(F.col("name"), "==", F.col("version"), "\n"))
    step = F.when(F.col("nxt").isNull(), "").otherwise(c(F.when(F.col("constrains_next"), "-c ").otherwise("-r "), "../reqs/./", F.col("nxt"), ".txt\n"))
    files = rows.select("repo", c("reqs/", F.col("o"), ".txt").alias("file"), c(own, step, "-r missing.txt\n-r https://x/y.txt\n").alias("content"))
    root = rows.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda o: c("-r reqs/", o, ".txt\n")), "").alias("content"))
    return files.unionByName(root.select("repo", F.lit("requirements.txt").alias("file"), "content"))


WALK_SQL = f"""
SELECT *, coalesce(bool_or(constrains_next) OVER (PARTITION BY cust ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS as_constraints FROM ({TREE}) x
"""


@query(
    "include_tree",
    f"SELECT repo, 'reqs/' || o || '.txt' AS file, as_constraints FROM ({WALK_SQL}) w UNION ALL SELECT DISTINCT repo, 'requirements.txt', false FROM ({TREE}) r",
)
def _(t):
    return requirements.include_tree(tree_files(t)).select("repo", "file", "as_constraints")


@query(
    "requirements_tree",
    f"""WITH w AS ({WALK_SQL}), own AS (SELECT repo, name, arg_min(coalesce(version, '>=1'), i) AS v, arg_min(version IS NOT NULL, i) AS pinned, min(i) AS i FROM w WHERE NOT as_constraints GROUP BY repo, name),
            lim AS (SELECT repo, name, arg_min(version, i) AS v FROM w WHERE as_constraints AND version IS NOT NULL GROUP BY repo, name)
        SELECT own.repo, own.name, CASE WHEN pinned THEN own.v ELSE lim.v END AS version, CASE WHEN NOT pinned AND lim.v IS NULL THEN own.v END AS declared
        FROM own LEFT JOIN lim ON own.repo = lim.repo AND own.name = lim.name""",
)
def _(t):
    return requirements.requirements_tree(tree_files(t)).select("repo", "name", "version", "declared")


@query(
    "canonical_names",
    "SELECT k, lower(replace(leaf, '_', '-')) || '-x' AS canonical, 'A.' || leaf AS required FROM api_parts",
    ("api_parts",),
)
def _(t):
    from ..functions.paths import canonical_name

    leaf = F.col("leaf")
    return t.view("api_parts").select(
        "k", canonical_name(F.concat(leaf, F.lit("__.X"))).alias("canonical"), requirements.requirement_name(c("  A.", leaf, " [x] >=1 # y")).alias("required")
    )


# --- manifests and registries ---------------------------------------------------------------------------------------


def manifest_files(t: Tables):
    d = t.view("declared_rows").withColumn("key", F.concat("name", F.lit("-"), F.col("seq").cast("string")))
    entry = c('"', F.col("key"), '":"', F.col("declared"), '"')

    def group(dev):
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("dev") == dev, entry))), ",")

    body = c('{"name":"m","dependencies":{', group(False), '},"devDependencies":{', group(True), "}}")
    return d.groupBy("repo", "workspace").agg(body.alias("content"))


@query(
    "manifest_dependencies",
    """SELECT repo, workspace, name || '-' || seq AS name, declared, dev FROM declared_rows WHERE declared NOT LIKE 'workspace:%' AND declared NOT LIKE 'file:%'""",
    ("declared_rows",),
)
def _(t):
    return manifests.manifest_dependencies(manifest_files(t))


@query(
    "manifest_status",
    "SELECT DISTINCT repo, workspace, CASE WHEN workspace = 'ws3' THEN 'unreadable' ELSE 'read' END AS status FROM declared_rows",
    ("declared_rows",),
)
def _(t):
    broken = F.when(F.col("workspace") == "ws3", F.lit("{ not json")).otherwise(F.col("content"))
    return manifests.manifest_status(manifest_files(t).withColumn("content", broken))


# a hundred parts of a brand share one package document
DOCUMENTED = "SELECT ecosystem, version, k, pkg || '-' || CAST(CAST(floor(k / 2500) AS BIGINT) AS STRING) AS pkg FROM versions"


def catalogue(t: Tables, eco: str):
    v = t.sql(f"SELECT * FROM ({DOCUMENTED}) d", "versions").filter(F.col("ecosystem") == eco).withColumn("doc_version", F.concat("version", F.lit("-"), F.col("k").cast("string")))
    entry = F.array_join(F.array_sort(F.collect_list(c('"', F.col("doc_version"), '":{"x":1}'))), ",")
    latest = F.max("doc_version")
    if eco == "npm":
        body = c('{"name":"', F.col("pkg"), '","dist-tags":{"latest":"', latest, '"},"versions":{', entry, "}}")
    else:
        body = c('{"info":{"name":"', F.col("pkg"), '","version":"', latest, '"},"releases":{', F.array_join(F.array_sort(F.collect_list(c('"', F.col("doc_version"), '":[{"y":2}]'))), ","), "}}")
    return v.groupBy("pkg").agg(body.alias("content")).select("content")


CATALOGUE_SQL = f"SELECT ecosystem, pkg AS name, version || '-' || k AS version, max(version || '-' || k) OVER (PARTITION BY ecosystem, pkg) AS latest FROM ({DOCUMENTED}) d"


@query("registry_catalogue", CATALOGUE_SQL, ("versions",))
def _(t):
    (ta, va), (tb, vb) = manifests.npm_catalogue(catalogue(t, "npm")), manifests.pypi_catalogue(catalogue(t, "PyPI"))
    return va.unionByName(vb).join(ta.unionByName(tb), ["name", "ecosystem"]).select("ecosystem", "name", "version", "latest")


@query(
    "benchmark_cases",
    "SELECT 'case' || k AS case_id, pkg, '2.' || k AS to_version, CAST(k % 9 AS INT) AS minimal_edits FROM api_parts WHERE kind IS DISTINCT FROM 'class'",
    ("api_parts",),
)
def _(t):
    one = c('{"id":"case', key(), '","pkg":"', F.col("pkg"), '","toVersion":"2.', key(), '","minimalEdits":', key() % 9, "}")
    body = F.when(F.coalesce("kind", F.lit("")) == "class", one).otherwise(c("[", one, "]"))
    return manifests.parse_benchmark_cases(t.view("api_parts").select(body.alias("content")))


# --- logs -----------------------------------------------------------------------------------------------------------


@query(
    "lint_reports",
    """SELECT repo, 'Dockerfile' AS file, CASE WHEN k % 2 = 0 THEN CAST(n AS INT) ELSE 1 END AS line, 1 AS col, 'DL' || k % 50 AS code, CASE WHEN k % 3 = 0 THEN 'error' ELSE 'warning' END AS level, name AS message, 'hadolint' AS tool
       FROM lock_entries WHERE k % 7 <> 0
       UNION ALL SELECT repo, name || '.sh', CAST(n AS INT), CAST(k % 80 AS INT), 'SC' || k, 'info', '', 'shellcheck' FROM lock_entries""",
    L,
)
def _(t):
    hado = c('{"file":"', F.when(key() % 7 == 0, "").otherwise("Dockerfile"), '","code":"DL', key() % 50, '"', F.when(key() % 2 == 0, c(',"line":', F.col("n"))).otherwise(""), F.when(key() % 3 == 0, ',"level":"error"').otherwise(""), ',"message":"', name(), '"}')
    shell = c('{"file":"', name(), '.sh","line":', F.col("n"), ',"column":', key() % 80, ',"code":', key(), ',"level":"info"}')
    a = logs.hadolint(joined(t, hado, "[", "]", ","))
    return a.unionByName(logs.shellcheck(joined(t, shell, '{"comments":[', "]}", ",")))


@query("repairable_files", "SELECT DISTINCT repo, name || '.sh' AS file FROM lock_entries", L)
def _(t):
    shell = c('{"file":"', name(), '.sh","line":1,"code":', key(), "}")
    return logs.repairable_files(logs.shellcheck(joined(t, shell, '{"comments":[', "]}", ",")))


@query(
    "lint_report_status",
    """SELECT repo, CASE o % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'error' WHEN 2 THEN 'empty' ELSE 'error' END AS status,
              CASE o % 4 WHEN 1 THEN 'boom' WHEN 3 THEN 'the linter produced no readable output' END AS note FROM (SELECT DISTINCT repo, o FROM lock_entries) x""",
    L,
)
def _(t):
    k = F.col("o") % 4
    return logs.report_status(
        t.view("lock_entries").select("repo", "o").distinct().select(
            "repo", F.when(k == 0, "[]").otherwise("oops").alias("content"), F.when(k == 1, " boom\n").otherwise("").alias("stderr"), (k % 2 == 1).alias("failed")
        )
    )


@query(
    "build_diagnostics",
    """SELECT repo, CASE o % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'python' ELSE 'cargo' END AS runner,
              CASE WHEN o % 5 = 0 OR o % 3 = 2 THEN NULL ELSE CAST(count(DISTINCT CASE WHEN o % 3 = 0 THEN name || ':' || k % 9 || ':' || k % 4 ELSE name || ':' || k % 9 END) AS INT) END AS n_errors FROM lock_entries GROUP BY repo, o""",
    L,
)
def _(t):
    o = F.col("repo").cast("bigint")
    line = c("  ", name(), "(", key() % 9, ",", key() % 4, "): error TS1: x\n", name(), ":", key() % 9, ":", key() % 4, ": error TS2: y\n", name(), ":1:1: warning z\n")
    runs = joined(t, line).withColumns(
        {
            "runner": F.when(o % 3 == 0, "npm").when(o % 3 == 1, "python").otherwise("cargo"),
            "stdout": F.col("content"),
            "stderr": F.col("content"),
            "skipped": o % 5 == 0,
        }
    )
    return logs.diagnostics(runs).select("repo", "runner", "n_errors")


@query(
    "review_findings",
    """SELECT k, CASE k % 5 WHEN 0 THEN leaf WHEN 1 THEN leaf || '2' WHEN 2 THEN '' END AS files, CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS n,
              CASE WHEN k % 2 = 0 THEN 1 END AS n_contract FROM api_parts""",
    ("api_parts",),
)
def _(t):
    p = t.view("api_parts")
    leaf = F.col("leaf")

    def review(file, severity="size"):
        return c('{"severity":"', severity, '","file":"', file, '","what":"w","why":""}')

    one = c('{"findings": [', review(leaf), ", ", review(leaf, "nit"), "]}")
    k = key() % 5
    log = (
        F.when(k == 0, c("thinking\n", one, "\ndone"))
        .when(k == 1, c(one, ' then {"findings": [', review(c(leaf, "2")), "]} end"))
        .when(k == 2, c("x {\"findings\": [] }"))
        .when(k == 3, c('{"findings": [', review(leaf, "nit"), "]}"))
        .otherwise("nothing here")
    )
    contract = F.when(key() % 2 == 0, c('{"findings": [{"kind":"scope","path":"', leaf, '","detail":"d"}]}')).otherwise(c('{"findings": [{"kind":"mood","path":"', leaf, '","detail":"d"}]}'))
    found = logs.review_findings(log)
    return p.select(
        "k", F.array_join(F.transform(found, lambda f: f["file"]), ",").alias("files"), F.when(found.isNotNull(), F.size(found)).alias("n"),
        F.when(logs.contract_findings(contract).isNotNull(), F.size(logs.contract_findings(contract))).alias("n_contract"),
    )


@query(
    "session_logs",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN body WHEN turn % 3 = 1 THEN 'E1' END AS error,
              CASE WHEN turn % 3 = 0 THEN 'hello' || chr(10) || 'error: ' || body WHEN turn % 3 = 1 THEN 'hello' || chr(10) || 'error: {"data":{"message":" E1 "}}' ELSE 'hello' END AS text
       FROM (SELECT *, trim(regexp_replace(text, '[^a-zA-Z ]', '', 'g')) AS body FROM conversations) x""",
)
def _(t):
    body = F.trim(F.regexp_replace("text", "[^a-zA-Z ]", ""))
    k = F.col("turn") % 3
    error = F.when(k == 0, c('{"type":"error","error":"', body, '"}')).when(k == 1, F.lit('{"type":"error","error":{"data":{"message":" E1 "}}}')).otherwise("not json")
    log = c('noise\n{"type":"text","text":"hello"}\n{broken\n', error, '\n{"type":"step"}\n')
    return t.table("conversations").select("conv_id", "turn", logs.session_error(log).alias("error"), logs.session_text(log).alias("text"))


# --- imports ---------------------------------------------------------------------------------------------------------

LINKS = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages"


def link_files(t: Tables):
    """Each page's links as import statements of a source file."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    line = lambda h, i: F.when(i % 3 == 0, c("import x", i, ' from "', h, '";')).when(i % 3 == 1, c("const y = require('", h, "');")).otherwise(c('import "@s', h, '";'))
    body = F.array_join(F.transform(links, line), "\n")
    return t.table("pages").select((F.col("page_id") % 9).cast("string").alias("repo"), c("p", F.col("page_id"), ".ts").alias("file"), body.alias("content"))


IMPORT_SQL = """
SELECT CAST(page_id % 9 AS VARCHAR) AS repo, 'p' || page_id || '.ts' AS file, CAST(i + 1 AS INT) AS line,
       CASE WHEN i % 3 = 2 THEN CASE WHEN contains(href, '/') THEN '@s' || string_split(href, '/')[1] || '/' || string_split(href, '/')[2] END ELSE string_split(href, '/')[1] END AS pkg
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, 'href="([^"]+)"', 1)))) AS i FROM pages) l
WHERE CASE WHEN i % 3 = 2 THEN contains(href, '/') ELSE NOT starts_with(href, '/') AND NOT starts_with(href, '.') END
"""


@query("import_sites", IMPORT_SQL)
def _(t):
    return imports.import_sites(link_files(t))


@query("import_index", f"SELECT repo, pkg, count(*) AS n_sites, count(DISTINCT file) AS n_files FROM ({IMPORT_SQL}) i GROUP BY repo, pkg")
def _(t):
    return imports.import_index(imports.import_sites(link_files(t)))


@query(
    "python_imports",
    """SELECT repo, 'm.py' AS file, CAST(n AS INT) AS line, m AS module FROM (SELECT repo, n, unnest(CASE k % 4 WHEN 0 THEN [name, name || '.sub'] WHEN 1 THEN [name || '.a'] WHEN 2 THEN [] ELSE [name] END) AS m FROM lock_entries) x""",
    L,
)
def _(t):
    form = key() % 4
    line = F.when(form == 0, c("import ", name(), " as q, ", name(), ".sub  # two")).when(form == 1, c("  from ", name(), ".a import (b)")).when(form == 2, c("from .", name(), " import z")).otherwise(c("import ", name()))
    return imports.python_imports(joined(t, line, separator="\n").withColumn("file", F.lit("m.py")))


@query(
    "named_imports",
    """SELECT repo, 'a.ts' AS file, name AS pkg, m AS name FROM (SELECT repo, name, unnest(['A' || k, 'B']) AS m FROM lock_entries) x""",
    L,
)
def _(t):
    text = c("import { type A", key(), " as Q,\n  B } from '", name(), "/deep';\n")
    return imports.named_imports(joined(t, text).withColumn("file", F.lit("a.ts")))


# --- symbols ----------------------------------------------------------------------------------------------------------

STATEMENTS = """
SELECT pkg, '1.0' AS version, 'f' || CAST(k % 5 AS STRING) || '.py' AS file, k AS pos, CASE WHEN k % 4 = 0 THEN '_' ELSE '' END || 'n' || CAST(k % 60 AS STRING) || CASE WHEN k % 3 = 0 THEN '.m' ELSE '' END AS path,
       'function' AS kind, 'sig' || CAST(k AS STRING) AS signature, k % 5 = 2 AS listed, k FROM api_parts
"""


@query(
    "module_symbols",
    f"""SELECT pkg, version, path, arg_max(signature, (file, pos)) AS signature, arg_max(file, (file, pos)) AS file FROM ({STATEMENTS}) s
        WHERE CASE WHEN listed THEN string_split(path, '.')[1] IN ('n2', 'n7', '_n12', '_n32', 'n17') ELSE path NOT LIKE '\\_%' ESCAPE '\\' END GROUP BY pkg, version, path""",
    ("api_parts",),
)
def _(t):
    listed = F.when(F.col("listed"), F.array(*[F.lit(x) for x in ("n2", "n7", "_n12", "_n32", "n17")]))
    return symbols.merge_modules(t.sql(STATEMENTS, "api_parts").withColumn("exported", listed)).drop("kind")


@query(
    "module_import_roots",
    """SELECT DISTINCT pkg, CASE k % 4 WHEN 0 THEN 'lib' || k % 7 WHEN 1 THEN 'src.mod' || k % 50 WHEN 2 THEN 'lib' || k % 7 ELSE 'solo' || k % 9 END AS root
       FROM api_parts""",
    ("api_parts",),
)
def _(t):
    p = t.view("api_parts")
    lib = c("lib", key() % 7)
    files = p.select(
        "pkg",
        F.explode(
            F.when(key() % 4 == 0, F.array(c(lib, "/__init__.py"), c(lib, "/sub/__init__.py"), c(lib, "/sub/x", key(), ".py")))
            .when(key() % 4 == 1, F.array(c("src/mod", key() % 50, ".py")))
            .when(key() % 4 == 2, F.array(c(lib, "/deep/y", key(), ".pyi"), c(lib, "/__init__.pyi")))
            .otherwise(F.array(c("solo", key() % 9, ".py")))
        ).alias("path"),
    )
    return symbols.import_roots(files)


@query(
    "source_files",
    """SELECT repo, 'x/' || name || CASE k % 5 WHEN 0 THEN '.ts' ELSE '.py' END AS file FROM lock_entries WHERE k % 5 IN (0, 1)""",
    L,
)
def _(t):
    k = key() % 5
    path = (
        F.when(k == 0, c("x/", name(), ".ts")).when(k == 1, c("x/", name(), ".py")).when(k == 2, c("node_modules/", name(), ".ts")).when(k == 3, c("a/dist/", name(), ".js")).otherwise(c("x/", name(), ".md"))
    )
    return file_source.source_files(t.view("lock_entries").select("repo", path.alias("file")))


@query(
    "escaping_links",
    """SELECT repo, 'a/b/' || name AS file FROM lock_entries WHERE k % 4 IN (1, 2)""",
    L,
)
def _(t):
    k = key() % 4
    target = F.when(k == 0, c("../", name())).when(k == 1, c("../../../", name())).when(k == 2, c("/etc/", name()))
    return file_source.escaping_links(t.view("lock_entries").select("repo", c("a/b/", name()).alias("file"), target.alias("link_target"))).select("repo", "file")


@query(
    "install_path_names",
    f"""SELECT repo, n, CASE k % 4 WHEN 1 THEN '@s/' || name ELSE name END || '-' || n AS name, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '@s/' || name || '-' || n ELSE name || '-' || n END AS top,
               CASE WHEN k % 3 = 0 THEN NULL ELSE '@x/' || name END AS spec_name, CASE WHEN k % 3 = 0 THEN NULL ELSE version END AS spec_version FROM lock_entries""",
    L,
)
def _(t):
    place = F.when(key() % 4 == 0, c("node_modules/host/node_modules/", name())).when(key() % 4 == 1, c("node_modules/@s/", name())).otherwise(c("node_modules/", name()))
    path = c(place, "-", F.col("n"))
    spec = lockfiles.split_name_version(F.when(key() % 3 == 0, c("@x/", name(), "@latest")).otherwise(c("@x/", name(), "@", version(), "(peer@2)")))
    return t.view("lock_entries").select(
        "repo", F.col("n").cast("bigint").alias("n"), lockfiles.name_of_install_path(path).alias("name"), lockfiles.top_level_name(path).alias("top"), spec["name"].alias("spec_name"), spec["version"].alias("spec_version")
    )


@query(
    "specifier_packages",
    """SELECT k, CASE k % 5 WHEN 0 THEN leaf WHEN 1 THEN '@s/' || leaf WHEN 2 THEN NULL WHEN 3 THEN NULL END AS pkg FROM api_parts""",
    ("api_parts",),
)
def _(t):
    from ..functions.paths import package_of_specifier

    k = key() % 5
    leaf = F.col("leaf")
    spec = F.when(k == 0, c(leaf, "/deep/x")).when(k == 1, c("@s/", leaf, "/y")).when(k == 2, c("./", leaf)).when(k == 3, c("node:", leaf)).otherwise(c("@", leaf))
    return t.view("api_parts").select("k", package_of_specifier(spec).alias("pkg"))


# --- artifact store ----------------------------------------------------------------------------------------------------

ARTIFACTS = """
SELECT p_brand AS pkg, CAST(p_size AS STRING) || '.0' AS version, p_partkey * 10 AS bytes,
       CASE WHEN p_brand IN ('Brand#3', 'Brand#4') THEN NULL ELSE CAST(p_partkey % 365 AS INT) END AS used_at FROM part
"""


@query(
    "artifact_listing",
    f"""SELECT a.pkg, string_agg(DISTINCT version, ',' ORDER BY version) AS versions, CAST(sum(bytes) AS BIGINT) AS bytes, max(used_at) AS last_used FROM ({ARTIFACTS}) a GROUP BY a.pkg""",
)
def _(t):
    return reporting.artifact_listing(t.sql(ARTIFACTS)).withColumn("versions", F.array_join("versions", ","))


@query(
    "artifact_prune",
    f"""SELECT pkg, last_used FROM (SELECT pkg, max(used_at) AS last_used FROM ({ARTIFACTS}) a GROUP BY pkg) x WHERE last_used < 365 AND pkg <= 'Brand#2'""",
)
def _(t):
    listing = reporting.artifact_listing(t.sql(ARTIFACTS))
    return reporting.prune_artifacts(listing, ["Brand#1", *(f"Brand#{n}" for n in range(10, 20)), "Brand#2", "Brand#3"], unused_since=365).select("pkg", "last_used")


@query(
    "artifact_rows_shown",
    f"""SELECT pkg, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({ARTIFACTS}) a GROUP BY pkg ORDER BY bytes DESC, pkg LIMIT 12""",
)
def _(t):
    return reporting.shown_with_rest(reporting.artifact_listing(t.sql(ARTIFACTS)), [F.desc("bytes"), "pkg"], 12)[0].select("pkg", "bytes")


@query("artifact_rows_hidden", f"SELECT greatest(count(DISTINCT pkg) - 12, 0) AS n_more FROM ({ARTIFACTS}) a")
def _(t):
    return reporting.shown_with_rest(reporting.artifact_listing(t.sql(ARTIFACTS)), [F.desc("bytes"), "pkg"], 12)[1]


@query(
    "display_texts",
    """SELECT p_partkey AS k, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || 'B' WHEN b < 1048576 THEN CASE WHEN b < 10240 THEN printf('%.1f', b / 1024.0) ELSE CAST(CAST(round(b / 1024.0) AS BIGINT) AS VARCHAR) END || 'KB'
                ELSE CASE WHEN b < 10485760 THEN printf('%.1f', b / 1048576.0) ELSE CAST(CAST(round(b / 1048576.0) AS BIGINT) AS VARCHAR) END || 'MB' END AS size,
              lower(trim(regexp_replace(p_brand || '/ ' || p_name || '--', '[^a-zA-Z0-9]+', '-', 'g'), '-')) AS slug
       FROM (SELECT *, p_partkey * p_size * 64 AS b FROM part) x""",
)
def _(t):
    from ..functions.scores import branch_slug, human_bytes

    b = F.col("p_partkey") * F.col("p_size") * 64
    return t.table("part").select(F.col("p_partkey").alias("k"), human_bytes(b).alias("size"), branch_slug(F.concat("p_brand", F.lit("/ "), "p_name", F.lit("--"))).alias("slug"))
