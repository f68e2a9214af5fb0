"""Outbound HTTP calls in source text.

A call counts where a known client, or any function given an options object with ``url`` and ``method``, is called.
Calls are delimited by a linear scan of the file (strings, comments, templates, brackets); what they say is read from
their whole arguments. What cannot be read stays in the table with a reason, and is never taken for a GET.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import strip
from ..session import cut_lineage, ship_package
from .callscan import places, plain_template, scan_calls

# Client names and verbs.
CLIENTS = "fetch axios got ky superagent".split()
VERBS = "get post put patch delete head options".split()
QUERY_NAMES = ("queryparams", "params", "searchparams", "query")

STRING = r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"""
UNREADABLE = "the call is not closed, so its arguments cannot be told"
CALL = (
    "repo string, file string, line int, col int, text string, callee string, closed boolean, args array<string>, "
    "first array<struct<name: string, value: string>>, second array<struct<name: string, value: string>>"
)

_PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_ARROW = pa.schema(
    [("repo", pa.string()), ("file", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("text", pa.string()), ("callee", pa.string())]
    + [("closed", pa.bool_()), ("args", pa.list_(pa.string())), ("first", _PAIRS), ("second", _PAIRS)]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Calls of known clients, and calls whose first argument is an object with an address and a method."""
    clients = set(CLIENTS)
    for batch in batches:
        rows = []
        for repo, file, content in zip(*(batch.column(c).to_pylist() for c in ("repo", "file", "content")), strict=True):
            found = []
            for start, end, callee, closed, args, objects in scan_calls(content):
                head, _, verb = callee.partition(".")
                known = callee in clients or (head in clients and verb.lower() in VERBS)
                names = {name.lower() for name, _ in objects[0]} if objects else set()
                if (known and (args or not closed)) or ("method" in names and names & {"url", "uri"}):
                    found.append((start, end, callee, closed, args, objects))
            for (start, end, callee, closed, args, objects), (line, col) in zip(found, places(content, [f[0] for f in found]), strict=True):
                pairs = [[{"name": k.lower(), "value": plain_template(v)} for k, v in o] for o in objects[:2]] + [[], []]
                text = content[start:end]
                rows.append({"repo": repo, "file": file, "line": line, "col": col, "text": text, "callee": callee, "closed": closed, "args": [plain_template(x) for x in args], "first": pairs[0], "second": pairs[1]})
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


NO_OPTIONS = r"^(?:undefined|null|(?:async\s+)?(?:function\b|(?:\([^()]*\)|[\w$]+)\s*=>))"


def _literal(text: Column) -> Column:
    """The content of a string literal that is the whole ``text``, else NULL."""
    found = F.regexp_extract(text, rf"^{STRING}$", 1)
    return F.when(found != "", F.substring(found, F.lit(2), F.length(found) - 2))


def _property(pairs: str, *names: str) -> Column:
    """The text of the first property of one of these names, in the order of the names; else NULL."""

    def first_of(name):
        return F.get(F.filter(pairs, lambda p: p["name"] == name)["value"], 0)

    return F.coalesce(*map(first_of, names))


def _verb_of(value: Column) -> Column:
    """The verb that a literal or a member (``Method.Put``) states; NULL where it does neither."""
    verb = F.lower(F.coalesce(_literal(value), F.nullif(F.regexp_extract(value, r"^[\w$.()]+\.([\w$]+)$", 1), F.lit(""))))
    return F.when(verb.isin(*VERBS), F.upper(verb))


def raw_calls(files: DataFrame) -> DataFrame:
    """repo, file, line, col, text, method, url (NULL where not literal), is_template, option_params, runtime_method, closed."""
    ship_package(files.sparkSession)
    # a plain substring test spares most files the scan
    likely = F.lit(False)
    for word in (*CLIENTS, "url", "uri"):
        likely = likely | F.lower("content").contains(word)
    rows = files.filter(likely).select("repo", "file", "content")
    calls = rows.mapInArrow(_scan, CALL)
    url_text, method = _property("first", "url", "uri"), _property("first", "method")
    calls = calls.withColumns({"url_text": url_text, "by": url_text.isNotNull() & method.isNotNull(), "verb": _verb_of(method)})
    own = F.upper(F.regexp_extract("callee", r"\.([\w$]+)$", 1))
    own = F.when(F.get(F.split("callee", r"\."), 0).isin(*CLIENTS), F.nullif(own, F.lit("")))
    # options that state no readable verb leave it to run time, unless they are a literal without verb or spread, or a callback
    options = F.get("args", 1)
    stated = _verb_of(_property("second", "method"))
    silent = (options.startswith("{") & _property("second", "method", "...").isNull()) | options.rlike(NO_OPTIONS)
    open_verb = own.isNull() & ~F.col("by") & options.isNotNull() & stated.isNull() & ~silent
    target = F.when(F.col("by"), F.col("url_text")).otherwise(F.get("args", 0))
    params = _property("first", *QUERY_NAMES)
    names = F.regexp_extract_all(F.regexp_extract(params, r"^\{([^{}]*)\}$", 1), F.lit(r"""(?:^|,)\s*['"]?([\w$-]+)['"]?\s*(?=[:,]|$)"""), F.lit(1))
    return calls.select(
        "repo",
        "file",
        "line",
        "col",
        "text",
        F.coalesce(own, F.when(F.col("by"), F.col("verb")).otherwise(stated), F.lit("GET")).alias("method"),
        _literal(target).alias("url"),
        F.coalesce(target.startswith("`"), F.lit(False)).alias("is_template"),
        F.when(F.col("by") & params.isNotNull(), F.filter(names, lambda n: n != "")).otherwise(F.array().cast("array<string>")).alias("option_params"),
        ((F.col("by") & F.col("verb").isNull()) | F.coalesce(open_verb, F.lit(False))).alias("runtime_method"),
        "closed",
    )


def constants(files: DataFrame, exported: bool = False) -> DataFrame:
    """repo, file, name, value of string constants; exported ones count only where they hold an absolute URL."""
    if exported:
        pattern = rf"(?m)^export\s+const\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]*)?=\s*{STRING}"
        files = files.filter(F.col("content").contains("export const") & F.col("content").contains("http"))
    else:
        pattern = rf"\bconst\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]*)?=\s*{STRING}"
    names = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all("content", F.lit(pattern), F.lit(2))
    found = files.select("repo", "file", F.explode(F.arrays_zip(names.alias("name"), values.alias("value"))).alias("c")).select(
        "repo", "file", "c.name", F.expr("substring(c.value, 2, length(c.value) - 2)").alias("value")
    )
    found = found.filter(~F.col("value").contains("${"))
    return found.filter(F.col("value").rlike(r"(?i)^https?://")) if exported else found


def unambiguous(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Names with one distinct value; a name two places define differently is dropped."""
    return (
        rows.groupBy(*keys)
        .agg(F.min("value").alias("value"), F.max("value").alias("other"))
        .filter(F.col("value") == F.col("other"))
        .drop("other")
    )


def imported_names(files: DataFrame) -> DataFrame:
    """repo, file, local, exported of named imports."""
    clauses = F.regexp_extract_all("content", F.lit(r"import\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from"), F.lit(1))
    entry = files.select("repo", "file", F.explode(clauses).alias("names")).select("repo", "file", F.explode(F.split("names", ",")).alias("e"))
    text = F.regexp_replace(strip(F.col("e")), r"^type\s+", "")
    return entry.select(
        "repo",
        "file",
        F.element_at(F.split(text, r"\s+as\s+"), -1).alias("local"),
        F.get(F.split(text, r"\s+as\s+"), 0).alias("exported"),
    ).filter("local <> ''")


def visible_constants(files: DataFrame, asking: DataFrame) -> DataFrame:
    """What each asking file can name: its own constants, then imported ones that no own constant shadows.

    Exported constants come from all files; own constants and imports are read only where a call needs them.
    """
    everywhere, files = files, files.join(asking.select("repo", "file").distinct(), ["repo", "file"], "left_semi")
    own = unambiguous(constants(files), ["repo", "file", "name"])
    shared = unambiguous(constants(everywhere, exported=True).select("repo", "name", "value"), ["repo", "name"])
    imported = (
        imported_names(files)
        .join(shared.withColumnRenamed("name", "exported"), ["repo", "exported"])
        .select("repo", "file", F.col("local").alias("name"), "value")
        .join(own.select("repo", "file", "name"), ["repo", "file", "name"], "left_anti")
    )
    return own.unionByName(unambiguous(imported, ["repo", "file", "name"]))


def http_calls(files: DataFrame) -> DataFrame:
    """All calls: resolved ones with host, route and parameter names, the others with a reason.

    The pattern search over the text runs once; its calls are written and read from there.
    """
    calls = cut_lineage(raw_calls(files), "raw-calls")
    site = ["repo", "file", "line", "col"]
    token = r"\$\{[^}]*\}|[^$]+|\$"
    spans = (
        calls.filter(F.col("is_template") & F.col("url").contains("${"))
        .select(*site, F.posexplode(F.regexp_extract_all("url", F.lit(token), F.lit(0))).alias("pos", "token"))
        .withColumn("name", F.regexp_extract("token", r"^\$\{\s*([A-Za-z_$][\w$]*)\s*\}$", 1))
    )
    known = visible_constants(files, spans.filter("name <> ''"))
    filled = spans.join(known, ["repo", "file", "name"], "left").select(
        *site, "pos", F.when(F.col("token").rlike(r"^\$\{"), F.coalesce("value", F.lit("{}"))).otherwise(F.col("token")).alias("part")
    )
    joined = filled.groupBy(*site).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda p: p["part"]), "").alias("filled")
    )
    out = calls.join(joined, site, "left").withColumn("read", urls.read_url(F.coalesce("filled", "url")))
    reason = F.when(~F.col("closed"), F.lit(UNREADABLE)).when(F.col("runtime_method"), F.lit(urls.RUNTIME_METHOD)).otherwise(F.col("read.reason"))
    good = reason.isNull()
    return out.select(
        *site,
        "text",
        F.when(F.col("closed"), F.col("method")).alias("method"),
        good.alias("resolved"),
        F.when(good, F.col("read.host")).alias("host"),
        F.when(good, F.col("read.route")).alias("route"),
        F.when(good, F.array_distinct(F.concat("read.params", "option_params"))).otherwise(F.array().cast("array<string>")).alias("params"),
        reason.alias("reason"),
    )
