"""Outbound calls against API descriptions.

A description route is a template. Instead of testing every call against every template, each template is
keyed by its shape (which segments are parameters) and its literal text; a call is rewritten once per shape
its host uses and then hash-joined. A call with runtime segments meets the templates whose first and last literal
it holds, and is walked along each of them once. Routes are distinct before, so a host that receives a third of all
calls costs as much as its distinct routes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, urls
from ..functions.paths import base_name, host_suffixes
from ..session import cut_lineage
from ..skew import split_hot_join
from .pinning import behind_current


def spanning_routes(routes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``spans``: the last parameter may stand for several segments where no longer route lies below."""
    distinct = routes.select(*keys, "route").distinct()
    parts = F.split("route", "/")
    above = distinct.select(
        *keys,
        F.explode(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        ).alias("route"),
        F.col("route").alias("below"),
    )
    deeper = above.filter(F.col("route") != F.col("below")).select(*keys, "route").distinct().withColumn("deeper", F.lit(True))
    return distinct.join(deeper, [*keys, "route"], "left").select(*keys, "route", F.col("deeper").isNull().alias("spans"))


def described_endpoints(operations: DataFrame, bases: DataFrame, keys: list[str]) -> DataFrame:
    """keys, method, route (with base), spans; every base path of a description is tried."""
    spans = spanning_routes(operations, keys)
    return (
        operations.select(*keys, "method", "route")
        .join(spans, [*keys, "route"])
        .join(bases.select(*keys, "base"), keys)
        .select(*keys, "method", F.concat("base", "route").alias("route"), "spans")
        .distinct()
    )


def _shaped(templates: DataFrame, keys: list[str]) -> DataFrame:
    segments = F.split("route", "/")
    mask = F.array_join(F.transform(segments, lambda s: F.when(urls.is_template(s), "T").otherwise("L")), "")
    spans = F.col("spans") & urls.is_template(F.element_at(segments, -1))
    literal = F.array_join(F.transform(segments, lambda s: F.when(urls.is_template(s), "{}").otherwise(s)), "/")
    return templates.select(*keys, "method", "route", mask.alias("mask"), spans.alias("open"), literal.alias("key"))


def match_routes(calls: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, method, call_route, route) pairs where the call is described by the template.

    A template parameter takes one segment; the last one takes all that remain where ``spans`` allows it. A
    runtime segment ``{}`` of a call stands for one or more consecutive parameters, never for a literal.
    ``calls``: keys, method, route. ``templates``: keys, method, route, spans.
    """
    shaped = _shaped(templates, keys)
    shapes = shaped.select(*keys, "method", "mask", "open").distinct()
    routes = calls.select(*keys, "method", F.col("route").alias("call_route"), F.split("route", "/").alias("segments")).distinct()
    at_runtime = F.array_contains("segments", "{}")
    tried = split_hot_join(routes.filter(~at_runtime), shapes, [*keys, "method"])
    n = F.length("mask")
    fits = (F.size("segments") == n) | (F.col("open") & (F.size("segments") > n))
    kinds = F.slice(F.split("mask", ""), F.lit(1), n)
    keyed = F.zip_with(F.slice("segments", F.lit(1), n), kinds, lambda s, kind: F.when(kind == "T", "{}").otherwise(s))
    written = tried.filter(fits).withColumn("key", F.array_join(keyed, "/")).drop("segments").join(shaped, [*keys, "method", "mask", "open", "key"])
    found = [written, _walked(routes.filter(at_runtime), shaped, keys)]
    return found[0].select(*keys, "method", "call_route", "route").union(found[1].select(*keys, "method", "call_route", "route")).distinct()


# The places of a template that a call's segments can have reached, one segment after the other; -1 once the last
# parameter takes all that remains. A runtime segment takes one or more parameters, a literal one or its equal.
_WALK = """aggregate(segments, array(0), (reached, s) -> array_distinct(flatten(transform(reached, j -> CASE
    WHEN j = -1 THEN array(-1)
    WHEN j >= length(mask) THEN array()
    WHEN s = '{}' THEN CASE WHEN get(runs, j) > 0 THEN sequence(j + 1, j + get(runs, j)) ELSE array() END
    WHEN substring(mask, j + 1, 1) = 'T' THEN CASE WHEN open AND j = length(mask) - 1 THEN array(-1) ELSE array(j + 1) END
    WHEN get(template, j) = s THEN array(j + 1) ELSE array() END))))"""


def _walked(routes: DataFrame, shaped: DataFrame, keys: list[str]) -> DataFrame:
    """Calls with runtime segments and the templates they reach, in as many steps as the two have segments."""
    literals = F.array_distinct(F.filter("segments", lambda s: (s != "{}") & (s != "")))
    ends = F.transform(literals, lambda a: F.transform(literals, lambda b: F.struct(a.alias("first"), b.alias("last"))))
    none = F.array(F.struct(F.lit("").alias("first"), F.lit("").alias("last")))
    asked = routes.withColumn("end", F.explode(F.concat(none, F.flatten(ends)))).select(*routes.columns, "end.*")
    fixed = F.filter(F.split("key", "/"), lambda s: (s != "{}") & (s != ""))
    runs = F.transform(F.sequence(F.lit(1), F.length("mask")), lambda j: F.length(F.regexp_extract(F.substring("mask", j, F.length("mask")), "^(T*)", 1)))
    offered = shaped.select(
        *keys, "method", "route", "mask", "open", F.split("route", "/").alias("template"), runs.alias("runs"),
        F.coalesce(F.get(fixed, 0), F.lit("")).alias("first"), F.coalesce(F.get(fixed, F.size(fixed) - 1), F.lit("")).alias("last"),
    )
    met = asked.join(offered, [*keys, "method", "first", "last"]).withColumn("reached", F.expr(_WALK))
    return met.filter(F.array_contains("reached", F.length("mask")) | F.array_contains("reached", -1))


def check_calls(calls: DataFrame, described: DataFrame) -> DataFrame:
    """Adds ``outcome`` to resolved calls: matched, gone, uncovered, not-aligned or no-description.

    ``calls``: repo, host, method, route and more. ``described``: host, method, route, spans. A description
    must match at least one call of a repository before anything is claimed for it; a call it does not know is
    gone where the description covers its first segment and uncovered where it does not.
    """
    hits = match_routes(calls, described, ["host"]).select("host", "method", F.col("call_route").alias("route")).distinct()
    hits = cut_lineage(hits, "matched-routes")  # read twice: for the calls and for the hosts they align
    known = described.select("host").distinct().withColumn("has_description", F.lit(True))
    tops = described.select("host", urls.top_segment(F.col("route")).alias("top")).distinct().withColumn("covered", F.lit(True))
    marked = split_hot_join(calls, hits.withColumn("matched", F.lit(True)), ["host", "method", "route"], "left")
    aligned = marked.filter("matched").select("repo", "host").distinct().withColumn("aligned", F.lit(True))
    out = (
        marked.withColumn("top", urls.top_segment(F.col("route")))
        .join(known, "host", "left")
        .join(tops, ["host", "top"], "left")
        .join(aligned, ["repo", "host"], "left")
    )
    outcome = (
        F.when(F.col("has_description").isNull(), "no-description")
        .when(F.col("matched"), "matched")
        .when(F.col("aligned").isNull(), "not-aligned")
        .when(F.col("covered"), "gone")
        .otherwise("uncovered")
    )
    return out.select(*calls.columns, "top", outcome.alias("outcome"))


def contract_summary(checked: DataFrame, all_calls: DataFrame) -> DataFrame:
    """Per (repo, host): outcomes and uncovered segments counted, and the repository's unreadable calls beside them."""
    unread = all_calls.groupBy("repo").agg(F.count_if(~F.col("resolved")).alias("n_unresolved"))
    counts = checked.groupBy("repo", "host").agg(
        *[F.count_if(F.col("outcome") == o).alias(f"n_{o.replace('-', '_')}") for o in ("matched", "gone", "uncovered", "not-aligned", "no-description")]
    )
    segments = uncovered_segments(checked).groupBy("repo", "host").agg(F.count(F.lit(1)).alias("n_uncovered_segments"))
    return counts.join(segments, ["repo", "host"], "left").join(unread, "repo", "left").na.fill(0, ["n_uncovered_segments"])


def uncovered_segments(checked: DataFrame) -> DataFrame:
    """repo, host, top: first segments a description says nothing about."""
    return checked.filter("outcome = 'uncovered'").select("repo", "host", "top").distinct()


def gone_findings(checked: DataFrame) -> DataFrame:
    return checked.filter("outcome = 'gone'").withColumn(
        "finding_id", ids.tagged_id("http-contract", F.col("host"), F.col("method"), F.col("route"))
    )


def match_changes(calls: DataFrame, changes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Description changes that touch a called endpoint: host, change columns, repo, n_sites.

    ``changes``: host, path, kind, severity. ``endpoints``: host, route (bare), full (with base), spans, from the
    **older** description. A newly offered parameter counts only for calls that do not send it yet.
    """
    wanted = changes.select(
        "host",
        F.col("path").alias("change_path"),
        "kind",
        "severity",
        urls.endpoint_method(F.col("path")).alias("method"),
        urls.endpoint_route(F.col("path")).alias("bare"),
        F.when(F.col("severity") == "feature", urls.offered_parameter(F.col("path"))).alias("offered"),
    ).filter("method IS NOT NULL")
    known = endpoints.select("host", F.col("route").alias("bare"), F.col("full").alias("route"), "spans").distinct()
    located = wanted.join(known, ["host", "bare"], "left").withColumns(
        {"route": F.coalesce("route", "bare"), "spans": F.coalesce("spans", F.lit(False))}
    )
    templates = located.select("host", "method", "route", "spans").distinct()
    pairs = match_routes(calls, templates, ["host"])
    touched = located.join(pairs, ["host", "method", "route"]).select(
        "host", "change_path", "kind", "severity", "offered", "method", F.col("call_route").alias("route")
    ).distinct()
    # calls are counted per distinct parameter list first, so a popular route joins as a few rows
    counted = calls.groupBy("repo", "host", "method", "route", "params").agg(F.count(F.lit(1)).alias("n"))
    return (
        split_hot_join(counted, touched, ["host", "method", "route"])
        .filter(F.col("offered").isNull() | ~F.array_contains("params", F.col("offered")))
        .groupBy("repo", "host", "change_path", "kind", "severity")
        .agg(F.sum("n").cast("bigint").alias("n_sites"))
    )


def not_reported(hits: DataFrame, gone: DataFrame) -> DataFrame:
    """Hits whose endpoint was not already reported as gone."""
    reported = gone.select("repo", "host", F.concat_ws(" ", "method", "route").alias("change_path")).distinct()
    return hits.join(reported, ["repo", "host", "change_path"], "left_anti")


def offered_parameters(hits: DataFrame) -> DataFrame:
    """Newly offered parameters, split into paging controls and capabilities."""
    return hits.filter("severity = 'feature'").withColumn(
        "group", F.when(urls.offers_paging(F.col("change_path")), "paging").otherwise("capability")
    )


def diff_specs(
    old_ops: DataFrame, new_ops: DataFrame, old_params: DataFrame, new_params: DataFrame, readable: DataFrame | None = None
) -> DataFrame:
    """Changes between two descriptions: vendor, path, kind, severity, confidence, before, after.

    Parameters are compared only for operations both sides have. ``readable`` (vendor, before_ok, after_ok)
    silences a vendor one of whose sides could not be read.
    """
    op = ["vendor", "method", "route"]
    ops = old_ops.select(*op, F.col("deprecated").alias("was")).join(
        new_ops.select(*op, F.col("deprecated").alias("now")), op, "full_outer"
    )
    endpoint = F.concat_ws(" ", "method", "route")
    s = F.lit

    def row(when, kind, severity, confidence, before, after):
        def text(x):
            return (x if not isinstance(x, (str, type(None))) else F.lit(x)).cast("string")

        return F.when(
            when,
            F.struct(
                text(kind).alias("kind"), text(severity).alias("severity"), s(confidence).alias("confidence"), text(before).alias("before"), text(after).alias("after")
            ),
        )

    op_rows = ops.select(
        "vendor",
        endpoint.alias("path"),
        F.inline(
            F.array_compact(
                F.array(
                    row(F.col("now").isNull(), "removed", "breaking", "high", "present", None),
                    row(F.col("was").isNull(), "added", "feature", "high", None, "present"),
                    row(F.col("now") & ~F.col("was"), "deprecated", "deprecation", "high", "current", "deprecated"),
                )
            )
        ),
    )
    common = ops.filter("was IS NOT NULL AND now IS NOT NULL").select(*op)
    cols = ("location", "required", "type")

    def side(params, tag):
        return params.join(common, op, "left_semi").select(*op, "name", *[F.col(c).alias(f"{tag}_{c}") for c in cols])

    both = side(old_params, "old").join(side(new_params, "new"), [*op, "name"], "full_outer")
    gone, fresh = F.col("new_location").isNull(), F.col("old_location").isNull()
    label = F.concat(endpoint, s(" "), F.coalesce("old_location", "new_location"), s(":"), F.col("name"))

    def need(flag):
        return F.when(F.col(flag), "required").otherwise("optional")

    kept = ~gone & ~fresh
    unknown = (F.col("old_type") == "unknown") | (F.col("new_type") == "unknown")
    param_rows = both.select(
        "vendor",
        label.alias("path"),
        F.inline(
            F.array_compact(
                F.array(
                    row(gone, "removed", "breaking", "medium", need("old_required"), None),
                    row(kept & F.col("new_required") & ~F.col("old_required"), "signature-changed", "breaking", "high", "optional", "required"),
                    row(kept & ~unknown & (F.col("old_type") != F.col("new_type")), "signature-changed", "breaking", "high", F.col("old_type"), F.col("new_type")),
                    row(
                        fresh,
                        F.when(F.col("new_required"), "signature-changed").otherwise("added"),
                        F.when(F.col("new_required"), "breaking").otherwise("feature"),
                        "high",
                        None,
                        need("new_required"),
                    ),
                )
            )
        ),
    )
    out = op_rows.unionByName(param_rows)
    if readable is not None:
        out = out.join(readable.filter("before_ok AND after_ok").select("vendor"), "vendor", "left_semi")
    return out


def spec_headers(readable: DataFrame) -> DataFrame:
    """vendor, unanalyzable, note: an unreadable side is said, never taken for an empty diff."""
    which = F.when(~F.col("before_ok"), "previous").when(~F.col("after_ok"), "current")
    return readable.select(
        "vendor",
        (~F.col("before_ok") | ~F.col("after_ok")).alias("unanalyzable"),
        F.when(which.isNotNull(), F.concat(F.lit("the "), which, F.lit(" description could not be read as OpenAPI or Swagger"))).alias("note"),
    )


def best_descriptions(candidates: DataFrame) -> DataFrame:
    """The candidate of highest provenance per vendor; the earliest wins a tie. ``candidates``: vendor, seq, provenance."""
    rank = urls.provenance_rank(F.col("provenance"))
    rest = [c for c in candidates.columns if c != "vendor"]
    return candidates.groupBy("vendor").agg(F.max_by(F.struct(*rest), F.struct(rank, -F.col("seq"))).alias("b")).select("vendor", "b.*")


def ranked_descriptions(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("rank", urls.provenance_rank(F.col("provenance"))).orderBy("vendor", F.desc("rank"), "seq")


def organisations(hosts: DataFrame, mapping: DataFrame) -> DataFrame:
    """The organisation of each host: the first mapped domain the host equals or lies under. ``mapping``: seq, domain, org."""
    keyed = hosts.select("host", F.explode(host_suffixes(F.lower("host"))).alias("domain"))
    first = keyed.join(mapping, "domain").groupBy("host").agg(F.min_by("org", "seq").alias("org"))
    return hosts.join(first, "host", "left")


# What a description file in a code repository looks like, and what it is not.
STRUCTURED_FILE = r"(?i)\.(json|ya?ml)$"
NOT_A_DESCRIPTION = (
    r"(?i)(^|/)(\.github|\.circleci|node_modules|examples?|test|tests)/"
    r"|(^|/)(package|package-lock|tsconfig|renovate|spectral)[^/]*\.(json|ya?ml)$"
)
DESCRIPTION_FOLDER = r"(?i)(^|/)(spec|specs|openapi|swagger|oai|descriptions|schemas)/"
DESCRIPTION_NAME = r"(?i)(openapi|swagger|spec\d)[^/]*\.(json|ya?ml)$"


def description_file_score(path: Column) -> Column:
    """How likely a repository file is an API description; -1 rules it out."""
    one_suffix = F.size(F.split(base_name(path), r"\.")) == 2
    points = [(path.rlike(DESCRIPTION_FOLDER), 3), (path.rlike(DESCRIPTION_NAME), 3), (path.rlike(r"(?i)\.json$"), 1), (one_suffix, 2)]
    total = sum((F.when(test, n).otherwise(0) for test, n in points), F.lit(0))
    return F.when(~path.rlike(STRUCTURED_FILE) | path.rlike(NOT_A_DESCRIPTION), -1).otherwise(total)


def best_description_files(files: DataFrame) -> DataFrame:
    """The highest scoring file per repository, by path where scores tie. ``files``: repo, path."""
    scored = files.withColumn("score", description_file_score(F.col("path"))).filter("score >= 0")
    return scored.groupBy("repo").agg(F.min_by(F.struct("path", "score"), F.struct(-F.col("score"), F.col("path"))).alias("b")).select("repo", "b.*")


def published_versions(pins: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Pins of a wire API version beside what the vendor publishes: behind, current or unknown.

    Candidate domains of a subject are tried in order. ``descriptions``: domain, published.
    """
    subject = F.col("subject")
    domains = F.array(
        F.concat(F.lit("api."), subject, F.lit(".com")),
        F.concat(subject, F.lit(".com")),
        F.concat(F.lit("api."), subject, F.lit(".io")),
        F.concat(subject, F.lit(".io")),
    )
    subjects = pins.select("subject").filter(subject.isNotNull()).distinct()
    found = (
        subjects.select("subject", F.posexplode(domains).alias("seq", "domain"))
        .join(descriptions, "domain")
        .groupBy("subject")
        .agg(F.min_by("published", "seq").alias("published"))
    )
    behind = behind_current(F.col("version"), F.col("published"))
    state = F.when(behind, "behind").when(~behind, "current").otherwise("unknown")
    return pins.join(found, "subject", "left").withColumn("state", state)
