"""Hosts, routes, endpoints and who controls them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# How far a description can be trusted, by where it came from.
PROVENANCE_RANK = {
    "official-domain": 100,
    "official-github": 95,
    "directory": 92,
    "verified-swaggerhub": 90,
    "verified-postman": 85,
    "curated": 75,
    "community": 50,
    "extracted-from-docs": 30,
}
PROVIDER_CONTROLLED = ("official-domain", "official-github", "verified-swaggerhub")
SERVED_LIVE = ("official-domain",)
CURRENCY_DAYS = 365
CODE_HOSTS = ("github.com", "raw.githubusercontent.com", "gist.githubusercontent.com")
# Query parameters that page through results, lower case.
PAGING_PARAMETERS = (
    "page pagesize per_page perpage limit offset cursor after before starting_after ending_before page_token pagetoken continuationtoken"
).split()

NOT_LITERAL = "the URL is not a literal, so it cannot be read without running the code"
RUNTIME_HOST = "the host is substituted at runtime, so which API this reaches is unknown"
RELATIVE_URL = "the URL is relative, so it reaches this application’s own server rather than a vendor"
UNPARSED_URL = "the URL could not be parsed"
RUNTIME_METHOD = "the request method is decided at runtime, so which endpoint this is cannot be told"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)), F.lit(""))


def route_of(path: Column) -> Column:
    """The path without query or fragment, runs of slashes as one, ``/`` where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), "/{2,}", "/")
    return F.when(bare == "", "/").otherwise(bare)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)


def query_names(url: Column) -> Column:
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.array_distinct(
        F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.get(F.split(p, "="), 0))
    )


def read_url(raw: Column) -> Column:
    """host, route, params, reason of a URL whose runtime parts are spelled ``{}``."""
    host = host_of(raw)
    reason = (
        F.when(raw.isNull(), NOT_LITERAL)
        .when(raw.startswith("{}"), RUNTIME_HOST)
        .when(~raw.rlike(r"(?i)^https?://"), RELATIVE_URL)
        .when(host.isNull(), UNPARSED_URL)
        .when(host.contains("{}"), RUNTIME_HOST)
    )
    return F.struct(
        reason.alias("reason"),
        F.when(reason.isNull(), host).alias("host"),
        F.when(reason.isNull(), route_of(path_of(raw))).alias("route"),
        F.when(reason.isNull(), query_names(raw)).otherwise(F.array().cast("array<string>")).alias("params"),
    )


def top_segment(route: Column) -> Column:
    return F.concat(F.lit("/"), F.coalesce(F.get(F.split(route, "/"), 1), F.lit("")))


def endpoint_method(change_path: Column) -> Column:
    return F.nullif(F.regexp_extract(change_path, r"^([A-Z]+) (\S+)", 1), F.lit(""))


def endpoint_route(change_path: Column) -> Column:
    return F.nullif(F.regexp_extract(change_path, r"^([A-Z]+) (\S+)", 2), F.lit(""))


def offered_parameter(change_path: Column) -> Column:
    return F.nullif(F.regexp_extract(change_path, r" query:(\S+)$", 1), F.lit(""))


def offers_paging(change_path: Column) -> Column:
    return F.coalesce(F.lower(offered_parameter(change_path)).isin(*PAGING_PARAMETERS), F.lit(False))


def is_template(segment: Column) -> Column:
    return segment.rlike(r"^\{.*\}$")


def registrable_domain(host: Column) -> Column:
    return F.substring_index(F.lower(host), ".", -2)


def second_level_label(host: Column) -> Column:
    return F.get(F.split(registrable_domain(host), r"\."), 0)


def vendor_label(text: Column) -> Column:
    """The label before the last one of the first URL's host; NULL where there is no such label."""
    host = F.regexp_extract(text, r"""https?://([^/'"\s]+)""", 1)
    labels = F.split(host, r"\.")
    return F.when((host != "") & (F.size(labels) >= 2), F.get(labels, F.size(labels) - 2))


def is_under(host: Column, domain: Column) -> Column:
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def provenance_rank(provenance: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in PROVENANCE_RANK.items() for x in pair])
    return F.try_element_at(ranks, provenance)


def is_current(updated_at: Column, now: Column) -> Column:
    """Changed within the last 365 days; a missing or unreadable date is not current."""
    return F.coalesce(F.try_to_timestamp(updated_at) >= now - F.expr(f"INTERVAL {CURRENCY_DAYS} DAYS"), F.lit(False))


def can_assert_breakage(provenance: Column, updated_at: Column, now: Column) -> Column:
    return provenance.isin(*PROVIDER_CONTROLLED) & (provenance.isin(*SERVED_LIVE) | is_current(updated_at, now))


def describe_provenance(url: Column, provenance: Column, updated_at: Column, now: Column) -> Column:
    changed = F.try_to_timestamp(updated_at)
    days = F.round((F.unix_timestamp(now) - F.unix_timestamp(changed)) / F.lit(86400)).cast("bigint").cast("string")
    claim = (
        F.when(~provenance.isin(*PROVIDER_CONTROLLED), "a third-party copy, so a mismatch is a lead and not a finding")
        .when(provenance.isin(*SERVED_LIVE), "provider-controlled and served from their own origin, so a mismatch is evidence")
        .when(
            changed.isNull(),
            "provider-controlled, but when they last changed it could not be established, so a mismatch is a lead and not a finding",
        )
        .when(
            is_current(updated_at, now),
            F.concat(F.lit("provider-controlled and last changed "), days, F.lit(" day(s) ago, so a mismatch is evidence")),
        )
        .otherwise(
            F.concat(F.lit("provider-controlled but last changed "), days, F.lit(" day(s) ago, so it is not evidence about today's API"))
        )
    )
    return F.concat(url, F.lit(" — "), provenance, F.lit(" ("), provenance_rank(provenance).cast("string"), F.lit("/100): "), claim)


def provenance_of_pointer(url: Column, domain: Column, org: Column) -> Column:
    """Who controls a pointed-at description: the vendor's domain, the vendor's own code organisation, or a directory."""
    host = host_of(url)
    owner = F.get(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), 0)
    return (
        F.when(F.coalesce(is_under(host, F.lower(domain)), F.lit(False)), "official-domain")
        .when(
            F.coalesce((org != "") & host.isin(*CODE_HOSTS) & (F.lower(owner) == F.lower(org)), F.lit(False)),
            "official-github",
        )
        .otherwise("directory")
    )


def claims_vendor(homepage: Column, domain: Column) -> Column:
    """The homepage is the domain, lies under it, or carries its second-level label under another suffix."""
    host = host_of(homepage)
    mine = second_level_label(domain)
    return F.coalesce(is_under(host, domain) | ((mine != "") & (second_level_label(host) == mine)), F.lit(False))


def links_back(values: Column, domain: Column) -> Column:
    """Any URL among the values points at the domain or below it."""
    return F.exists(values, lambda v: F.coalesce(is_under(host_of(v), domain), F.lit(False)))


def parse_org_pairs(flag: Column) -> Column:
    """``domain=org`` pairs of a comma list as (position, domain, org); a malformed pair is an error."""
    pairs = F.filter(F.transform(F.split(flag, ","), strip), lambda p: p != "")

    def read(pair, i):
        parts = F.split(pair, "=")
        good = (F.get(parts, 0) != "") & (F.coalesce(F.get(parts, 1), F.lit("")) != "")
        problem = F.concat(F.lit("expects domain=org pairs, e.g. stripe.com=stripe; got "), pair)
        return F.struct(
            i.alias("seq"),
            F.when(good, F.lower(strip(F.get(parts, 0)))).otherwise(F.raise_error(problem)).alias("domain"),
            strip(F.get(parts, 1)).alias("org"),
        )

    return F.transform(pairs, read)
