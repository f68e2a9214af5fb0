"""Installed versions against advisory windows.

The interval test runs once per distinct (ecosystem, name, version). A package that a third of the fleet
installs is then a few hundred versions, not millions of rows, and the result is joined back afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.scores import urgency
from ..functions.versions import version_key
from ..skew import split_hot_join

VERSION = ["ecosystem", "name", "version"]


def distinct_versions(installed: DataFrame) -> DataFrame:
    return installed.select(*VERSION).distinct().withColumn("version_key", version_key(F.col("ecosystem"), F.col("version")))


def holding_windows(versions: DataFrame, windows: DataFrame) -> DataFrame:
    """Every (version, window) where the version lies inside the window."""
    v = F.col("version_key")
    inside = (F.col("introduced_key").isNull() | (F.col("introduced_key") <= v)) & (
        F.when(F.col("fixed_key").isNotNull(), v < F.col("fixed_key"))
        .when(F.col("last_key").isNotNull(), v <= F.col("last_key"))
        .otherwise(True)
    )
    return split_hot_join(versions, windows, ["ecosystem", "name"]).filter(inside)


def version_vulnerabilities(versions: DataFrame, windows: DataFrame) -> DataFrame:
    """ecosystem, name, version, advisory, fixed_in.

    ``fixed_in`` comes from the first closed window, in listed order, that holds the version; where that
    window ends with a last affected version there is no known fix. Windows never closed give no fix.
    """
    held = holding_windows(versions, windows)
    closed = F.col("fixed").isNotNull() | F.col("last_affected").isNotNull()
    position = F.struct("affected_pos", "range_pos", "event_pos")
    first = F.min(F.when(closed, F.struct(position.alias("p"), F.col("fixed"))))
    return held.groupBy(*VERSION, "advisory").agg(first["fixed"].alias("fixed_in"))


def screen(installed: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct versions of packages that any advisory names: the reduction before details are read."""
    named = windows.select("ecosystem", "name").distinct()
    return distinct_versions(installed.join(named, ["ecosystem", "name"], "left_semi"))


def scan(installed: DataFrame, windows: DataFrame) -> DataFrame:
    """Vulnerabilities per distinct installed version: screen first, then the interval test confirms."""
    return version_vulnerabilities(screen(installed, windows), windows)


def spread_to_repos(installed: DataFrame, per_version: DataFrame) -> DataFrame:
    """Results of distinct versions back onto (repo, ecosystem, name, version)."""
    rows = installed.select("repo", *VERSION).distinct()
    return split_hot_join(rows, per_version, VERSION)


def remediation_targets(vulnerabilities: DataFrame) -> DataFrame:
    """Per version: the highest fix, how many advisories it clears, and which have none."""
    key = F.when(F.col("fixed_in").isNotNull(), version_key(F.col("ecosystem"), F.col("fixed_in")))
    return vulnerabilities.groupBy(*VERSION).agg(
        F.count(F.lit(1)).alias("n_advisories"),
        F.max_by(F.col("fixed_in"), F.when(key.isNotNull(), F.struct(key, F.col("fixed_in")))).alias("target"),
        F.count("fixed_in").alias("clears"),
        F.array_sort(F.collect_list(F.when(F.col("fixed_in").isNull(), F.col("advisory")))).alias("leaves"),
    )


def enrich(vulnerabilities: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds facts where known; an advisory without facts is unranked, not mild."""
    known = facts.select("advisory", "severity", "cvss_score", "epss_percentile", "cwe", F.lit(True).alias("has_facts"))
    joined = vulnerabilities.join(known, "advisory", "left")
    return joined.withColumn(
        "urgency", urgency(F.col("has_facts"), F.col("epss_percentile"), F.col("cvss_score"), F.col("severity"))
    )


def within_budget(vulnerabilities: DataFrame, budget: int) -> DataFrame:
    """Every distinct advisory, and whether it is among the first ``budget`` in id order, which one round may ask for."""
    found = vulnerabilities.select("advisory").distinct()
    last = found.orderBy("advisory").limit(budget).agg(F.max("advisory").alias("last"))
    return found.join(F.broadcast(last), F.lit(True)).select("advisory", (F.col("advisory") <= F.col("last")).alias("within"))  # one row


def worst_urgency(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy(*VERSION).agg(F.max("urgency").alias("worst"))


def ranked(worst: DataFrame) -> DataFrame:
    """Most urgent first; name and version make the order total."""
    return worst.orderBy(F.desc("worst"), "ecosystem", "name", "version")


def package_findings(vulnerabilities: DataFrame, names: DataFrame) -> DataFrame:
    """One finding per vulnerable version: its ids, and the CVE or else the id of each, distinct."""
    named = vulnerabilities.join(names.select("advisory", "cve"), "advisory", "left")
    grouped = named.groupBy(*VERSION).agg(
        F.array_sort(F.collect_set("advisory")).alias("advisories"),
        F.array_sort(F.collect_set(F.coalesce("cve", "advisory"))).alias("names"),
    )
    return grouped.withColumn(
        "finding_id", ids.tagged_id("vulnerability", F.col("name"), F.col("version"), F.array_join("advisories", ","))
    )


def manifest_sites(lock_entries: DataFrame) -> DataFrame:
    """Where each name@version stands in a repository's lockfile; the first entry counts."""
    return lock_entries.groupBy("repo", "name", "version").agg(F.min("line").alias("lock_line"))


def reachability(findings: DataFrame, imports: DataFrame, locks: DataFrame, checked_ecosystems: tuple[str, ...]) -> DataFrame:
    """Adds evidence: imported, not imported, or could not be checked. Never drops a finding.

    ``findings``: repo, ecosystem, name, version. ``imports``: repo, pkg, one row per site.
    """
    used = imports.groupBy("repo", F.col("pkg").alias("name")).agg(F.count(F.lit(1)).alias("n_imports"))
    out = findings.join(used, ["repo", "name"], "left").join(manifest_sites(locks), ["repo", "name", "version"], "left")
    checked = F.col("ecosystem").isin(*checked_ecosystems)
    imported = checked & F.col("n_imports").isNotNull()
    reach = (
        F.when(imported, F.concat(F.lit("imported at "), F.col("n_imports").cast("string"), F.lit(" site(s) in this repository")))
        .when(
            ~checked,
            F.concat(
                F.lit("whether this repository imports it could not be checked — nothing here reads "),
                F.col("ecosystem"),
                F.lit(" imports"),
            ),
        )
        .otherwise("not imported from this repository’s source — it runs because a dependency calls it")
    )
    return out.select(
        *findings.columns,
        F.when(imported, F.col("n_imports")).otherwise(F.lit(0)).cast("bigint").alias("n_imports"),
        F.when(~imported, F.col("lock_line")).alias("lock_line"),
        F.when(imported, "imported").when(~checked, "unchecked").otherwise("not-imported").alias("reach"),
        reach.alias("reach_text"),
    )


def reintroduced(fixed: DataFrame, installed: DataFrame, ecosystem: str = "npm") -> DataFrame:
    """Fixes that were undone: the installed version is below the one that fixed it.

    ``fixed``: repo, pkg, fixed_at. ``installed``: repo, name, version. An absent package is not a return.
    """
    eco = F.lit(ecosystem)
    now = installed.select("repo", F.col("name").alias("pkg"), F.col("version").alias("now")).distinct()
    return split_hot_join(now, fixed, ["repo", "pkg"]).filter(
        version_key(eco, F.col("now")) < version_key(eco, F.col("fixed_at"))
    )
