"""Vulnerability scan: installed versions, advisories, targets, urgency and evidence in one report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import ordinal
from ..operators import graph
from ..operators import vulnerabilities as vuln
from ..session import cut_lineage


def report(
    installed: DataFrame, windows: DataFrame, names: DataFrame, facts: DataFrame, imports: DataFrame, locks: DataFrame, checked: tuple[str, ...]
) -> DataFrame:
    """One row per (repo, package version) with what to do about it.

    Everything about a version is worked out once per version and spread to the repositories at the end.
    """
    found = cut_lineage(vuln.scan(installed, windows), "vulnerabilities")
    enriched = vuln.enrich(found, facts)
    per_version = (
        vuln.package_findings(found, names)
        .join(vuln.remediation_targets(found), vuln.VERSION)
        .join(
            enriched.groupBy(*vuln.VERSION).agg(
                F.max("urgency").alias("worst"),
                F.max(F.when(F.col("has_facts"), F.struct(F.coalesce("epss_percentile", F.lit(-1.0)).alias("p"), "severity"))).alias("top"),
            ),
            vuln.VERSION,
        )
    )
    spread = vuln.spread_to_repos(installed, per_version)
    evidence = vuln.reachability(spread.select("repo", *vuln.VERSION), imports, locks, checked)
    rows = spread.join(evidence, ["repo", *vuln.VERSION])
    percentile = F.round(F.col("top.p") * 100).cast("bigint")
    label = F.when(F.col("top.severity").isNotNull(), F.concat(F.lit(" ("), F.col("top.severity"), F.lit(")"))).otherwise("")
    urgency = F.when(
        F.col("top.p") >= 0, F.concat(F.lit(" Exploitation likelihood: "), ordinal(percentile), F.lit(" percentile"), label, F.lit("."))
    ).when(F.col("top.severity").isNotNull(), F.concat(F.lit(" Severity: "), F.col("top.severity"), F.lit("."))).otherwise("")
    leaves = F.when(
        F.size("leaves") > 0,
        F.concat(
            F.lit(" "), F.size("leaves").cast("string"), F.lit(" has no published fix and survives the upgrade: "), F.array_join("leaves", ", "), F.lit(".")
        ),
    ).otherwise("")
    named = F.array_join("names", ", ")
    guidance = F.when(
        F.col("target").isNotNull(),
        F.concat(
            named, F.lit(". Upgrading to "), "target", F.lit(" clears "), F.col("clears").cast("string"), F.lit(" of "), F.col("n_advisories").cast("string"),
            F.lit("."), leaves, urgency, F.lit(" "), "reach_text", F.lit("."),
        ),
    ).otherwise(F.concat(named, F.lit(". No published fix, so no upgrade is proposed."), urgency, F.lit(" "), "reach_text", F.lit(".")))
    return rows.select(
        "repo", *vuln.VERSION, "finding_id", "n_advisories", "target", "clears", "worst", "reach", "n_imports", "lock_line", guidance.alias("guidance")
    )


def remediation(vulnerable: DataFrame, directs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan per vulnerable package, routes to it). ``vulnerable``: repo, name, target."""
    targets = vulnerable.filter(F.col("target").isNotNull()).select("repo", F.col("name").alias("child"))
    routes = graph.paths_to(edges, targets, directs)
    return graph.plan_remediation(vulnerable, directs, routes), routes
