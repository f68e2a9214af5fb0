"""Counts and listings a reader sees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Severities in display order with their labels; the first two are the headline.
SUMMARY_CLASSES = (
    ("breaking", "breaking"),
    ("deprecation", "deprecated"),
    ("drift", "version pin(s) disagree"),
    ("vulnerability", "package(s) with known vulnerabilities"),
    ("lint", "lint finding(s) in Dockerfiles and shell scripts"),
    ("freshness", "package(s) behind latest with nothing that would break"),
    ("feature", "package(s) that gained exports you do not use yet"),
)
HEADLINE = ("breaking", "deprecation")
# What a detector's group is called.
DETECTOR_LABELS = {
    "version-pin": "version pins",
    "vulnerability": "vulnerabilities",
    "external-lint": "lint",
    "http-contract": "http contracts",
}
FEATURES_SHOWN = 5


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """Findings of all detectors as one table; columns a detector lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scan_counts(findings: DataFrame, packages: DataFrame, sites: DataFrame, pin_conflicts: DataFrame) -> DataFrame:
    """Per repository: findings per severity, packages analysed and skipped, call sites, pin conflicts.

    ``findings``: repo, severity. ``packages``: repo, status. ``sites``: repo, n_sites. ``pin_conflicts``: repo.
    Every part is aggregated on its own and joined one row to one row.
    """

    def n(severity):
        return F.count_if(F.col("severity") == severity)

    by_severity = findings.groupBy("repo").agg(
        n("breaking").alias("breaking"),
        n("deprecation").alias("deprecation"),
        n("vulnerability").alias("vulnerabilities"),
        n("lint").alias("lint"),
        n("freshness").alias("freshness"),
        n("feature").alias("features"),
    )
    by_status = packages.groupBy("repo").agg(
        F.count_if(F.col("status") == "analyzed").alias("packages_analyzed"),
        F.count_if(F.col("status") != "analyzed").alias("packages_skipped"),
    )
    by_site = sites.groupBy("repo").agg(F.sum("n_sites").cast("bigint").alias("call_sites"))
    by_pin = pin_conflicts.groupBy("repo").agg(F.count(F.lit(1)).alias("pin_conflicts"))
    out = reduce(lambda a, b: a.join(b, "repo", "full_outer"), [by_status, by_severity, by_site, by_pin])
    return out.na.fill(0)


def summary_lines(counts: DataFrame) -> DataFrame:
    """The counts as lines in display order; below the headline, lines that count nothing are left out."""
    column = {"breaking": "breaking", "deprecation": "deprecation", "drift": "pin_conflicts", "vulnerability": "vulnerabilities", "lint": "lint", "freshness": "freshness", "feature": "features"}
    lines = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(severity).alias("severity"),
                F.lit(label).alias("label"),
                F.lit(severity in HEADLINE).alias("headline"),
                F.col(column[severity]).cast("bigint").alias("n"),
            )
            for i, (severity, label) in enumerate(SUMMARY_CLASSES)
        ]
    )
    return counts.select("repo", F.inline(lines)).filter("headline OR n > 0")


def detector_groups(findings: DataFrame) -> DataFrame:
    """Findings per detector under its display name; an unknown detector keeps its own."""
    labels = F.create_map(*[F.lit(x) for pair in DETECTOR_LABELS.items() for x in pair])
    label = F.coalesce(F.try_element_at(labels, F.col("detector")), F.col("detector"))
    return findings.groupBy("repo", "detector").agg(F.count(F.lit(1)).alias("n_findings")).withColumn("label", label)


def new_exports(additions: DataFrame, shown: int = FEATURES_SHOWN) -> DataFrame:
    """Per package: how many exports are new, the first few by name, how many stay unnamed.

    The names are cut by rank before they are collected, so no package ever gathers more than ``shown``.
    """
    first = Window.partitionBy("pkg").orderBy("path")
    names = (
        additions.select("pkg", "path")
        .withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= shown)
        .groupBy("pkg")
        .agg(F.array_sort(F.collect_list("path")).alias("names"))
    )
    totals = additions.groupBy("pkg").agg(F.count(F.lit(1)).alias("n_new"))
    return totals.join(names, "pkg").select(
        "pkg", "n_new", F.array_join("names", ", ").alias("shown"), (F.col("n_new") - F.size("names")).alias("n_hidden")
    )


def freshness(packages: DataFrame, findings: DataFrame) -> DataFrame:
    """Analysed packages behind their target that have no finding at all.

    ``packages``: repo, pkg, status, from_version, to_version, n_unlocated.
    """
    behind = packages.filter(
        (F.col("status") == "analyzed") & F.col("from_version").isNotNull() & F.col("to_version").isNotNull() & (F.col("from_version") != F.col("to_version"))
    )
    quiet = behind.join(findings.select("repo", "pkg").distinct(), ["repo", "pkg"], "left_anti")
    span = F.concat(F.col("from_version"), F.lit(" and "), F.col("to_version"))
    text = F.when(
        F.col("n_unlocated") > 0,
        F.concat(F.col("n_unlocated").cast("string"), F.lit(" breaking change(s) between "), span, F.lit(", none of which this repository calls")),
    ).otherwise(F.concat(F.lit("nothing changed between "), span, F.lit(" that this repository could call")))
    return quiet.select("repo", "pkg", "from_version", "to_version", text.alias("guidance"))


def newest(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The newest ``n`` rows of a listing."""
    return rows.orderBy(F.desc(order)).limit(n)


def shown_with_rest(rows: DataFrame, order: list, n: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows and, apart, how many more there are."""
    return rows.orderBy(*order).limit(n), rows.agg(F.greatest(F.count(F.lit(1)) - F.lit(n), F.lit(0)).alias("n_more"))


def stored_repos(scans: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Per repository: scans, findings, runs, last scan, newest name; most recent first.

    ``scans``: repo, id, repo_name, started_at. Each table is reduced to one row per repository before it is joined.
    """
    s = scans.groupBy("repo").agg(
        F.count(F.lit(1)).alias("scans"), F.max("started_at").alias("last_scanned"), F.max_by("repo_name", "id").alias("repo_name")
    )
    f = findings.groupBy("repo").agg(F.count(F.lit(1)).alias("findings"))
    r = runs.groupBy("repo").agg(F.count(F.lit(1)).alias("runs"))
    return s.join(f, "repo", "left").join(r, "repo", "left").na.fill(0, ["findings", "runs"]).orderBy(F.desc("last_scanned"), "repo")


def latest_scans(scans: DataFrame) -> DataFrame:
    return scans.groupBy("repo").agg(F.max_by(F.struct(*[c for c in scans.columns if c != "repo"]), "id").alias("s")).select("repo", "s.*")


def artifact_listing(artifacts: DataFrame) -> DataFrame:
    """Per package: its versions, total bytes, newest use; largest first. ``artifacts``: pkg, version, bytes, used_at."""
    versions = artifacts.select("pkg", "version").distinct().groupBy("pkg").agg(
        F.array_sort(F.collect_list("version")).alias("versions")
    )
    totals = artifacts.groupBy("pkg").agg(F.sum("bytes").cast("bigint").alias("bytes"), F.max("used_at").alias("last_used"))
    return totals.join(versions, "pkg").orderBy(F.desc("bytes"), "pkg")


def prune_artifacts(listing: DataFrame, packages: list[str] | None = None, unused_since=None) -> DataFrame:
    """The artifacts to delete. Without any criterion it refuses; an unknown age never matches."""
    if not packages and unused_since is None:
        raise ValueError("name the packages or the age to prune; pruning everything must be asked for")
    keep = listing
    if packages:
        keep = keep.filter(F.col("pkg").isin(*packages))
    if unused_since is not None:
        keep = keep.filter(F.col("last_used") < unused_since)
    return keep
