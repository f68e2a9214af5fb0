"""The smaller jobs: pins, freshness and features, engine table, dashboard, impact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inventory, lifecycle, locate, pinning, reporting, scoring, snapshot
from ..sources import pins as pin_source


@dataclass
class PinReport:
    conflicts: DataFrame
    repairs: DataFrame
    api_versions: DataFrame


def pins(files: DataFrame, dependencies: DataFrame) -> PinReport:
    """Disagreeing pins of every repository, the edits that settle them, and wire versions nothing arbitrates."""
    found = pin_source.extract_pins(files)
    conflicts = pinning.pin_conflicts(found, inventory.trusted_versions(dependencies))
    return PinReport(pinning.with_pin_ids(conflicts), pinning.repairs(conflicts), pinning.unarbitrated(found))


def freshness_and_features(packages: DataFrame, findings: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quiet packages that are behind, and what each package newly exports."""
    return reporting.freshness(packages, findings), reporting.new_exports(snapshot.capability_additions(changes))


def engines(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    return scoring.leaderboard(scoring.summarise(scoring.score_cases(cases, outcomes)))


@dataclass
class Dashboard:
    newest_scans: DataFrame
    latest: DataFrame
    findings: DataFrame
    repos: DataFrame


def dashboard(scans: DataFrame, found: DataFrame, runs: DataFrame, shown: int = 50) -> Dashboard:
    """``scans``: repo, id, repo_name, started_at. ``found``: repo, scan, finding, with scan the id of a scan."""
    states = lifecycle.finding_states(found, scans.select("repo", F.col("id").alias("scan")))
    return Dashboard(
        reporting.newest(scans, "id", shown),
        reporting.latest_scans(scans),
        states.orderBy("status", "finding", "repo"),
        reporting.stored_repos(scans, states, runs),
    )


def impact(declared: DataFrame, references: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Per repository: outside files and lines a change may break."""
    sites = locate.impact_sites(declared, references, changed_files)
    return sites.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_sites"), F.countDistinct("file").alias("n_files"), F.countDistinct("symbol").alias("n_symbols")
    )
