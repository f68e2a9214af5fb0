"""Seams: what plugs in, by ecosystem or file suffix. The first claimant of a registry wins.

A seam's methods take and return DataFrames or Columns, so plugging something in changes the plan and not the
engine.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import locate, reporting
from ..session import cut_lineage
from ..sources import logs
from . import contracts, reports, vulnerabilities


class EcosystemInventory(Protocol):
    """How one ecosystem states what is installed and declared."""

    ecosystem: str

    def applies(self, files: DataFrame) -> DataFrame: ...

    def read(self, files: DataFrame) -> DataFrame: ...

    def declared(self, files: DataFrame) -> DataFrame: ...


class Detector(Protocol):
    """Findings from the fleet tables: ``detect`` returns (findings, notes or None)."""

    detector_id: str

    def detect(self, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame | None]: ...


class LintAdapter(Protocol):
    tool: str

    def applies(self, file: Column) -> Column: ...

    def read(self, reports: DataFrame) -> DataFrame: ...


@dataclass
class DetectorRun:
    findings: DataFrame | None
    notes: DataFrame | None
    failures: list[tuple[str, str]] = field(default_factory=list)


def run_detectors(detectors: list[Detector], tables: dict[str, DataFrame]) -> DetectorRun:
    """All findings as one table. A detector that fails, planned or run, is a failure of its own and not of the scan.

    What a detector finds is written while its failures are caught, so a task that fails takes down its detector only.
    """
    findings, notes, failures = [], [], []
    for detector in detectors:
        try:
            found, said = detector.detect(tables)
            found = cut_lineage(found, detector.detector_id)
            said = None if said is None else cut_lineage(said, detector.detector_id)
        except Exception as error:  # isolation is the point of this loop
            failures.append((detector.detector_id, str(error).split("\n")[0]))
            continue
        findings.append(found.withColumn("detector", F.lit(detector.detector_id)))
        if said is not None:
            notes.append(said.withColumn("detector", F.lit(detector.detector_id)))
    return DetectorRun(
        reporting.union_findings(findings) if findings else None, reporting.union_findings(notes) if notes else None, failures
    )


@dataclass(frozen=True)
class Route:
    """Who handles which ecosystems or file suffixes."""

    handler: str
    ecosystems: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()


def claimed_by(routes: tuple[Route, ...], ecosystem: Column | None = None, file: Column | None = None) -> Column:
    """The first handler that claims a row; NULL where none does."""
    chain = F
    for route in routes:
        claim = F.lit(False)
        if ecosystem is not None and route.ecosystems:
            claim = claim | ecosystem.isin(*route.ecosystems)
        if file is not None and route.suffixes:
            for suffix in route.suffixes:
                claim = claim | file.endswith(suffix)
        chain = chain.when(claim, route.handler)
    return chain.otherwise(F.lit(None).cast("string"))


def unclaimed_warnings(rows: DataFrame, routes: tuple[Route, ...], what: str) -> DataFrame:
    """repo, ecosystem, n, warning: what nothing handles is said, never passed over."""
    claimed = claimed_by(routes, ecosystem=F.col("ecosystem"))
    lost = rows.filter(claimed.isNull()).groupBy("repo", "ecosystem").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit(f"no {what} handles "), "ecosystem", F.lit(", so "), F.col("n").cast("string"), F.lit(" package(s) were not examined"))
    return lost.withColumn("warning", text)


class SiteResolver(Protocol):
    """The call-site search of some ecosystems: ``sites`` gets the wanted symbols it claims (pkg, symbol, ecosystem)."""

    route: Route

    def sites(self, wanted: DataFrame, tables: dict[str, DataFrame]) -> DataFrame: ...


def resolve_sites(resolvers: tuple[SiteResolver, ...], wanted: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Every wanted symbol goes to the first resolver that claims its ecosystem; the routed symbols are written once.

    Returns the sites of all resolvers (repo, pkg, symbol, file, line, col, resolver) and what none of them handles
    (ecosystem, n, warning).
    """
    routes = tuple(r.route for r in resolvers)
    routed = cut_lineage(wanted.withColumn("handler", claimed_by(routes, ecosystem=F.col("ecosystem"))), "wanted")
    found = []
    for resolver in resolvers:
        mine = routed.filter(F.col("handler") == resolver.route.handler).drop("handler")
        sites = resolver.sites(mine, tables).select("repo", "pkg", "symbol", "file", "line", "col")
        found.append(sites.withColumn("resolver", F.lit(resolver.route.handler)))
    lost = routed.filter("handler IS NULL").groupBy("ecosystem").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit("no call-site search handles "), F.coalesce("ecosystem", F.lit("an unnamed ecosystem")), F.lit(", so "), F.col("n").cast("string"), F.lit(" symbol(s) were not searched"))
    return reporting.union_findings(found), lost.withColumn("warning", text)


class BindingResolver:
    """Imported names and what is read from them. Tables: references, bindings, aliases."""

    route = Route("typescript", ("npm",), (".ts", ".tsx", ".js", ".jsx"))

    def sites(self, wanted: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        return locate.binding_sites(tables["references"], tables["bindings"], wanted.select("pkg", "symbol"), tables["aliases"])


class PythonResolver:
    """Calls by name and by attribute. Tables: calls, names, stars, modules, roots."""

    route = Route("python", ("PyPI",), (".py",))

    def sites(self, wanted: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        given = [tables[name] for name in ("calls", "names", "stars", "modules", "roots")]
        return locate.python_sites(*given, wanted.select("pkg", "symbol"))


class PinDetector:
    """Disagreeing version pins. Tables: files, dependencies."""

    detector_id = "version-pin"

    def detect(self, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame | None]:
        report = reports.pins(tables["files"], tables["dependencies"])
        found = report.conflicts.select("repo", "finding_id", F.lit("drift").alias("severity"), "file", "line", F.col("subject").alias("pkg"))
        return found, None


class _Hadolint:
    tool = "hadolint"

    def applies(self, file: Column) -> Column:
        # fixed value: file names the linter reads
        return file.rlike(r"(^|/)(Dockerfile|Containerfile)(\.[\w.-]+)?$|\.(Dockerfile|dockerfile)$")

    def read(self, reports_: DataFrame) -> DataFrame:
        return logs.hadolint(reports_)


class _Shellcheck:
    tool = "shellcheck"

    def applies(self, file: Column) -> Column:
        return file.rlike(r"\.(sh|bash|ksh)$")

    def read(self, reports_: DataFrame) -> DataFrame:
        return logs.shellcheck(reports_)


LINT_ADAPTERS: tuple[LintAdapter, ...] = (_Hadolint(), _Shellcheck())


class LintDetector:
    """Linter reports as findings. Tables: lint_reports (repo, tool, content)."""

    detector_id = "external-lint"

    def detect(self, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame | None]:
        rows = reporting.union_findings([a.read(tables["lint_reports"].filter(F.col("tool") == a.tool)) for a in LINT_ADAPTERS])
        found = rows.withColumn(
            "finding_id", ids.tagged_id("external-lint", F.col("tool"), F.col("code"), F.col("file"), F.col("line"))
        ).select("repo", "finding_id", F.lit("lint").alias("severity"), "file", "line", F.col("code").alias("pkg"))
        return found, None


class VulnerabilityDetector:
    """Installed versions inside advisory windows. Tables: installed, windows, names, facts, imports, locks."""

    detector_id = "vulnerability"

    def __init__(self, checked: tuple[str, ...]):
        self.checked = checked

    def detect(self, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame | None]:
        given = [tables[name] for name in ("installed", "windows", "names", "facts", "imports", "locks")]
        rows = vulnerabilities.report(*given, self.checked)
        found = rows.select("repo", "finding_id", F.lit("vulnerability").alias("severity"), F.col("lock_line").alias("line"), F.col("name").alias("pkg"), "guidance")
        return found, None


class ContractDetector:
    """Calls that a description no longer covers, or whose description changed. Tables: calls, descriptions, and
    previous_descriptions where changes since then are asked for."""

    detector_id = "http-contract"

    def __init__(self, now: Column):
        self.now = now

    def detect(self, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame | None]:
        report = contracts.check(tables["calls"], tables["descriptions"], self.now, tables.get("previous_descriptions"))
        found = report.gone.select("repo", "finding_id", F.lit("breaking").alias("severity"), "file", "line", F.col("host").alias("pkg"))
        if report.hits is not None:
            drift = ids.tagged_id("http-drift", F.col("host"), F.col("change_path"), F.col("kind"))
            hits = report.hits.select("repo", drift.alias("finding_id"), "severity", F.col("host").alias("pkg")).distinct()
            found = reporting.union_findings([found, hits])
        return found, report.notes


def lintable(files: DataFrame, adapters=LINT_ADAPTERS) -> DataFrame:
    """repo, file, tool: which linter looks at which file; files no linter claims have no row."""
    tools = F.array_compact(F.array(*[F.when(a.applies(F.col("file")), a.tool) for a in adapters]))
    return files.select("repo", "file", F.explode(tools).alias("tool"))
