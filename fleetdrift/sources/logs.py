"""Tool output: linter reports, build diagnostics, review and session logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import let, lines_of, strip

# Patterns of compiler diagnostics, by the tool that prints them.
TSC_PAREN = r"(?m)^[ \t]*(\S+?)\((\d+),(\d+)\):\s*error\b"
TSC_COLON = r"(?m)^[ \t]*(\S+?):(\d+):(\d+):\s*error\b"
MYPY = r"(?m)^[ \t]*(\S+?):(\d+):(?:\d+:)?\s*error\b"

# What a review may call a problem.
REVIEW_SEVERITIES = ("duplication", "structural", "complexity", "boundary", "atomicity", "size")
CONTRACT_CONCERNS = ("scope", "pagination", "ordering", "errors", "collateral")


class DiagnosticParser:
    """How one runner's diagnostics are found; the first parser that claims a runner wins."""

    def __init__(self, runner: str, patterns: tuple[str, ...], groups: int):
        self.runner, self.patterns, self.groups = runner, patterns, groups

    def places(self, output: Column) -> Column:
        found = [
            F.transform(
                F.arrays_zip(*[F.regexp_extract_all(output, F.lit(p), F.lit(g)).alias(f"g{g}") for g in range(1, self.groups + 1)]),
                lambda z: F.concat_ws(":", *[z[f"g{g}"] for g in range(1, self.groups + 1)]),
            )
            for p in self.patterns
        ]
        return F.array_distinct(F.concat(*found))


DIAGNOSTIC_PARSERS = (
    DiagnosticParser("npm", (TSC_PAREN, TSC_COLON), 3),
    DiagnosticParser("python", (MYPY,), 2),
)


def diagnostics(runs: DataFrame, parsers=DIAGNOSTIC_PARSERS) -> DataFrame:
    """Adds n_errors: distinct places with an error; NULL where the run was skipped or nothing reads its output.

    ``runs``: runner, stdout, stderr, skipped and more.
    """
    output = F.concat_ws("\n", F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit("")))
    n = F
    for parser in parsers:
        n = n.when(F.col("runner") == parser.runner, F.size(parser.places(output)))
    return runs.withColumn("n_errors", F.when(~F.col("skipped"), n.otherwise(None)))


def hadolint(reports: DataFrame) -> DataFrame:
    """repo, file, line, col, code, level, message, tool; entries without file or code are left out."""
    return _lint(reports, F.from_json("content", schemas.HADOLINT), F.col("code"), "hadolint")


def shellcheck(reports: DataFrame) -> DataFrame:
    entries = F.from_json(F.get_json_object("content", "$.comments"), schemas.SHELLCHECK)
    return _lint(reports, entries, F.concat(F.lit("SC"), F.col("code").cast("string")), "shellcheck")


def _lint(reports: DataFrame, entries: Column, code: Column, tool: str) -> DataFrame:
    rows = reports.select("repo", F.inline(entries))
    return rows.filter((F.coalesce("file", F.lit("")) != "") & F.col("code").isNotNull() & (F.col("code").cast("string") != "")).select(
        "repo",
        "file",
        F.coalesce("line", F.lit(1)).alias("line"),
        F.coalesce("column", F.lit(1)).alias("col"),
        code.alias("code"),
        F.coalesce("level", F.lit("warning")).alias("level"),
        F.coalesce("message", F.lit("")).alias("message"),
        F.lit(tool).alias("tool"),
    )


def report_status(reports: DataFrame) -> DataFrame:
    """repo, status, note: a report nobody can read is an error of the tool where the tool failed, else simply empty."""
    readable = strip(F.col("content")).rlike(r"^[\[{]") & F.try_parse_json("content").isNotNull()
    note = F.coalesce(F.nullif(strip(F.col("stderr")), F.lit("")), F.lit("the linter produced no readable output"))
    return reports.select(
        "repo",
        F.when(readable, "read").when(F.col("failed"), "error").otherwise("empty").alias("status"),
        F.when(~readable & F.col("failed"), note).alias("note"),
    )


def repairable_files(lint: DataFrame) -> DataFrame:
    return lint.filter("tool = 'shellcheck'").select("repo", "file").distinct()


def _last_findings(log: Column, element: str, valid) -> Column:
    """Findings of the last readable object that holds a list; NULL where none does, or all entries are invalid."""
    candidates = F.regexp_extract_all(log, F.lit(r'\{[\s\S]*?"findings"[\s\S]*?\]\s*\}'), F.lit(0))

    def read(raw):
        listed = F.get_json_object(raw, "$.findings")
        good = F.try_parse_json(raw).isNotNull() & strip(F.coalesce(listed, F.lit(""))).startswith("[")
        return F.when(good, F.from_json(listed, f"array<{element}>"))

    lists = F.filter(F.transform(F.reverse(candidates), read), lambda x: x.isNotNull())
    return let(
        F.get(lists, 0),
        lambda found: let(
            F.filter(found, valid), lambda kept: F.when((F.size(kept) > 0) | (F.size(found) == 0), kept)
        ),
    )


def review_findings(log: Column) -> Column:
    some = lambda x, f: F.coalesce(x[f], F.lit("")) != ""
    return _last_findings(
        log,
        "struct<severity:string,file:string,what:string,why:string>",
        lambda x: F.coalesce(x["severity"].isin(*REVIEW_SEVERITIES), F.lit(False)) & some(x, "file") & some(x, "what") & x["why"].isNotNull(),
    )


def contract_findings(log: Column) -> Column:
    some = lambda x, f: F.coalesce(x[f], F.lit("")) != ""
    return _last_findings(
        log,
        "struct<kind:string,path:string,detail:string>",
        lambda x: F.coalesce(x["kind"].isin(*CONTRACT_CONCERNS), F.lit(False)) & some(x, "path") & some(x, "detail"),
    )


def _events(log: Column) -> Column:
    lines = F.filter(F.transform(lines_of(log), strip), lambda l: l.startswith("{"))
    return F.filter(lines, lambda l: F.try_parse_json(l).isNotNull())


def _error_text(event: Column) -> Column:
    raw = F.get_json_object(event, "$.error")
    message = F.coalesce(
        F.get_json_object(raw, "$.data.message"), F.get_json_object(raw, "$.message"), F.get_json_object(raw, "$.name")
    )
    text = F.when(strip(raw).startswith("{"), F.coalesce(F.nullif(strip(message), F.lit("")), raw)).otherwise(strip(raw))
    return text


def session_error(log: Column) -> Column:
    """The first error of a JSON-lines session log; NULL where there is none."""
    errors = F.filter(_events(log), lambda e: F.get_json_object(e, "$.type") == "error")
    return F.get(F.transform(errors, _error_text), 0)


def session_text(log: Column) -> Column:
    """Text and error events in order, one per line."""

    def line(event):
        kind = F.get_json_object(event, "$.type")
        return F.when(kind == "error", F.concat(F.lit("error: "), F.get_json_object(event, "$.error"))).when(
            kind == "text", F.get_json_object(event, "$.text")
        )

    return strip(F.array_join(F.filter(F.transform(_events(log), line), lambda l: l.isNotNull()), "\n"))
