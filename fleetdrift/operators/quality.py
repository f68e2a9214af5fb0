"""Did a repair finish: completeness checks, leftovers, compiler complaints."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import cut_lineage
from ..skew import split_hot_join
from ..sources.imports import imports_symbol_from

# How compilers say that a symbol is gone.
GONE = (
    r"has no exported member '([^']+)'",
    r"Cannot find name '([^']+)'",
    r"Property '([^']+)' does not exist on type",
)
NAMED_FILE = (
    r"(?m)(?:^|[\s'\"])((?:[\w.@()\[\]+-]+/)*(?:[\w.@()\[\]+-]+\.(?:[cm]?tsx?|[cm]?jsx?|json|ya?ml)|Dockerfile[\w.-]*|Makefile))(?=[\s:(,'\"]|$)"
)
PARAMETER_ANY = r"([(,]\s*\.{0,3}\w+\??)\s*:\s*any\b(?!\[)"


def _in_this_dialect():
    """A pattern spelled as the JVM reads it, NULL for constructs only another engine has. Distinct patterns only.

    Spellings that differ: an open bracket or ``&&`` inside a class, a brace that starts no repetition and stands for
    itself (``{,n}`` too), the end of the text, and the null character.
    """
    repetition = re.compile(r"\{\d+(?:,\d*)?\}")
    named = re.compile(r"\\[pPNx]\{[^{}]*\}")
    only_here = re.compile(r"\(\?(?:P|#|\(|[a-zA-Z]*[aL])")

    def rewrite(pattern):
        if pattern is None or only_here.search(pattern):
            return None
        out, in_class, i = [], False, 0
        while i < len(pattern):
            ch = pattern[i]
            if ch == "\\":
                whole = named.match(pattern, i)
                token = whole[0] if whole else pattern[i : i + 2]
                i += len(token)
                if token == "\\0" and pattern[i : i + 1] not in tuple("01234567"):
                    token = "\\x00"
                out.append("\\z" if token == "\\Z" else token)
                continue
            if ch == "{" and not in_class:
                count = repetition.match(pattern, i)
                if count:
                    out.append(count[0])
                    i = count.end()
                    continue
            itself = (ch in "[&" and in_class) or (ch == "{" and not in_class)
            out.append("\\" + ch if itself else ch)
            in_class = ch != "]" if in_class else ch == "["
            i += 1
        return "".join(out)

    def rewrite_all(patterns: pd.Series) -> pd.Series:
        return patterns.map(rewrite)

    return F.pandas_udf(rewrite_all, StringType())


def _compiles(pattern: Column) -> Column:
    """Whether the JVM's own compiler takes the pattern."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def resolve_checks(checks: DataFrame, files: DataFrame) -> DataFrame:
    """repo, check_id, state, n_files: unresolved where any file fires, resolved where none does, unknown where nothing could be read.

    ``checks``: repo, check_id, kind ('import' or 'absent'), pattern, symbol, pkg. A repository's checks are one
    short list beside each of its files, so a file's text is read once for all of them. The lists are written
    first: Spark then knows how small they are and takes them to the texts, so that a repository that holds most of
    the text is no single task; lists too large for that meet the texts in a join whose hot keys are split. Patterns
    are compiled first; a bad one makes its check unknown, not the job fail.
    """
    patterns = checks.filter("kind = 'absent'").select("pattern").distinct().withColumn("ready", _in_this_dialect()("pattern"))
    patterns = patterns.withColumn("ready", F.when(F.col("ready").isNotNull() & _compiles(F.col("ready")), F.col("ready")))
    known = checks.join(patterns, "pattern", "left").withColumn("usable", (F.col("kind") == "import") | F.col("ready").isNotNull())
    lists = cut_lineage(
        known.filter("usable").groupBy("repo").agg(F.collect_list(F.struct("check_id", "kind", "ready", "symbol", "pkg")).alias("checks")),
        "checks",
    )

    def fires(c):
        by_import = imports_symbol_from(F.col("content"), c["symbol"], c["pkg"])
        return F.when(c["kind"] == "import", by_import).otherwise(F.rlike(F.col("content"), c["ready"]))

    hits = split_hot_join(files, lists, ["repo"]).select(
        "repo", F.explode(F.filter("checks", fires)["check_id"]).alias("check_id")
    )
    fired = hits.groupBy("repo", "check_id").agg(F.count(F.lit(1)).alias("n_files"))
    sources = files.groupBy("repo").agg(F.count(F.lit(1)).alias("n_sources"))
    out = known.join(fired, ["repo", "check_id"], "left").join(sources, "repo", "left")
    state = (
        F.when(F.col("n_sources").isNull() | ~F.col("usable"), "unknown").when(F.col("n_files").isNotNull(), "unresolved").otherwise("resolved")
    )
    reason = F.when(F.col("n_sources").isNull(), "no source files could be read").when(~F.col("usable"), "the pattern could not be read")
    return out.select("repo", "check_id", state.alias("state"), F.coalesce("n_files", F.lit(0)).alias("n_files"), reason.alias("reason"))


def missing_symbols(output: Column) -> Column:
    """Distinct symbols the compiler output says are gone."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(output, F.lit(p), F.lit(1)) for p in GONE]))


def files_named_in_output(outputs: DataFrame, files: DataFrame, workspaces: DataFrame) -> DataFrame:
    """repo, file of existing files that tool output names, at the root or below a workspace; dependencies are left out.

    ``outputs``: repo, output. ``workspaces``: repo, workspace ('' is the root). The first base that has the file counts.
    """
    named = outputs.select("repo", F.explode(F.array_distinct(F.regexp_extract_all("output", F.lit(NAMED_FILE), F.lit(1)))).alias("name")).distinct()
    named = named.filter(~F.col("name").rlike(r"(^|/)node_modules/"))
    bases = workspaces.select("repo", "workspace").distinct()
    tried = named.join(bases, "repo").withColumn(
        "file", F.when(F.col("workspace") == "", F.col("name")).otherwise(F.concat_ws("/", "workspace", "name"))
    )
    present = tried.join(files.select("repo", "file").distinct(), ["repo", "file"], "left_semi")
    return present.groupBy("repo", "name").agg(F.min_by("file", F.struct(F.length("workspace"), F.col("workspace"))).alias("file")).select("repo", "file").distinct()


def strip_parameter_any(source: Column) -> Column:
    """The text without ``: any`` on parameters, and how many there were."""
    return F.struct(
        F.regexp_replace(source, PARAMETER_ANY, "$1").alias("text"), F.regexp_count(source, F.lit(PARAMETER_ANY)).alias("removed")
    )


def describe_gaps(gaps: DataFrame) -> DataFrame:
    """repo, head, file: the sentence of each deprecated symbol and, one row each, the files it lists. ``gaps``: repo, pkg, symbol, file."""
    leaf = F.element_at(F.split("symbol", r"\."), -1)
    head = F.concat(F.lit("- `"), leaf, F.lit("` is deprecated in "), "pkg", F.lit(" and is still imported by: "))
    return gaps.select("repo", head.alias("head"), "file").distinct()


def evidence_files(sites: DataFrame, changed: DataFrame) -> DataFrame:
    """id, file: files of a finding's sites together with files its diff changes."""
    return sites.select("id", "file").unionByName(changed.select("id", "file")).distinct()


# --- verdicts ---------------------------------------------------------------------------------------------------


def verdicts(runs: DataFrame) -> DataFrame:
    """id, outcome from the runs before and after a change. A skipped command is not a failed one.

    ``runs``: id, phase ('baseline' or 'post'), command ('typecheck' or 'test'), ok, skipped.
    """

    def cell(phase, command, flag):
        return F.bool_or(F.when((F.col("phase") == phase) & (F.col("command") == command), F.col(flag)))

    names = [(p, c) for p in ("baseline", "post") for c in ("typecheck", "test")]
    wide = runs.groupBy("id").agg(*[cell(p, c, f).alias(f"{p}_{c}_{f}") for p, c in names for f in ("ok", "skipped")])

    def skipped(p, c):
        return F.coalesce(F.col(f"{p}_{c}_skipped"), F.lit(True))

    def passed(p):
        return (skipped(p, "typecheck") | F.col(f"{p}_typecheck_ok")) & (skipped(p, "test") | F.col(f"{p}_test_ok"))

    before, after = passed("baseline"), passed("post")
    outcome = (
        F.when(skipped("post", "typecheck") & skipped("post", "test"), "unverified")
        .when(~before & ~after, "pre-existing-failure")
        .when(before & ~after, "regression")
        .when(skipped("post", "test") & ~skipped("post", "typecheck"), "typecheck-only")
        .otherwise("verified")
    )
    return wide.select("id", outcome.alias("outcome"))


def verification_passed(outcome: Column) -> Column:
    return outcome.isin("verified", "typecheck-only")


def repair_errors(runs: DataFrame) -> DataFrame:
    """id, errors after the bump and after the repair. ``runs``: id, stage ('bump' or 'repair'), n_errors."""

    def at(stage):
        return F.max(F.when(F.col("stage") == stage, F.col("n_errors")))

    return runs.groupBy("id").agg(at("bump").alias("after_bump"), at("repair").alias("after_repair"))


def repair_routes(findings: DataFrame) -> DataFrame:
    """Adds needs_source_repair and repairable_after_bump. ``findings``: detector, resolved, outcome."""
    return findings.withColumns(
        {
            "needs_source_repair": F.col("detector") == "http-contract",
            "repairable_after_bump": F.col("resolved") & ~verification_passed(F.col("outcome")),
        }
    )


def proposals(results: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(all that could be proposed, skipped counts) per repository: verified results that change files.

    ``within`` tells whether a result is inside the limit of one run.

    ``results``: repo, pkg, seq, outcome, n_changed.
    """
    fit = results.filter(verification_passed(F.col("outcome")) & (F.col("n_changed") > 0))
    first = Window.partitionBy("repo").orderBy("seq")
    proposed = fit.withColumn("within", F.row_number().over(first) <= cap)
    skipped = fit.groupBy("repo").agg(F.greatest(F.count(F.lit(1)) - F.lit(cap), F.lit(0)).alias("n_skipped"))
    return proposed, skipped
