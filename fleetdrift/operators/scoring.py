"""Scores of repair attempts per case and per engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import verification_passed


def _list(column: str):
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def score_cases(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One score per outcome of a known case.

    ``cases``: case_id, minimal_edits. ``outcomes``: case_id, model, harness, verdict, inconclusive, edits_applied,
    edits_withheld, unresolved, uncheckable, errors_before, errors_after, type_escapes, deprecation_gaps,
    duration_ms. What was not measured stays NULL and is no zero.
    """
    joined = outcomes.join(cases.select("case_id", "minimal_edits"), "case_id")
    passed = verification_passed(F.col("verdict"))
    before, after = F.col("errors_before"), F.col("errors_after")
    reduction = F.when(before != 0, F.greatest((before - after) / before, F.lit(0.0)))
    n_unresolved, n_uncheckable = F.size(_list("unresolved")), F.size(_list("uncheckable"))

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    penalties = F.array_compact(
        F.array(
            F.when(F.col("inconclusive").isNotNull(), text("INCONCLUSIVE — ", F.col("inconclusive"))).when(
                ~passed, text("did not verify (", F.col("verdict"), ")")
            ),
            F.when(F.col("deprecation_gaps") > 0, text(F.col("deprecation_gaps"), " deprecation(s) reported and left in place")),
            F.when(F.col("type_escapes") > 0, text(F.col("type_escapes"), " type escape(s) — a green build bought with `any`")),
            F.when(
                n_unresolved > 0, text(n_unresolved, " symbol(s) left in their pre-migration form: ", F.array_join(_list("unresolved"), ", "))
            ),
            F.when(
                n_uncheckable > 0, text("could not check ", n_uncheckable, " completeness requirement(s): ", F.array_join(_list("uncheckable"), ", "))
            ),
            F.when(F.col("verdict") == "typecheck-only", F.lit("the tests did not run, so behaviour is unverified")),
        )
    )
    return joined.select(
        *outcomes.columns,
        passed.alias("passed"),
        F.col("inconclusive").isNotNull().alias("is_inconclusive"),
        (F.col("edits_applied") / F.greatest(F.col("minimal_edits"), F.lit(1))).alias("edit_ratio"),
        reduction.alias("error_reduction"),
        penalties.alias("penalties"),
    ).withColumn("clean", F.col("passed") & (F.size("penalties") == 0))


def summarise(scores: DataFrame) -> DataFrame:
    """One row per (model, harness): rates over conclusive runs, means over what was measured, totals."""
    ran = ~F.col("is_inconclusive")
    conclusive = F.greatest(F.count_if(ran), F.lit(1))

    def total(column):
        return F.sum(F.coalesce(column, F.lit(0))).cast("bigint")

    return scores.groupBy("model", "harness").agg(
        F.count(F.lit(1)).alias("runs"),
        F.countDistinct("case_id").alias("cases_run"),
        F.count_if(~ran).alias("inconclusive"),
        (F.count_if(ran & F.col("passed")) / conclusive).alias("pass_rate"),
        (F.count_if(ran & F.col("clean")) / conclusive).alias("clean_rate"),
        F.avg(F.when(ran & ~F.col("passed"), F.col("error_reduction"))).alias("mean_error_reduction"),
        F.coalesce(F.avg(F.when(ran & F.col("passed"), F.col("edit_ratio"))), F.lit(0.0)).alias("mean_edit_ratio"),
        total(F.col("type_escapes")).alias("total_type_escapes"),
        total(F.col("deprecation_gaps")).alias("total_deprecation_gaps"),
        total(F.col("edits_withheld")).alias("total_edits_withheld"),
        total(F.size(_list("unresolved"))).alias("total_unresolved"),
        total(F.col("duration_ms")).alias("total_duration_ms"),
    )


def leaderboard(summary: DataFrame) -> DataFrame:
    """Highest clean rate first, then the least over-editing; names make the order total."""
    return summary.withColumn("over_edit", F.greatest(F.col("mean_edit_ratio") - 1, F.lit(0.0))).orderBy(
        F.desc("clean_rate"), "over_edit", "model", "harness"
    )
