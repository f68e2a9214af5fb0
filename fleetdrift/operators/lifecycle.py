"""Findings over consecutive scans of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..skew import split_hot_join


def number_scans(scans: DataFrame) -> DataFrame:
    """Adds ``n``, the position of each scan among its repository's. ``scans``: repo, scan (ordered)."""
    return scans.select("repo", "scan").distinct().withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("scan")))


def _presence(found: DataFrame, scans: DataFrame) -> DataFrame:
    return found.select("repo", "scan", "finding").distinct().join(number_scans(scans), ["repo", "scan"])


def scan_deltas(found: DataFrame, scans: DataFrame) -> DataFrame:
    """repo, finding, scan, event: added, returned or resolved at each scan.

    The first scan of a repository is a baseline and reports nothing new. A finding is resolved at the first scan
    without it. ``found``: repo, scan, finding. ``scans`` also lists scans that found nothing. The windows run
    over the scans of one finding.

    What a scan's place is, and which scan follows it, is one small table, written first so that Spark knows its size.
    Findings meet it once, by repository and scan, and are never dealt out by repository alone.
    """
    order = Window.partitionBy("repo").orderBy("n")
    placed = cut_lineage(number_scans(scans).select("repo", "scan", "n", F.lead("scan").over(order).alias("next_scan")), "placed-scans")
    seen = split_hot_join(found.select("repo", "scan", "finding").distinct(), placed, ["repo", "scan"])
    w = Window.partitionBy("repo", "finding").orderBy("n")
    seen = seen.withColumns({"before": F.lag("n").over(w), "after": F.lead("n").over(w)})
    arrives = F.when(F.col("before").isNull() & (F.col("n") > 1), "added").when(F.col("before") < F.col("n") - 1, "returned")
    leaves = F.col("next_scan").isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col("n") + 1))
    return seen.select(
        "repo",
        "finding",
        F.inline(
            F.array_compact(
                F.array(
                    F.when(arrives.isNotNull(), F.struct("scan", arrives.alias("event"))),
                    F.when(leaves, F.struct(F.col("next_scan").alias("scan"), F.lit("resolved").alias("event"))),
                )
            )
        ),
    )


def scan_delta_counts(deltas: DataFrame, scans: DataFrame) -> DataFrame:
    """repo, scan, first, added, returned, resolved: a scan without news keeps its row of zeros."""
    counts = deltas.groupBy("repo", "scan").agg(*[F.count_if(F.col("event") == e).alias(e) for e in ("added", "returned", "resolved")])
    return (
        number_scans(scans)
        .join(counts, ["repo", "scan"], "left")
        .select("repo", "scan", (F.col("n") == 1).alias("first"), *[F.coalesce(e, F.lit(0).cast("bigint")).alias(e) for e in ("added", "returned", "resolved")])
    )


def finding_states(found: DataFrame, scans: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """repo, finding, first_seen, last_seen, status after all scans.

    ``last_seen`` of a fixed finding is the scan that closed it. A dismissed finding that is seen again stays
    dismissed and never becomes fixed. ``dismissed``: repo, finding.
    """
    numbered = number_scans(scans)
    spans = _presence(found, scans).groupBy("repo", "finding").agg(
        F.min("scan").alias("first_seen"), F.max(F.struct("n", "scan")).alias("latest")
    )
    last = numbered.groupBy("repo").agg(F.max("n").alias("n_last"))
    closing = numbered.select("repo", (F.col("n") - 1).alias("n"), F.col("scan").alias("closed_at"))
    out = spans.select("repo", "finding", "first_seen", F.col("latest.n").alias("n"), F.col("latest.scan").alias("seen_at")).join(last, "repo")
    out = out.join(closing, ["repo", "n"], "left")
    if dismissed is None:
        out = out.withColumn("gone", F.lit(None).cast("boolean"))
    else:
        out = out.join(dismissed.select("repo", "finding").distinct().withColumn("gone", F.lit(True)), ["repo", "finding"], "left")
    status = F.when(F.col("gone"), "dismissed").when(F.col("n") == F.col("n_last"), "open").otherwise("fixed")
    return out.select(
        "repo", "finding", "first_seen", F.when(status == "fixed", F.col("closed_at")).otherwise(F.col("seen_at")).alias("last_seen"), status.alias("status")
    )


def upsert_findings(stored: DataFrame, scanned: DataFrame, found: DataFrame) -> DataFrame:
    """The stored findings after one round of scans, at most one scan per repository.

    ``stored``: repo, finding, first_seen, last_seen, status. ``scanned``: repo, scan. ``found``: repo, finding.
    Repositories not scanned keep their rows as they are.
    """
    now = found.select("repo", "finding").distinct().withColumn("present", F.lit(True))
    merged = stored.join(now, ["repo", "finding"], "full_outer").join(scanned.select("repo", "scan"), "repo", "left")
    fresh, present, scan = F.col("status").isNull(), F.col("present").isNotNull(), F.col("scan")
    closes = ~present & scan.isNotNull() & (F.col("status") == "open")
    status = (
        F.when(fresh, "open")
        .when(present & (F.col("status") != "dismissed"), "open")
        .when(closes, "fixed")
        .otherwise(F.col("status"))
    )
    return merged.select(
        "repo",
        "finding",
        F.when(fresh, scan).otherwise(F.col("first_seen")).alias("first_seen"),
        F.when(present | closes, scan).otherwise(F.col("last_seen")).alias("last_seen"),
        status.alias("status"),
    )


def apply_scans(stored: DataFrame, scans: DataFrame, found: DataFrame) -> DataFrame:
    """The stored findings after any number of new scans per repository, in one step.

    The scans must be newer than those already applied. ``stored``: repo, finding, first_seen, last_seen, status.
    """
    numbered = number_scans(scans)
    edge = numbered.groupBy("repo").agg(F.max("n").alias("n_last"), F.min("scan").alias("opening"))
    seen = _presence(found, scans).groupBy("repo", "finding").agg(
        F.min("scan").alias("first_now"), F.max(F.struct("n", "scan")).alias("latest")
    )
    closing = numbered.select("repo", (F.col("n") - 1).alias("n"), F.col("scan").alias("closed_at"))
    seen = seen.select("repo", "finding", "first_now", F.col("latest.n").alias("n"), F.col("latest.scan").alias("seen_at")).join(
        closing, ["repo", "n"], "left"
    )
    out = stored.join(seen, ["repo", "finding"], "full_outer").join(edge, "repo", "left")
    present, dismissed = F.col("n").isNotNull(), F.coalesce(F.col("status") == "dismissed", F.lit(False))
    at_end = F.col("n") == F.col("n_last")
    closes = ~present & F.col("n_last").isNotNull() & (F.col("status") == "open")
    status = (
        F.when(dismissed, "dismissed").when(present & at_end, "open").when(present, "fixed").when(closes, "fixed").otherwise(F.col("status"))
    )
    last_seen = (
        F.when(present & (at_end | dismissed), F.col("seen_at"))
        .when(present, F.col("closed_at"))
        .when(closes, F.col("opening"))
        .otherwise(F.col("last_seen"))
    )
    return out.select(
        "repo", "finding", F.coalesce("first_seen", "first_now").alias("first_seen"), last_seen.alias("last_seen"), status.alias("status")
    )


def round_delta(stored: DataFrame, scanned: DataFrame, found: DataFrame, history: DataFrame) -> DataFrame:
    """repo, finding, event of one round: added, returned, resolved; no news from a repository's first scan.

    ``history``: repo, one row per repository scanned before.
    """
    known = history.select("repo").distinct()
    now = found.select("repo", "finding").distinct()
    again = now.join(known, "repo", "left_semi")
    keys = ["repo", "finding"]
    added = again.join(stored.select(*keys), keys, "left_anti").withColumn("event", F.lit("added"))
    returned = again.join(stored.filter("status = 'fixed'").select(*keys), keys, "left_semi").withColumn("event", F.lit("returned"))
    open_before = stored.filter("status = 'open'").join(scanned.select("repo"), "repo", "left_semi").select(*keys)
    resolved = open_before.join(now, keys, "left_anti").withColumn("event", F.lit("resolved"))
    return added.unionByName(returned).unionByName(resolved)


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old and new rows with the last one per key kept: an upsert as an aggregation, safe to repeat."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def prune(tables: dict[str, DataFrame], repos: DataFrame | None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(kept tables, counts per table): rows of the named repositories removed, or of all where none is named."""
    kept, counts = {}, None
    for name, table in tables.items():
        doomed = table if repos is None else table.join(repos.select("repo").distinct(), "repo", "left_semi")
        kept[name] = table.limit(0) if repos is None else table.join(repos.select("repo").distinct(), "repo", "left_anti")
        row = doomed.agg(F.count(F.lit(1)).alias("n_deleted")).select(F.lit(name).alias("table"), "n_deleted")
        counts = row if counts is None else counts.unionByName(row)
    return kept, counts


def append(rows: DataFrame, path: str, partition: str) -> None:
    """History tables only grow: scans by day, verification runs by day."""
    rows.write.mode("append").partitionBy(partition).parquet(path)


def rewrite(rows: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions that ``rows`` holds."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
