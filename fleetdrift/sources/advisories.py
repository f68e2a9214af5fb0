"""Advisory dumps: nested records to one row per affected window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.versions import version_key

# Range types whose events are installable versions; commit hashes are not.
INSTALLABLE_RANGES = ("SEMVER", "ECOSYSTEM")


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{schemas.ADVISORY}, _corrupt_record string").json(path)


def parse_advisories(documents: DataFrame, column: str = "content") -> DataFrame:
    """JSON text rows to records; an unreadable text keeps its row with status ``unreadable``."""
    record = F.from_json(F.col(column), schemas.ADVISORY)
    parsed = documents.select(*[c for c in documents.columns if c != column], record.alias("r"))
    return parsed.select("*", "r.*", F.when(F.col("r.id").isNull(), "unreadable").otherwise("read").alias("status")).drop("r")


def windows_of_events(events: Column) -> Column:
    """Affected windows of one range, events taken in listed order.

    An ``introduced`` event opens a window; the first ``fixed`` or ``last_affected`` before the next
    ``introduced`` closes it. A window that the next ``introduced`` interrupts is void; only the last one may
    stay open.
    """
    at = F.sequence(F.lit(0), F.size(events) - 1)
    openings = F.filter(at, lambda i: F.get(events, i)["introduced"].isNotNull())

    def window(i):
        following = F.filter(openings, lambda j: j > i)
        end = F.coalesce(F.get(following, 0), F.size(events))
        closing = F.filter(
            F.slice(events, i + 2, F.greatest(end - i - 1, F.lit(0))),
            lambda e: e["fixed"].isNotNull() | e["last_affected"].isNotNull(),
        )
        close = F.get(closing, 0)
        return F.struct(
            i.cast("int").alias("event_pos"),
            F.get(events, i)["introduced"].alias("introduced"),
            close["fixed"].alias("fixed"),
            F.when(close["fixed"].isNull(), close["last_affected"]).alias("last_affected"),
            (close.isNotNull() | (F.size(following) == 0)).alias("valid"),
        )

    return F.when(F.size(events) > 0, F.filter(F.transform(openings, window), lambda w: w["valid"]))


def advisory_windows(records: DataFrame) -> DataFrame:
    """advisory, ecosystem, name, position in listed order, bounds and their sort keys. No shuffle."""
    entries = records.select(F.col("id").alias("advisory"), F.posexplode("affected").alias("affected_pos", "a"))
    ranges = entries.select(
        "advisory",
        "affected_pos",
        F.col("a.package.ecosystem").alias("ecosystem"),
        F.col("a.package.name").alias("name"),
        F.posexplode("a.ranges").alias("range_pos", "r"),
    ).filter(F.col("r.type").isin(*INSTALLABLE_RANGES))
    flat = ranges.select("advisory", "affected_pos", "ecosystem", "name", "range_pos", F.inline(windows_of_events(F.col("r.events"))))
    return with_window_keys(flat.drop("valid"))


def with_window_keys(windows: DataFrame) -> DataFrame:
    """Sort keys of the bounds; an ``introduced`` of 0 means from the start and has no key."""
    eco = F.col("ecosystem")
    return windows.withColumns(
        {
            "introduced_key": F.when(F.col("introduced") != "0", version_key(eco, F.col("introduced"))),
            "fixed_key": F.when(F.col("fixed").isNotNull(), version_key(eco, F.col("fixed"))),
            "last_key": F.when(F.col("last_affected").isNotNull(), version_key(eco, F.col("last_affected"))),
        }
    )


def advisory_names(records: DataFrame) -> DataFrame:
    """advisory, first CVE alias, first CVSS vector, summary."""
    cve = F.get(F.filter("aliases", lambda a: a.startswith("CVE-")), 0)
    vector = F.get(F.filter("severity", lambda s: s["score"].isNotNull()), 0)["score"]
    return records.select(
        F.col("id").alias("advisory"), cve.alias("cve"), vector.alias("cvss_vector"), F.coalesce("summary", F.lit("")).alias("summary")
    )


def parse_facts(documents: DataFrame, column: str = "content") -> DataFrame:
    """advisory, severity, CVSS score, EPSS percentile, first CWE; unreadable documents give no row of facts."""
    d = F.from_json(F.col(column), schemas.ADVISORY_FACTS)
    return documents.select(d.alias("d")).filter(F.col("d.ghsa_id").isNotNull()).select(
        F.col("d.ghsa_id").alias("advisory"),
        F.col("d.severity").alias("severity"),
        F.col("d.cvss.score").alias("cvss_score"),
        F.col("d.epss.percentile").alias("epss_percentile"),
        F.get(F.col("d.cwes"), 0)["cwe_id"].alias("cwe"),
    )
