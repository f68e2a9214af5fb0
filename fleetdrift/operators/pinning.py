"""Copies of one version that disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions import ids

DATED = r"^(\d{4}-\d{2}-\d{2})"


def behind_current(pinned: Column, current: Column) -> Column:
    """Is a dated version older than another; NULL when either carries no date."""
    a, b = (F.nullif(F.regexp_extract(strip(v), DATED, 1), F.lit("")) for v in (pinned, current))
    return a < b


def image_conflicts(pins: DataFrame, installed: DataFrame) -> DataFrame:
    """Image pins whose version differs from the installed one of the same name. A subject not installed yields nothing."""
    images = pins.filter("kind = 'docker-image'").filter(F.col("subject").isNotNull())
    return (
        images.join(installed.select("repo", F.col("name").alias("subject"), F.col("installed").alias("expected")), ["repo", "subject"])
        .filter(F.col("version") != F.col("expected"))
        .select("repo", "subject", "expected", F.concat(F.lit("the installed "), F.col("subject")).alias("authority"), "file", "line", "version", "text")
    )


def node_conflicts(pins: DataFrame) -> DataFrame:
    """Pins of the runtime where a repository names more than one version.

    The manifest arbitrates where it has a say: then only the pins that differ from it are listed. Otherwise
    nothing is expected and all of them are.
    """
    node = pins.filter("kind = 'node-version'")
    manifest = F.col("file").endswith("package.json")
    verdict = (
        node.groupBy("repo")
        .agg(
            F.min("version").alias("low"),
            F.max("version").alias("high"),
            F.min_by("version", F.when(manifest, F.struct("file", "line"))).alias("expected"),
        )
        .filter("low <> high")
        .select("repo", "expected")
    )
    authority = F.when(F.col("expected").isNotNull(), "the declared engines.node")
    return (
        node.join(verdict, "repo")
        .filter(F.col("expected").isNull() | (F.col("version") != F.col("expected")))
        .select("repo", "subject", "expected", authority.alias("authority"), "file", "line", "version", "text")
    )


def pin_conflicts(pins: DataFrame, installed: DataFrame) -> DataFrame:
    """One row per disagreeing pin; group by (repo, subject) for the conflicts themselves."""
    return image_conflicts(pins, installed).unionByName(node_conflicts(pins))


def unarbitrated(pins: DataFrame) -> DataFrame:
    """Wire API versions: nothing in the repository says which one is right."""
    return pins.filter("kind = 'api-version'")


def repairs(conflicts: DataFrame) -> DataFrame:
    """The edit that brings each pin to the expected version; none where nothing is expected."""
    at = F.instr(F.col("text"), F.col("version"))
    replaced = F.overlay("text", "expected", at, F.length("version"))
    return conflicts.filter("expected IS NOT NULL").select(
        "repo",
        "file",
        "line",
        F.col("text").alias("find"),
        F.when(at > 0, replaced).otherwise(F.col("text")).alias("replace"),
        F.concat("subject", F.lit(" is "), "expected", F.lit(" per "), "authority").alias("reason"),
    )


def describe(conflicts: DataFrame) -> DataFrame:
    """repo, subject, head, site: the sentence of each conflict and, one row each, the places it lists."""
    site = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" ("), "version", F.lit(")"))
    head = F.when(
        F.col("expected").isNotNull(),
        F.concat(F.lit("- `"), "subject", F.lit("` should be "), "expected", F.lit(" per "), "authority", F.lit(", but ")),
    ).otherwise(F.concat(F.lit("- `"), "subject", F.lit("` is pinned inconsistently and nothing declares the intended version: ")))
    return conflicts.select("repo", "subject", head.alias("head"), site.alias("site"))


def with_pin_ids(conflicts: DataFrame) -> DataFrame:
    return conflicts.withColumn(
        "finding_id", ids.tagged_id("version-pin", F.col("subject"), F.col("version"), F.coalesce("expected", F.lit("")), F.col("file"))
    )
