"""Manifests and registry documents to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from .. import schemas

# Fixed value: declarations that do not name a registry version.
NOT_REGISTRY = r"^(file:|link:|workspace:|git\+|https?:|catalog:|npm:file)"


def registry_declarations(declared: DataFrame) -> DataFrame:
    return declared.filter(~F.col("declared").rlike(NOT_REGISTRY))


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """repo, workspace, name, declared, dev from ``files(repo, workspace, content)``; unreadable manifests give nothing here."""
    doc = F.from_json("content", schemas.MANIFEST)
    empty = F.create_map().cast("map<string,string>")

    def group(column, dev):
        entries = F.map_entries(F.coalesce(F.col(f"m.{column}"), empty))
        return F.transform(entries, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("declared"), F.lit(dev).alias("dev")))

    rows = files.select("repo", "workspace", doc.alias("m")).select(
        "repo", "workspace", F.inline(F.concat(group("dependencies", False), group("devDependencies", True)))
    )
    return registry_declarations(rows)


def manifest_status(files: DataFrame) -> DataFrame:
    """repo, workspace, status: an unreadable manifest is named, not taken for an empty one."""
    readable = F.from_json("content", "map<string,string>").isNotNull() & strip(F.col("content")).startswith("{")
    return files.select("repo", "workspace", F.when(readable, "read").otherwise("unreadable").alias("status"))


def overrides(files: DataFrame) -> DataFrame:
    """repo, name, version of every override a manifest already states."""
    doc = F.from_json("content", schemas.MANIFEST)
    return files.select("repo", F.explode(doc["overrides"]).alias("name", "version"))


def npm_catalogue(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, versions) of package documents in ``documents(content)``."""
    d = documents.select(F.from_json("content", schemas.PACKUMENT).alias("d")).filter(F.col("d.name").isNotNull())
    tags = d.select(F.col("d.name").alias("name"), F.col("d.dist-tags.latest").alias("latest"), F.lit("npm").alias("ecosystem"))
    versions = d.select(F.col("d.name").alias("name"), F.lit("npm").alias("ecosystem"), F.explode(F.map_keys("d.versions")).alias("version"))
    return tags, versions


def pypi_catalogue(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = documents.select(F.from_json("content", schemas.PYPI_DOCUMENT).alias("d")).filter(F.col("d.info.name").isNotNull())
    tags = d.select(F.col("d.info.name").alias("name"), F.col("d.info.version").alias("latest"), F.lit("PyPI").alias("ecosystem"))
    versions = d.select(F.col("d.info.name").alias("name"), F.lit("PyPI").alias("ecosystem"), F.explode(F.map_keys("d.releases")).alias("version"))
    return tags, versions


def read_benchmark_cases(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark case files; a file that holds no array of cases gives none."""
    cases = spark.read.schema("value string").text(path, wholetext=True)
    return parse_benchmark_cases(cases.select(F.col("value").alias("content")))


def parse_benchmark_cases(files: DataFrame) -> DataFrame:
    parsed = F.from_json("content", f"array<struct<{_fields(schemas.BENCHMARK_CASE)}>>")
    is_array = strip(F.col("content")).startswith("[")
    return files.select(F.inline(F.when(is_array, parsed))).filter("id IS NOT NULL").select(
        F.col("id").alias("case_id"), "pkg", F.col("toVersion").alias("to_version"), F.col("minimalEdits").alias("minimal_edits")
    )


def _fields(ddl: str) -> str:
    return ", ".join(":".join(part.split()) for part in ddl.split(","))
