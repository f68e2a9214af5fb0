"""Source files of checked-out repositories as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How the names of source files end, and folders that are never walked.
SOURCE_ENDINGS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".py", ".pyi", ".sh", ".bash", "Dockerfile", "Containerfile")
SKIPPED_FOLDERS = (
    "node_modules", ".git", "dist", "build", "coverage", ".next", "out",
    ".venv", "venv", "__pycache__", "site-packages", ".tox", ".nox", "envs",
)


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """repo, file, content below ``root/<repo>/...``. Spark lists and splits the files; nothing is collected."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    )
    inside = F.regexp_extract("path", r"^(?:[a-z]+:/*)?" + root.split(":", 1)[-1].strip("/") + r"/+([^/]+)/(.*)$", 1)
    rest = F.regexp_extract("path", r"^(?:[a-z]+:/*)?" + root.split(":", 1)[-1].strip("/") + r"/+([^/]+)/(.*)$", 2)
    return files.select(inside.alias("repo"), rest.alias("file"), F.decode("content", "UTF-8").alias("content"), "length", "modificationTime")


def source_files(files: DataFrame) -> DataFrame:
    """Files whose name ends like source, outside the skipped folders; ``env`` is one where it holds ``pyvenv.cfg``."""
    ending = r"(" + "|".join(e.replace(".", r"\.") for e in SOURCE_ENDINGS) + ")$"
    folders = r"(^|/)(" + "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS) + ")/"
    walked = files.filter(F.col("file").rlike(ending) & ~F.col("file").rlike(folders))
    above = F.regexp_extract("file", r"^((?:.*/)?env)/pyvenv\.cfg$", 1)
    virtual = files.select("repo", above.alias("env")).filter("env <> ''").distinct()
    inside = walked.filter(F.col("file").rlike(r"(^|/)env/"))
    parts = F.split("file", "/")
    folder = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), lambda f: f.rlike("(^|/)env$"))
    hidden = inside.select("repo", "file", F.explode(folder).alias("env")).join(virtual, ["repo", "env"]).select("repo", "file").distinct()
    return walked.join(hidden, ["repo", "file"], "left_anti")


def escaping_links(entries: DataFrame) -> DataFrame:
    """Links that point out of their repository: listed, never read. ``entries``: repo, file, link_target."""
    target = F.col("link_target")
    up = F.size(F.filter(F.split(target, "/"), lambda s: s == ".."))
    depth = F.size(F.split("file", "/")) - 1
    return entries.filter(target.isNotNull() & (target.startswith("/") | (up > depth)))
