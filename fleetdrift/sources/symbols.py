"""Symbol tables of packages as input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let


def is_public(name: Column, exported: Column) -> Column:
    """An ``__all__`` list decides where there is one, else a leading underscore hides."""
    return F.coalesce(F.array_contains(exported, name), ~name.startswith("_"))


def merge_modules(statements: DataFrame) -> DataFrame:
    """pkg, version, path, kind, signature, file: one symbol per path over all modules of a package.

    ``statements``: pkg, version, file, pos, path, name, kind, signature, exported ARRAY. Files are visited in
    sorted order and a later definition replaces an earlier one. Only the top-level name decides visibility.
    """
    visible = statements.filter(is_public(F.get(F.split("path", r"\."), 0), F.col("exported")))
    last = F.max_by(F.struct("kind", "signature", "file"), F.struct("file", "pos"))
    return visible.groupBy("pkg", "version", "path").agg(last.alias("s")).select("pkg", "version", "path", "s.*")


def import_roots(files: DataFrame) -> DataFrame:
    """pkg, root: the shallowest folder with an ``__init__`` above each file, else the module itself.

    Roots below another root are dropped. ``files``: pkg, path.
    """
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.pyi?$", "")
    folders = let(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda dirs: F.when(
            F.size(dirs) > 0,
            F.transform(F.sequence(F.lit(1), F.size(dirs)), lambda n: F.array_join(F.slice(dirs, F.lit(1), n), "/")),
        ).otherwise(F.array().cast("array<string>")),
    )
    inits = files.filter(F.col("path").rlike(r"/__init__\.pyi?$")).select(
        "pkg", F.regexp_replace("path", r"/__init__\.pyi?$", "").alias("folder")
    ).distinct()
    keyed = files.select("pkg", "path", F.posexplode_outer(folders).alias("depth", "folder"))
    shallow = (
        keyed.join(inits.withColumn("is_package", F.lit(True)), ["pkg", "folder"], "left")
        .groupBy("pkg", "path")
        .agg(F.min_by("folder", F.when(F.col("is_package"), F.col("depth"))).alias("folder"))
    )
    dotted = F.concat_ws(".", F.nullif(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "."), F.lit("")), stem)
    roots = shallow.select("pkg", F.coalesce(F.translate("folder", "/", "."), dotted).alias("root")).distinct()
    above = roots.select(
        "pkg",
        "root",
        F.explode(
            let(
                F.split("root", r"\."),
                lambda p: F.filter(
                    F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.when(n < F.size(p), F.array_join(F.slice(p, F.lit(1), n), "."))),
                    lambda x: x.isNotNull(),
                ),
            )
        ).alias("outer"),
    )
    nested = above.join(roots.select("pkg", F.col("root").alias("outer")), ["pkg", "outer"], "left_semi").select("pkg", "root")
    return roots.join(nested, ["pkg", "root"], "left_anti")
