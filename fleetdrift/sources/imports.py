"""Import statements in source text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import package_of_specifier
from ..functions.text import lines_of
from ..session import ship_package
from .callscan import places, scan_imports

NAMED_IMPORT = r"""(?s)import\s+(?:type\s+)?\{([^}]*)\}\s*from\s*['"]([^'"]+)['"]"""
PY_IMPORT = r"^\s*import\s+(.+)$"
PY_FROM = r"^\s*from\s+([A-Za-z_][\w.]*)\s+import\b"


_SITE = pa.schema([("repo", pa.string()), ("file", pa.string()), ("line", pa.int32()), ("specifier", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for repo, file, content in zip(*(batch.column(c).to_pylist() for c in ("repo", "file", "content")), strict=True):
            found = scan_imports(content)
            for (_, specifier), (line, _) in zip(found, places(content, [at for at, _ in found]), strict=True):
                rows.append({"repo": repo, "file": file, "line": line, "specifier": specifier})
        yield pa.RecordBatch.from_pylist(rows, _SITE)


def import_sites(files: DataFrame) -> DataFrame:
    """repo, file, line, pkg of ES imports and ``require`` calls; specifiers that name no package give nothing.

    A statement over several lines has the line it starts on. Comments and strings are left out.
    """
    ship_package(files.sparkSession)
    likely = files.filter(F.col("content").contains("import") | F.col("content").contains("require")).select("repo", "file", "content")
    found = likely.mapInArrow(_scan, "repo string, file string, line int, specifier string")
    return found.select("repo", "file", "line", package_of_specifier(F.col("specifier")).alias("pkg")).filter("pkg IS NOT NULL")


def import_index(sites: DataFrame) -> DataFrame:
    """Per (repo, pkg): how many sites in how many files."""
    return sites.groupBy("repo", "pkg").agg(F.count(F.lit(1)).alias("n_sites"), F.countDistinct("file").alias("n_files"))


def named_imports(files: DataFrame) -> DataFrame:
    """repo, file, pkg, name of names imported from a package, under the name the package exports."""
    names = F.regexp_extract_all("content", F.lit(NAMED_IMPORT), F.lit(1))
    specs = F.regexp_extract_all("content", F.lit(NAMED_IMPORT), F.lit(2))
    clauses = files.select("repo", "file", F.explode(F.arrays_zip(names.alias("names"), specs.alias("spec"))).alias("c"))
    entries = clauses.select("repo", "file", "c.spec", F.explode(F.split("c.names", ",")).alias("entry"))
    bare = F.regexp_replace(F.regexp_replace("entry", r"^\s+|\s+$", ""), r"^type\s+", "")
    name = F.get(F.split(bare, r"\s+as\s+"), 0)
    return entries.select("repo", "file", package_of_specifier(F.col("spec")).alias("pkg"), name.alias("name")).filter(
        "pkg IS NOT NULL AND name <> ''"
    )


def imports_symbol_from(source: Column, symbol: Column, pkg: Column) -> Column:
    """Does the text import ``symbol`` from ``pkg`` or a path below it, by that export name."""
    names = F.regexp_extract_all(source, F.lit(NAMED_IMPORT), F.lit(1))
    specs = F.regexp_extract_all(source, F.lit(NAMED_IMPORT), F.lit(2))

    def matches(clause):
        spec = clause["spec"]
        entries = F.split(clause["names"], ",")
        named = F.exists(
            entries,
            lambda e: F.get(F.split(F.regexp_replace(F.regexp_replace(e, r"^\s+|\s+$", ""), r"^type\s+", ""), r"\s+as\s+"), 0) == symbol,
        )
        return ((spec == pkg) | spec.startswith(F.concat(pkg, F.lit("/")))) & named

    return F.exists(F.arrays_zip(names.alias("names"), specs.alias("spec")), matches)


def uses_member(source: Column, member: Column) -> Column:
    escaped = F.regexp_replace(member, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.rlike(source, F.concat(F.lit(r"\.\s*"), escaped, F.lit(r"\b")))


def deprecation_still_present(path: Column, pkg: Column, source: Column) -> Column:
    """A top-level symbol is still imported, or a member is still accessed."""
    leaf = F.element_at(F.split(path, r"\."), -1)
    return F.when(path.contains("."), uses_member(source, leaf)).otherwise(imports_symbol_from(source, leaf, pkg))


def python_imports(files: DataFrame) -> DataFrame:
    """repo, file, line, module of ``import a, b as c`` and ``from a.b import c``; relative imports give nothing."""
    lines = files.select("repo", "file", F.posexplode(lines_of(F.col("content"))).alias("n", "text")).filter(F.col("text").contains("import"))
    plain = F.transform(
        F.split(F.regexp_extract(F.get(F.split("text", "#"), 0), PY_IMPORT, 1), ","),
        lambda m: F.regexp_extract(m, r"^\s*([A-Za-z_][\w.]*)", 1),
    )
    modules = F.filter(F.concat(plain, F.array(F.regexp_extract("text", PY_FROM, 1))), lambda m: m != "")
    return lines.select("repo", "file", (F.col("n") + 1).alias("line"), F.explode(modules).alias("module"))
