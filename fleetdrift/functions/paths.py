"""Paths, module names and hosts as exploded keys.

"Is under" and "ends with" become equality on one of a handful of prefixes or suffixes, which lets Spark
hash-join what would otherwise be a comparison of every pair.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def _prefixes(text: Column, separator: str, pattern: str) -> Column:
    return let(
        F.split(text, pattern),
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator)
        ),
    )


def _suffixes(text: Column, separator: str, pattern: str) -> Column:
    return let(
        F.split(text, pattern),
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), separator)
        ),
    )


def dotted_prefixes(module: Column) -> Column:
    return _prefixes(module, ".", r"\.")


def path_suffixes(path: Column) -> Column:
    return _suffixes(forward_slashes(path), "/", "/")


def host_suffixes(host: Column) -> Column:
    return _suffixes(host, ".", r"\.")


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def same_file(a: Column, b: Column) -> Column:
    """Equal, or one is the tail of the other at a folder boundary."""
    x, y = forward_slashes(a), forward_slashes(b)
    return (x == y) | x.endswith(F.concat(F.lit("/"), y)) | y.endswith(F.concat(F.lit("/"), x))


def parent_path(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)\.[^.]*$", 1)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, r"\."), -1)


def loose_signature(signature: Column) -> Column:
    """Case, whitespace, ``$`` and ``_`` do not count."""
    return F.lower(F.regexp_replace(signature, r"[$_\s]", ""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def package_of_specifier(spec: Column) -> Column:
    """The package an import specifier names; relative, absolute and ``node:`` specifiers name none."""
    parts = F.split(spec, "/")
    scoped = F.when(F.size(parts) >= 2, F.concat_ws("/", F.get(parts, 0), F.get(parts, 1)))
    return F.when(
        ~(spec.startswith(".") | spec.startswith("/") | spec.startswith("node:")),
        F.when(spec.startswith("@"), scoped).otherwise(F.get(parts, 0)),
    )


def canonical_name(name: Column) -> Column:
    """Distribution names compare lower case with runs of ``-_.`` as one dash."""
    return F.lower(F.regexp_replace(name, r"[-_.]+", "-"))
