"""Content ids: the first 12 hex digits of a hash over the identifying fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 12)


def surface_id(pkg, from_version, to_version, path, kind) -> Column:
    return content_id(pkg, from_version, to_version, path, kind)


def tagged_id(tag: str, *parts: Column) -> Column:
    """Ids of the detectors that prefix their own name: features, freshness, pins, vulnerabilities and so on."""
    return content_id(F.lit(tag), *parts)
