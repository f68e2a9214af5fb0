"""Small numeric scores and their spelled-out forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity labels from worst to mildest.
LABEL_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
BYTE_UNITS = ("B", "KB", "MB", "GB")


def urgency(has_facts: Column, epss: Column, cvss: Column, label: Column) -> Column:
    """Exploitation likelihood above any CVSS score, CVSS above the bare label, no facts below everything."""
    ranks = F.create_map(*[F.lit(x) for pair in LABEL_RANK.items() for x in pair])
    by_label = F.coalesce(F.try_element_at(ranks, F.coalesce(label, F.lit(""))).cast("double"), F.lit(0.0))
    return F.when(
        F.coalesce(has_facts, F.lit(False)),
        F.coalesce(F.lit(100.0) + epss * F.lit(100.0), cvss, by_label),
    ).otherwise(F.lit(-1.0))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th."""
    teens = (n % 100).between(11, 13)
    ending = F.when(teens, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)


def human_bytes(n: Column) -> Column:
    """Bytes in the largest unit that keeps the number at 1 or more; one decimal below ten."""

    def shown(unit):
        value = n / F.lit(float(1024**unit))
        whole = F.floor(value + F.lit(0.5)).cast("string")
        text = F.when(value < 10, F.format_number(value, 1)).otherwise(whole) if unit else whole
        return F.concat(text, F.lit(BYTE_UNITS[unit]))

    return F.when(n < 1024, shown(0)).when(n < 1024**2, shown(1)).when(n < 1024**3, shown(2)).otherwise(shown(3))


def branch_slug(name: Column) -> Column:
    """Lower case, everything but letters and digits as single dashes, none at the ends."""
    dashed = F.regexp_replace(name, "[^A-Za-z0-9]+", "-")
    return F.lower(F.regexp_replace(dashed, "^-+|-+$", ""))
