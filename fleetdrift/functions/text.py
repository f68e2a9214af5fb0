"""Whitespace, lines and repeated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c ﻿  "


def strip(text: Column) -> Column:
    """Without white space at both ends; Spark's own ``trim`` takes spaces only."""
    return F.trim(text, F.lit(BLANKS))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def strip_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def occurrences(text: Column, needle: Column) -> Column:
    """How often ``needle`` stands in ``text``, not counting overlaps; 0 for an empty needle."""
    removed = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (removed / F.length(needle)).cast("int")).otherwise(0)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda would be computed again for every element; as an array element it is
    bound to a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), 0)


def firsts(entries: Column, key: str) -> Column:
    """The smallest struct of each ``key``, the first field of ``entries``."""
    return let(F.sort_array(entries), lambda e: F.filter(e, lambda x, i: ~x[key].eqNullSafe(F.get(e, i - 1)[key])))


def lines_of(content: Column) -> Column:
    return F.split(content, "\n")


def line_blocks(content: Column, is_header) -> Column:
    """Header lines with the lines up to the next header: array of (pos, header, lines), pos counted from 0.

    The carry-forward of a header over the lines below it, inside one row: linear in the text, no shuffle.
    """

    def cut(lines):
        marks = F.filter(F.transform(lines, lambda l, i: F.when(is_header(l), i)), lambda i: i.isNotNull())

        def block(at, k, all_marks):
            end = F.coalesce(F.get(all_marks, k + 1), F.size(lines))
            return F.struct(
                at.alias("pos"), F.get(lines, at).alias("header"), F.slice(lines, at + 2, F.greatest(end - at - 1, F.lit(0))).alias("lines")
            )

        return let(marks, lambda all_marks: F.transform(all_marks, lambda at, k: block(at, k, all_marks)))

    return let(lines_of(content), cut)


def first_match(lines: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first line that matches with a non-empty group, else NULL."""
    return F.get(F.filter(F.transform(lines, lambda l: F.regexp_extract(l, pattern, group)), lambda m: m != ""), 0)
