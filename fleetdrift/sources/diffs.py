"""Unified diffs to hunks and lines.

A diff is one row. It is cut into files and hunks inside the row; line numbers run within one hunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, lines_of, strip

HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
TYPE_ESCAPE = r"(:\s*any\b|\bas\s+any\b|as\s+unknown\s+as\b|@ts-ignore|@ts-expect-error)"


def _numbered(diffs: DataFrame) -> DataFrame:
    return diffs.select("id", F.posexplode(lines_of(F.col("diff"))).alias("pos", "text"))


def hunks(diffs: DataFrame) -> DataFrame:
    """id, file, start, end. ``diff --git`` resets the file; a deleted file keeps the name of its old side."""

    def marks(lines):
        state = F.struct(F.lit("").alias("file"), F.array().cast("array<struct<file:string,start:int,end:int>>").alias("out"))

        def step(acc, line):
            new = F.regexp_extract(line, r"^\+\+\+ b/(.+)$", 1)
            old = F.regexp_extract(line, r"^--- a/(.+)$", 1)
            start = F.regexp_extract(line, HUNK, 1)
            span = F.coalesce(F.nullif(F.regexp_extract(line, HUNK, 2), F.lit("")).cast("int"), F.lit(1))
            begin = F.nullif(start, F.lit("")).cast("int")
            hunk = F.struct(
                acc["file"].alias("file"), begin.alias("start"), (begin + F.greatest(span - 1, F.lit(0))).cast("int").alias("end")
            )
            return F.struct(
                F.when(line.startswith("diff --git "), "").when(new != "", new).when(old != "", old).otherwise(acc["file"]).alias("file"),
                F.when((start != "") & (acc["file"] != ""), F.concat(acc["out"], F.array(hunk))).otherwise(acc["out"]).alias("out"),
            )

        # only header lines matter here, so the fold is over a few of them
        heads = F.filter(lines, lambda l: l.rlike(r"^(diff --git |\+\+\+ b/|--- a/|@@ )"))
        return F.aggregate(heads, state, step)["out"]

    return diffs.select("id", F.inline(let(lines_of(F.col("diff")), marks)))


def _sections(diffs: DataFrame, is_start: Column) -> DataFrame:
    """Lines with the position of the latest section start above them."""
    above = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return _numbered(diffs).withColumn("section", F.last(F.when(is_start, F.col("pos")), ignorenulls=True).over(above))


def touched_lines(diffs: DataFrame) -> DataFrame:
    """id, file, line of every added line, numbered on the new side.

    A diff's own lines are the window, so the work per task is one diff row, which was one row to begin with.
    """
    w = Window.partitionBy("id").orderBy("pos")
    above = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    text = F.col("text")
    header = F.regexp_extract(text, r"^\+\+\+ (?:b/)?(.+)$", 1)
    start = F.nullif(F.regexp_extract(text, HUNK, 1), F.lit("")).cast("int")
    is_header, is_old = header != "", text.startswith("--- ")
    marked = _numbered(diffs).select(
        "id",
        "pos",
        "text",
        F.when(is_header, strip(header)).alias("head"),
        F.when(~is_header & ~is_old, start).alias("start"),
        (~is_header & ~is_old & start.isNull() & (text.startswith("+") | text.startswith(" ") | (text == ""))).alias("counts"),
    )
    filed = marked.withColumn("file", F.last("head", ignorenulls=True).over(above))
    counted = filed.withColumn("step", (F.col("counts") & F.col("file").isNotNull()).cast("int"))
    numbered = counted.withColumns(
        {"seen": F.coalesce(F.sum("step").over(before), F.lit(0)), "base": F.last("start", ignorenulls=True).over(above)}
    )
    at_start = F.last(F.when(F.col("start").isNotNull(), F.col("seen")), ignorenulls=True).over(above)
    placed = numbered.withColumn("origin", F.coalesce(at_start, F.lit(0)))
    line = (F.coalesce("base", F.lit(0)) + F.col("seen") - F.col("origin")).cast("int")
    return placed.filter((F.col("step") == 1) & F.col("text").startswith("+")).select("id", "file", line.alias("line"))


def type_escapes(diffs: DataFrame) -> DataFrame:
    """id, n: added lines that silence the type checker. Counted inside the row."""
    added = F.filter(lines_of(F.col("diff")), lambda l: l.startswith("+") & ~l.startswith("+++") & l.rlike(TYPE_ESCAPE))
    return diffs.select("id", F.size(added).alias("n_escapes"))


def changed_files(diffs: DataFrame) -> DataFrame:
    """id, file named on the new side."""
    names = F.filter(F.transform(lines_of(F.col("diff")), lambda l: F.regexp_extract(l, r"^\+\+\+ b/(.+)$", 1)), lambda n: n != "")
    return diffs.select("id", F.explode(F.array_distinct(names)).alias("file"))


def keep_hunks(diffs: DataFrame, kept: DataFrame) -> DataFrame:
    """id, diff with only the kept hunks; a file's header stands once, and only where a hunk of it survives.

    ``kept``: id, file, start.
    """
    text = F.col("text")
    file_start = _sections(diffs, text.startswith("diff --git "))
    in_file = Window.partitionBy("id", "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.nullif(F.regexp_extract(text, HUNK, 1), F.lit("")).cast("int")
    lines = file_start.withColumns({"start": start, "hunk": F.last(F.when(start.isNotNull(), F.col("pos")), ignorenulls=True).over(in_file)})
    head = F.col("hunk").isNull()
    new = F.nullif(F.regexp_extract(text, r"^\+\+\+ (?:b/)?(.+)$", 1), F.lit(""))
    old = F.nullif(F.regexp_extract(text, r"^--- (?:a/)?(.+)$", 1), F.lit(""))
    named = F.when(head & (F.coalesce(new, old) != "/dev/null"), F.coalesce(new, old))
    named_lines = lines.withColumn("file", F.last(named, ignorenulls=True).over(in_file))
    chosen = (
        named_lines.filter("start IS NOT NULL")
        .join(kept.select("id", "file", "start").distinct(), ["id", "file", "start"], "left_semi")
        .select("id", F.coalesce("section", F.lit(-1)).alias("s"), F.col("hunk").alias("h"))
    )
    keyed = named_lines.select("id", "pos", "text", F.coalesce("section", F.lit(-1)).alias("s"), F.col("hunk").alias("h"))
    bodies = keyed.filter("h IS NOT NULL").join(chosen, ["id", "s", "h"], "left_semi")
    heads = keyed.filter("h IS NULL").join(chosen.select("id", "s").distinct(), ["id", "s"], "left_semi")
    out = (
        bodies.select("id", "pos", "text")
        .unionByName(heads.select("id", "pos", "text"))
        .groupBy("id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda l: l["text"]), "\n").alias("diff"))
    )
    whole = diffs.select("id").join(out, "id", "left")
    patch = F.coalesce("diff", F.lit(""))
    return whole.select(
        "id", F.when(strip(patch) == "", "").when(patch.endswith("\n"), patch).otherwise(F.concat(patch, F.lit("\n"))).alias("diff")
    )
