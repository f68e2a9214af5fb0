"""Which edits the evidence asked for, and which edits still fit the files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import forward_slashes, path_suffixes
from ..functions.text import lines_of, occurrences

BIN = 64


@dataclass(frozen=True)
class Gate:
    """How hunks are judged: tolerance in lines, and what happens to hunks no evidence points at."""

    window: int = 0
    unanchored: str = "revert"
    when_no_anchors: str = "judge"
    evidence_name: str = "the failure"


REVIEWER = Gate(unanchored="allow", when_no_anchors="abstain", evidence_name="the reviewer")
MIGRATION = Gate(unanchored="revert", when_no_anchors="judge", evidence_name="the migration")
LINTER = Gate(window=3, unanchored="revert", when_no_anchors="judge", evidence_name="the linter")


def review_anchors(touched: DataFrame, unfinished: DataFrame) -> DataFrame:
    """Lines the migration touched together with deprecations it left: id, file, line."""
    return touched.select("id", "file", "line").unionByName(unfinished.select("id", "file", "line")).distinct()


def _bits(low: Column, high: Column) -> Column:
    """A word with the bits low..high set."""
    run = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (F.lit(BIN - 1) - high + low).cast("int"))
    return F.call_function("shiftleft", run, low.cast("int"))


def hunks_with_anchor(hunks: DataFrame, anchors: DataFrame, window: int = 0) -> DataFrame:
    """Distinct (id, file, start, end) of hunks that some anchor points into.

    Lines are grouped in words of 64 bits: the anchors of a file become one word per 64 lines, a hunk becomes
    the words it covers, and the test is a bitwise AND. Each join is one row to one row, however many hunks and
    anchors crowd into one file. Files match where one path is the tail of the other, by exploded path tails.
    """
    points = anchors.select("id", forward_slashes(F.col("file")).alias("path"), F.col("line").cast("bigint").alias("line"))
    words = points.groupBy("id", "path", F.floor(F.col("line") / BIN).alias("bin")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("line", F.lit(BIN)).cast("int"))).alias("word")
    )
    distinct = hunks.select("id", "file", "start", "end").distinct()
    low = (F.col("start") - F.lit(window)).cast("bigint")
    high = (F.col("end") + F.lit(window)).cast("bigint")
    covered = distinct.select(
        "*", low.alias("low"), high.alias("high"), F.explode(F.sequence(F.floor(low / BIN), F.floor(high / BIN))).alias("bin")
    )
    mask = _bits(F.greatest(F.col("low") - F.col("bin") * BIN, F.lit(0)), F.least(F.col("high") - F.col("bin") * BIN, F.lit(BIN - 1)))
    covered = covered.withColumn("mask", mask).drop("low", "high")
    key = ["id", "path", "bin"]
    hit = F.col("mask").bitwiseAND(F.col("word")) != 0
    anchor_is_tail = covered.withColumn("path", F.explode(path_suffixes(F.col("file")))).join(words, key).filter(hit)
    own = covered.withColumn("path", forward_slashes(F.col("file")))
    longer = words.select("id", F.explode(path_suffixes(F.col("path"))).alias("tail"), "path", "bin", "word").filter("tail <> path")
    longer = longer.groupBy("id", F.col("tail").alias("path"), "bin").agg(F.bit_or("word").alias("word"))
    hunk_is_tail = own.join(longer, key).filter(hit)
    cols = ["id", "file", "start", "end"]
    return anchor_is_tail.select(*cols).unionByName(hunk_is_tail.select(*cols)).distinct()


def files_alike(files: DataFrame, allowed: DataFrame) -> DataFrame:
    """(id, file) of ``files`` that equal, or share a tail with, an allowed file of the same id."""
    mine = files.select("id", "file").distinct()
    ok = allowed.select("id", forward_slashes(F.col("file")).alias("path")).distinct()
    shorter = mine.select("id", "file", F.explode(path_suffixes(F.col("file"))).alias("path")).join(ok, ["id", "path"], "left_semi")
    tails = ok.select("id", F.explode(path_suffixes(F.col("path"))).alias("path")).distinct()
    longer = mine.withColumn("path", forward_slashes(F.col("file"))).join(tails, ["id", "path"], "left_semi")
    return shorter.select("id", "file").unionByName(longer.select("id", "file")).distinct()


def classify_hunks(hunks: DataFrame, anchors: DataFrame, gate: Gate, allowed_files: DataFrame | None = None) -> DataFrame:
    """Adds ``evidence`` (evidenced or unrequested) and ``reason`` to every hunk."""
    has_points = anchors.select("id").distinct().withColumn("has_points", F.lit(True))
    pointed = hunks_with_anchor(hunks, anchors, gate.window).withColumn("pointed", F.lit(True))
    out = hunks.join(has_points, "id", "left").join(pointed, ["id", "file", "start", "end"], "left")
    if allowed_files is None:
        out = out.withColumn("whole_file", F.lit(False))
    else:
        out = out.join(files_alike(hunks, allowed_files).withColumn("whole_file", F.lit(True)), ["id", "file"], "left")
    whole = F.coalesce("whole_file", F.lit(False))
    abstains = F.col("has_points").isNull() & F.lit(gate.when_no_anchors == "abstain")
    place = F.concat("file", F.lit(":"), F.col("start").cast("string"))
    who = F.lit(gate.evidence_name)
    kept = abstains | whole | F.coalesce("pointed", F.lit(False)) | F.lit(gate.unanchored == "allow")
    reason = (
        F.when(abstains, "the failure reports no locations to judge against")
        .when(whole, F.concat("file", F.lit(" is a file "), who, F.lit(" changed")))
        .when(F.col("pointed"), F.concat(who, F.lit(" points into "), place))
        .when(F.lit(gate.unanchored == "allow"), "nothing known about this line either way")
        .otherwise(F.concat(place, F.lit(" is not anywhere "), who, F.lit(" pointed")))
    )
    return out.select(*hunks.columns, F.when(kept, "evidenced").otherwise("unrequested").alias("evidence"), reason.alias("reason"))


# --- edits -----------------------------------------------------------------------------------------------------

OUTCOME = "array<struct<edit:bigint,ok:boolean,reason:string>>"


def apply_line_edits(edits: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, new texts) of positioned edits: an edit counts only where the text it replaces still stands.

    ``edits``: repo, file, edit, line, col, find, replace. Edits of one line are applied from right to left, so
    none moves the place of another; a fold over the edits of that line sees every earlier change.
    """
    wanted = edits.groupBy("repo", "file", "line").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("col")).alias("order"), "edit", "col", "find", "replace"))).alias("todo")
    )
    touched = files.join(wanted.select("repo", "file").distinct(), ["repo", "file"], "left_semi")
    lines = touched.select("repo", "file", F.posexplode(lines_of(F.col("content"))).alias("n", "text")).withColumn("line", (F.col("n") + 1).cast("int"))
    state = F.struct(F.col("text").alias("text"), F.array().cast(OUTCOME).alias("out"))

    def step(acc, e):
        actual = F.substring(acc["text"], e["col"], F.length(e["find"]))
        ok = actual == e["find"]
        text = F.concat(
            F.substring(acc["text"], F.lit(1), e["col"] - 1), e["replace"], F.substring(acc["text"], e["col"] + F.length(e["find"]), F.length(acc["text"]))
        )
        where = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(":"), e["col"].cast("string"))
        why = F.concat(
            F.lit('expected "'), e["find"], F.lit('" at '), where, F.lit(' but found "'), actual, F.lit('" — file changed since the scan')
        )
        result = F.struct(e["edit"].cast("bigint").alias("edit"), ok.alias("ok"), F.when(~ok, why).alias("reason"))
        return F.struct(F.when(ok, text).otherwise(acc["text"]).alias("text"), F.concat(acc["out"], F.array(result)).alias("out"))

    key = ["repo", "file", "line"]
    folded = lines.join(wanted, key, "left").withColumn("done", F.when(F.col("todo").isNotNull(), F.aggregate("todo", state, step)))
    done = folded.filter("done IS NOT NULL").select("repo", "file", F.inline("done.out"))
    known = files.select("repo", "file", F.size(lines_of(F.col("content"))).alias("n_lines"))
    missing = edits.join(known, ["repo", "file"], "left").filter(F.col("n_lines").isNull() | (F.col("line") > F.col("n_lines")) | (F.col("line") < 1))
    no_line = F.when(F.col("n_lines").isNull(), F.concat(F.lit("cannot read "), "file")).otherwise(
        F.concat("file", F.lit(" has no line "), F.col("line").cast("string"))
    )
    rejected = missing.select("repo", "file", F.col("edit").cast("bigint").alias("edit"), F.lit(False).alias("ok"), no_line.alias("reason"))
    new_text = F.coalesce("done.text", "text")
    texts = folded.groupBy("repo", "file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", new_text.alias("t")))), lambda l: l["t"]), "\n").alias("content")
    )
    return done.unionByName(rejected), texts


def apply_text_edits(edits: DataFrame, files: DataFrame) -> DataFrame:
    """repo, file, content, results: edits named by a quoted text, which must occur exactly once.

    ``edits``: repo, file, edit, find, replace, applied in edit order; each sees the text the earlier ones left.
    """
    wanted = edits.groupBy("repo", "file").agg(F.array_sort(F.collect_list(F.struct("edit", "find", "replace"))).alias("todo"))
    state = F.struct(F.col("content").alias("text"), F.array().cast(OUTCOME).alias("out"))

    def step(acc, e):
        n = occurrences(acc["text"], e["find"])
        at = F.instr(acc["text"], e["find"])
        once = F.overlay(acc["text"], e["replace"], at, F.length(e["find"]))
        why = F.when(n == 0, F.concat(F.lit("text not found in "), "file")).when(
            n > 1, F.concat(F.lit("text appears "), n.cast("string"), F.lit(" times in "), F.col("file"), F.lit("; needs more surrounding context to be unambiguous"))
        )
        result = F.struct(e["edit"].cast("bigint").alias("edit"), (n == 1).alias("ok"), why.alias("reason"))
        return F.struct(F.when(n == 1, once).otherwise(acc["text"]).alias("text"), F.concat(acc["out"], F.array(result)).alias("out"))

    both = files.join(wanted, ["repo", "file"]).withColumn("done", F.aggregate("todo", state, step))
    return both.select("repo", "file", F.col("done.text").alias("content"), F.col("done.out").alias("results"))
