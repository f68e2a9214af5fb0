"""requirements.txt texts and the tree of files they include."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import canonical_name
from ..functions.text import BLANKS, firsts, let, strip
from ..functions.versions import pinned_by_specifier
from ..session import Rounds, cut_lineage

REQUIREMENT = r"(?s)^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(.*)$"
EDGES_INSIDE = 2_000  # of one repository's include edges in a row
OPTION = rf"(?:^|\n)[{BLANKS}]*-"
INCLUDE = r"^(?:(--requirement|-r)|(--constraint|-c))(?:\s*=\s*|\s+)?(\S+)"


def requirement_name(line: Column) -> Column:
    text = strip(F.get(F.split(line, "#"), 0))
    return F.when(~text.startswith("-"), F.nullif(F.regexp_extract(text, REQUIREMENT, 1), F.lit("")))


def _lines(content: Column) -> Column:
    """Array of (pos, text) of logical lines: continuations joined, comments cut, blank lines left out."""
    lines = F.split(F.regexp_replace(content, r"\\\r?\n", " "), "\n")
    read = F.transform(lines, lambda l, i: F.struct(i.alias("pos"), strip(F.get(F.split(l, "#"), 0)).alias("text")))
    return F.filter(read, lambda e: e["text"] != "")


def requirement_lines(files: DataFrame) -> DataFrame:
    """repo, file, pos, text of logical lines: continuations joined, comments cut, blank lines left out."""
    return files.select("repo", "file", F.inline(_lines(F.col("content"))))


def first_requirements(content: Column) -> Column:
    """Array of (name, pos, specifier): the first line of each name in a text, which is settled inside its row."""

    def read(line):
        before_options = F.regexp_replace(line["text"], r"(?s)\s+-.*$", "")
        bare = strip(F.get(F.split(F.regexp_replace(before_options, r"\s+", " "), ";"), 0))
        return let(bare, lambda b: F.struct(F.regexp_extract(b, REQUIREMENT, 1).alias("name"), line["pos"].alias("pos"), strip(F.regexp_extract(b, REQUIREMENT, 2)).alias("specifier")))

    lines = F.filter(_lines(content), lambda l: ~l["text"].startswith("-"))
    return firsts(F.filter(F.transform(lines, read), lambda r: r["name"] != ""), "name")


def _with_versions(first: DataFrame, *columns: str) -> DataFrame:
    version = pinned_by_specifier(F.col("specifier"))
    return first.select(*columns, "pos", "name", version.alias("version"), F.when(version.isNull(), F.col("specifier")).alias("declared"))


def requirements(files: DataFrame) -> DataFrame:
    """repo, file, pos, name, version (pinned) or declared (a range); the first line of a name counts. One file is one row."""
    first = files.select("repo", "file", F.inline_outer(first_requirements(F.col("content")))).filter("name IS NOT NULL")
    return _with_versions(first, "repo", "file")


def included(content: Column) -> Column:
    """Array of (pos, kind, target) of a text's include lines; a text without any option line is not taken apart."""
    options = F.filter(_lines(content), lambda l: l["text"].startswith("-"))

    def read(line):
        kind = F.when(F.regexp_extract(line["text"], INCLUDE, 1) != "", "requirements").otherwise("constraints")
        return F.struct(line["pos"].alias("pos"), kind.alias("kind"), F.regexp_extract(line["text"], INCLUDE, 3).alias("target"))

    return F.when(content.rlike(OPTION), F.filter(F.transform(options, read), lambda i: i["target"] != ""))


def includes(files: DataFrame) -> DataFrame:
    """repo, file, pos, kind (requirements or constraints), target."""
    return files.select("repo", "file", F.inline_outer(included(F.col("content")))).filter("target IS NOT NULL")


def resolve_target(file: Column, target: Column) -> Column:
    """Target path relative to the including file's folder; ``.`` and ``..`` folded; NULL outside the repository."""
    folder = F.regexp_extract(file, "^(.*/)?[^/]*$", 1)
    state = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(acc, part):
        up = part == ".."
        empty = F.size(acc["parts"]) == 0
        return F.struct(
            F.when(up, F.slice(acc["parts"], F.lit(1), F.greatest(F.size(acc["parts"]) - 1, F.lit(0))))
            .when(part.isin("", "."), acc["parts"])
            .otherwise(F.concat(acc["parts"], F.array(part)))
            .alias("parts"),
            (acc["out"] | (up & empty)).alias("out"),
        )

    path = F.concat(folder, target)
    folded = let(
        F.aggregate(F.split(path, "/"), state, step), lambda walked: F.when(~walked["out"], F.array_join(walked["parts"], "/"))
    )
    # most paths hold no part to fold
    return F.when(~target.startswith("/"), F.when(path.rlike(r"(^|/)\.{0,2}(/|$)"), folded).otherwise(path))


def targets(file: Column, content: Column) -> Column:
    """Array of the files a text includes, by their paths in the repository; those outside of it are left out."""
    return F.array_compact(F.transform(included(content), lambda i: resolve_target(file, i["target"])))


def _walk(root: str):
    """The first visits of a depth-first walk over one repository's include edges: [(file, walk, as_constraints)]."""

    def walk(parents, positions, children, constrains):
        edges = {}
        for parent, position, child, constraint in sorted(zip(parents or (), positions or (), children or (), constrains or ())):
            edges.setdefault(parent, []).append((position, child, constraint))
        out, seen = [(root, [], False)], {root}
        stack = [(out[0], iter(edges.get(root, ())))]
        while stack:
            (_, path, limits), rest = stack[-1]
            for position, child, constraint in rest:
                if child not in seen:
                    seen.add(child)
                    out.append((child, [*path, position], limits or constraint))
                    stack.append((out[-1], iter(edges.get(child, ()))))
                    break
            else:
                stack.pop()
        return out

    return F.udf(walk, "array<struct<file:string,walk:array<int>,as_constraints:boolean>>", useArrow=False)


def include_tree(files: DataFrame, root: str = "requirements.txt", inside: int = EDGES_INSIDE) -> DataFrame:
    """repo, file, walk (include positions from the root), as_constraints: each file at its first visit.

    A repository's include edges are one short list, which is walked inside its row. Repositories with more than
    ``inside`` of them are walked in rounds of joins, so that none is whole in one task.
    """
    edges = (
        includes(files)
        .withColumn("child", resolve_target(F.col("file"), F.col("target")))
        .join(files.select("repo", F.col("file").alias("child")), ["repo", "child"], "left_semi")
        .select("repo", "file", F.col("pos").cast("int").alias("pos"), "child", (F.col("kind") == "constraints").alias("constrains"))
    )
    edges = cut_lineage(edges, "include-edges")
    roots = files.filter(F.col("file") == root).select("repo").distinct()
    large = edges.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > inside).select("repo")
    any_large = not large.isEmpty()
    small_edges, small_roots = (x.join(large, "repo", "left_anti") if any_large else x for x in (edges, roots))
    lists = small_edges.groupBy("repo").agg(F.collect_list(F.struct("file", "pos", "child", "constrains")).alias("e"))
    walked = small_roots.join(lists, "repo", "left").select(
        "repo", F.inline(_walk(root)(*[F.col("e")[c] for c in ("file", "pos", "child", "constrains")]))
    )
    if not any_large:
        return walked
    large = cut_lineage(large, "include-large")
    return walked.unionByName(_walk_in_rounds(*(x.join(large, "repo", "left_semi") for x in (edges, roots)), root))


def _walk_in_rounds(edges: DataFrame, roots: DataFrame, root: str) -> DataFrame:
    """Depth-first order with every file visited once is the order of the smallest position path to each file,
    so paths are relaxed until none improves. Each round is one join of the improved files with the include
    edges, and is written out so that the plan stays small.
    """
    key = ["repo", "file"]
    start = roots.select("repo", F.lit(root).alias("file"), F.array().cast("array<int>").alias("walk"), F.lit(False).alias("as_constraints"))
    walks = Rounds(edges.sparkSession, "include-walks")
    improved = walks.add(start)
    while not improved.isEmpty():
        reached = improved.join(edges, key).select(
            "repo",
            F.col("child").alias("file"),
            F.concat("walk", F.array("pos")).alias("walk"),
            (F.col("as_constraints") | F.col("constrains")).alias("as_constraints"),
        )
        reached = reached.groupBy(*key).agg(F.min(F.struct("walk", "as_constraints")).alias("n"))
        # only the known walks to files that are reached again are compared, and only better ones are written
        so_far = walks.all().join(reached.select(*key), key, "left_semi").groupBy(*key).agg(F.min("walk").alias("walk"))
        better = reached.join(so_far, key, "left").filter(F.col("walk").isNull() | (F.col("n.walk") < F.col("walk")))
        improved = walks.add(better.select(*key, "n.walk", "n.as_constraints"))
    return walks.all().groupBy(*key).agg(F.min(F.struct("walk", "as_constraints")).alias("n")).select(*key, "n.walk", "n.as_constraints")


def requirements_tree(files: DataFrame, root: str = "requirements.txt") -> DataFrame:
    """repo, name, version, declared, source over a whole include tree.

    Names compare in canonical form and the first in reading order counts; constraints fill only what the
    requirements leave open.
    """
    walks = include_tree(files, root)
    read = files.select("repo", "file", first_requirements(F.col("content")).alias("first"))
    found = read.join(walks, ["repo", "file"]).select("repo", "file", "walk", "as_constraints", F.inline_outer("first"))
    rows = _with_versions(found.filter("name IS NOT NULL"), "repo", "file", "walk", "as_constraints").withColumn("canonical", canonical_name(F.col("name")))
    own, limits = ~F.col("as_constraints"), F.col("as_constraints") & F.col("version").isNotNull()
    # a file's own lines come before those of the files it includes, in both orders
    order = F.struct(F.col("walk"), F.col("version").isNull(), F.col("pos"))
    merged = rows.groupBy("repo", "canonical").agg(
        F.min_by(F.struct("name", "version", "declared", "file"), F.when(own, order)).alias("r"),
        F.min_by("version", F.when(limits, F.struct("walk", "pos"))).alias("constraint"),
    )
    filled = F.coalesce("r.version", "constraint")
    return merged.filter("r IS NOT NULL").select(
        "repo", "r.name", filled.alias("version"), F.when(filled.isNull(), F.col("r.declared")).alias("declared"), "r.file"
    )
