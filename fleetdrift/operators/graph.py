"""Dependency paths and what to bump.

Paths are searched backwards from the vulnerable packages, level by level, for all repositories at once. Each
level is one join of the frontier with the edges; a node keeps its first, smallest path, so the state is at
most (vulnerable packages x their ancestors) and no path is walked twice. Each level is written to the shared
work folder, which keeps the plan flat and survives lost executors.

A node with one dependency has no path but the one through it: it is reached once, so only nodes with several
dependencies are compared with what was reached before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Rounds, cut_lineage
from ..skew import split_hot_join


def ancestor_paths(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """repo, child, node, path (node first, child last): one shortest path per ancestor of each target.

    ``edges``: repo, src, dst. ``targets``: repo, child. Of several shortest paths the smallest counts.
    """
    edges = cut_lineage(with_forks(edges), "walked")
    forked = not edges.filter("forks").isEmpty()
    frontier = targets.select("repo", "child").distinct().select(
        "repo", "child", F.col("child").alias("node"), F.array("child").alias("path")
    )
    levels = Rounds(edges.sparkSession, "paths")
    latest = levels.add(frontier)
    while not latest.isEmpty():
        reached = latest.withColumnRenamed("node", "dst").join(edges, ["repo", "dst"]).withColumnsRenamed({"src": "node", "path": "tail"})
        fresh = reached.filter("NOT forks AND node <> child").select("repo", "child", "node", "tail")
        if forked:
            several = reached.filter("forks").groupBy("repo", "child", "node").agg(F.min("tail").alias("tail"))
            fresh = fresh.unionByName(not_yet(several, levels.all().select("repo", "child", "node")))
        latest = levels.add(fresh.select("repo", "child", "node", F.concat(F.array("node"), "tail").alias("path")))
    return levels.all()


def with_forks(edges: DataFrame) -> DataFrame:
    """The distinct edges between different nodes; ``forks``: the source has other dependencies beside this one."""
    distinct = distinct_edges(edges)
    forks = distinct.groupBy("repo", "src").agg((F.min("dst") != F.max("dst")).alias("forks"))
    return split_hot_join(distinct, forks, ["repo", "src"]).select("repo", "src", "dst", "forks")


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("repo", "src", "dst").filter("src <> dst").distinct()


def not_yet(reached: DataFrame, visited: DataFrame) -> DataFrame:
    """What is reached for the first time. Only the visited nodes that are reached again matter, and finding those
    is a semi-join Spark broadcasts while a level is small, so the visited set itself is not shuffled."""
    key = ["repo", "child", "node"]
    return reached.join(visited.join(reached.select(*key), key, "left_semi"), key, "left_anti")


def paths_to(edges: DataFrame, targets: DataFrame, directs: DataFrame) -> DataFrame:
    """repo, child, direct, path, depth: the shortest route from each direct dependency that reaches the target.

    A direct dependency that is itself the target is a route of one node. Edges from packages that are neither
    declared nor needed by another begin no route and lie on none, so they are not walked.
    """
    named = directs.select("repo", F.col("name").alias("direct")).distinct()
    edges = cut_lineage(distinct_edges(edges), "edges")
    held = edges.select("repo", F.col("dst").alias("src")).unionByName(named.withColumnRenamed("direct", "src")).distinct()
    used = split_hot_join(edges, held, ["repo", "src"], "left_semi")
    found = ancestor_paths(used, targets).withColumnRenamed("node", "direct")
    return found.join(named, ["repo", "direct"], "left_semi").select(
        "repo", "child", "direct", "path", (F.size("path") - 1).alias("depth")
    )


def plan_remediation(vulnerable: DataFrame, directs: DataFrame, paths: DataFrame) -> DataFrame:
    """repo, name, target, kind (none, direct, parent), n_parents, first_parent, reason.

    ``vulnerable``: repo, name, target (NULL without a fix). The parents themselves are the rows of ``paths``.
    """
    own = directs.select("repo", "name").distinct().withColumn("is_direct", F.lit(True))
    routes = paths.groupBy("repo", F.col("child").alias("name")).agg(
        F.count(F.lit(1)).alias("n_parents"), F.min("direct").alias("first_parent")
    )
    out = vulnerable.join(own, ["repo", "name"], "left").join(routes, ["repo", "name"], "left")
    no_fix, direct = F.col("target").isNull(), F.coalesce("is_direct", F.lit(False))
    unreached = F.coalesce("n_parents", F.lit(0)) == 0
    kind = F.when(no_fix, "none").when(direct, "direct").when(unreached, "none").otherwise("parent")
    reason = F.when(no_fix, F.concat("name", F.lit(" has no published fix"))).when(
        ~direct & unreached,
        F.concat(F.lit("no direct dependency's tree reaches "), "name", F.lit(", so nothing can be bumped to move it")),
    )
    is_parent = kind == "parent"
    return out.select(
        "repo",
        "name",
        "target",
        kind.alias("kind"),
        F.when(is_parent, F.col("n_parents")).otherwise(0).cast("bigint").alias("n_parents"),
        F.when(is_parent, F.col("first_parent")).alias("first_parent"),
        reason.alias("reason"),
    )


def plan_overrides(wanted: DataFrame, overrides: DataFrame) -> DataFrame:
    """Versions to force in a manifest, unless it already forces them. ``wanted``: repo, name, version."""
    stated = overrides.select("repo", "name", F.col("version").alias("stated"))
    reason = F.concat(F.lit("force "), "name", F.lit(" to "), "version", F.lit(", which no dependency's own range selects"))
    return (
        wanted.join(stated, ["repo", "name"], "left")
        .filter(~F.col("version").eqNullSafe(F.col("stated")))
        .select("repo", "name", "version", "stated", reason.alias("reason"))
    )
