"""What replaced a removed symbol.

Candidates are counted per key before they meet the removed symbols, or found through exploded name parts; a
container with a hundred thousand members is never compared with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import last_segment, loose_signature, parent_path
from ..functions.text import let

EXACT, LOOSE = 100, 80


def find_renames(removed: DataFrame, to_symbols: DataFrame) -> DataFrame:
    """pkg, path, renamed_to, score: the one symbol of the same container that carries the removed signature.

    An exact signature beats one that differs only in case, blanks, ``$`` and ``_``. Two candidates at the best
    score are no answer. ``removed``: pkg, path, before. Deprecated symbols are no candidates.
    """
    fresh = to_symbols.filter(~F.col("deprecated")).join(removed.select("pkg", "path"), ["pkg", "path"], "left_anti")
    keyed = fresh.select(
        "pkg", parent_path(F.col("path")).alias("parent"), "path", "signature", loose_signature(F.col("signature")).alias("loose")
    )

    def only_one(key, tag):
        return keyed.groupBy("pkg", "parent", key).agg(F.count(F.lit(1)).alias(f"{tag}_n"), F.min("path").alias(f"{tag}_path"))

    old = removed.select(
        "pkg", "path", parent_path(F.col("path")).alias("parent"), F.col("before").alias("signature"), loose_signature(F.col("before")).alias("loose")
    )
    both = old.join(only_one("signature", "exact"), ["pkg", "parent", "signature"], "left").join(
        only_one("loose", "near"), ["pkg", "parent", "loose"], "left"
    )
    exact, near = F.col("exact_n") == 1, F.col("exact_n").isNull() & (F.col("near_n") == 1)
    return both.select(
        "pkg",
        "path",
        F.when(exact, F.col("exact_path")).when(near, F.col("near_path")).alias("renamed_to"),
        F.when(exact, EXACT).when(near, LOOSE).alias("score"),
    ).filter("renamed_to IS NOT NULL")


def rename_edits(renames: DataFrame, sites: DataFrame, headers: DataFrame) -> DataFrame:
    """One edit per site that reaches the symbol through a type; sites of imported names need other repairs."""
    reason = F.concat(
        "symbol", F.lit(" was removed in "), "to_version", F.lit("; "), "renamed_to", F.lit(" has the equivalent signature")
    )
    return (
        sites.filter("via = 'type'")
        .join(renames.withColumnRenamed("path", "symbol"), ["pkg", "symbol"])
        .join(headers.select("pkg", "to_version"), "pkg")
        .select(
            "repo",
            "file",
            "line",
            "col",
            last_segment(F.col("symbol")).alias("find"),
            last_segment(F.col("renamed_to")).alias("replace"),
            reason.alias("reason"),
            "pkg",
            "symbol",
            "score",
        )
    )


def words(name: Column) -> Column:
    """Lower-case words of a name, cut at capitals and separators."""
    parts = F.split(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "_"), r"[._\-\s]")
    return F.transform(F.filter(parts, lambda w: w != ""), F.lower)


def inserts_into(shorter: Column, longer: Column) -> Column:
    """The words of ``shorter``, two at least, stand in ``longer`` in the same order."""

    def step(i, word):
        return F.when(word == F.get(shorter, i), i + 1).otherwise(i)

    return (F.size(shorter) >= 2) & (F.aggregate(longer, F.lit(0), step) == F.size(shorter))


def suggestion_score(changed: Column, candidate: Column) -> Column:
    """0 same name here, 1 same name elsewhere, 2 contains it, 3 is contained, 4 adds words, 5 merely a sibling."""
    leaf, name = F.lower(last_segment(changed)), F.lower(last_segment(candidate))
    sibling = parent_path(changed) == parent_path(candidate)
    return (
        F.when((name == leaf) & sibling, 0)
        .when(name == leaf, 1)
        .when(name.contains(leaf), 2)
        .when(leaf.contains(name), 3)
        .when(inserts_into(words(last_segment(changed)), words(last_segment(candidate))), 4)
        .otherwise(5)
    )


def _parts_of(name: Column) -> Column:
    """All distinct substrings of a name."""
    n = F.length(name)
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), n),
                lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(name, i, k)),
            )
        )
    )


def _word_pairs(name: Column) -> Column:
    """``first>later`` for every ordered pair of words."""

    def pairs(ws):
        return F.array_distinct(
            F.flatten(
                F.transform(
                    ws,
                    lambda w, i: F.transform(
                        F.slice(ws, i + 2, F.greatest(F.size(ws) - i - 1, F.lit(0))), lambda x: F.concat(w, F.lit(">"), x)
                    ),
                )
            )
        )

    return let(words(name), pairs)


def related_symbols(changed: DataFrame, to_symbols: DataFrame) -> DataFrame:
    """pkg, path, candidate, score for every candidate related by name (scores 0 to 4).

    Same names join on the name; a name inside another joins on one of its substrings; added words join on the
    first and last word. The remaining siblings (score 5) are the other members of the container and need no
    pairs: see ``top_suggestions``. ``changed``: pkg, path.
    """
    pool = to_symbols.filter(~F.col("deprecated")).select(
        "pkg", F.col("path").alias("candidate"), parent_path(F.col("path")).alias("parent"), F.lower(last_segment(F.col("path"))).alias("name")
    )
    asked = changed.select("pkg", "path").distinct().select(
        "pkg", "path", parent_path(F.col("path")).alias("parent"), F.lower(last_segment(F.col("path"))).alias("leaf")
    )
    out = ["pkg", "path", "candidate"]
    # names are taken apart only in containers that lost or changed something
    near = pool.join(asked.select("pkg", "parent").distinct(), ["pkg", "parent"], "left_semi")
    same = asked.join(pool.select("pkg", "candidate", F.col("name").alias("leaf")), ["pkg", "leaf"]).select(*out)
    key = ["pkg", "parent", "part"]
    inside = (
        asked.withColumn("part", F.col("leaf"))
        .join(near.select("pkg", "parent", "candidate", F.explode(_parts_of(F.col("name"))).alias("part")), key)
        .select(*out)
    )
    around = (
        asked.select("pkg", "path", "parent", F.explode(_parts_of(F.col("leaf"))).alias("part"))
        .join(near.withColumn("part", F.col("name")), key)
        .select(*out)
    )
    ends = let(words(last_segment(F.col("path"))), lambda w: F.when(F.size(w) >= 2, F.concat(F.get(w, 0), F.lit(">"), F.element_at(w, -1))))
    added = (
        asked.withColumn("part", ends)
        .join(near.select("pkg", "parent", "candidate", F.explode(_word_pairs(last_segment(F.col("candidate")))).alias("part")), key)
        .select(*out)
    )
    pairs = same.unionByName(inside).unionByName(around).unionByName(added).distinct()
    return pairs.withColumn("score", suggestion_score(F.col("path"), F.col("candidate"))).filter("score < 5")


def top_suggestions(changed: DataFrame, to_symbols: DataFrame, k: int) -> DataFrame:
    """The best ``k`` suggestions per changed symbol, with rank.

    Of the plain siblings only the first ``k`` names of a container can reach a list of ``k``, so only those are
    joined; the result is the same as ranking all of them.
    """
    related = related_symbols(changed, to_symbols)
    pool = to_symbols.filter(~F.col("deprecated")).select("pkg", F.col("path").alias("candidate"), parent_path(F.col("path")).alias("parent"))
    by_name = Window.partitionBy("pkg", "parent").orderBy("candidate")
    first = pool.withColumn("n", F.row_number().over(by_name)).filter(F.col("n") <= k).drop("n")
    siblings = (
        changed.select("pkg", "path", parent_path(F.col("path")).alias("parent")).distinct().join(first, ["pkg", "parent"]).select("pkg", "path", "candidate")
    )
    plain = siblings.join(related, ["pkg", "path", "candidate"], "left_anti").withColumn("score", F.lit(5))
    best = Window.partitionBy("pkg", "path").orderBy("score", "candidate")
    return related.unionByName(plain).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
