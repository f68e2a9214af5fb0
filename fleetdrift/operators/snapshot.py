"""Diff of two keyed snapshots of a package's public symbols.

``symbols`` tables hold pkg, path, kind, signature, deprecated, doc, type_params; ``surfaces`` hold one
header row per pkg: version, entry, truncated. All joins are on (pkg, path) or (pkg, signature), so one
huge package spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signatures as S
from ..skew import split_hot_join

# Display rank of a severity; anything not listed ranks 9.
SEVERITY_RANK = {"breaking": 0, "deprecation": 1, "feature": 2, "safe": 3}
IMPACTING = ("removed", "deprecated", "signature-changed")
CAPABILITY_KINDS = ("function", "class", "variable", "enum", "unknown")
HEADLINE = ("breaking", "deprecation")
SIDE = ("kind", "signature", "deprecated", "doc", "type_params")


def severity_rank(severity: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, severity), F.lit(9))


def in_headline(severity: Column) -> Column:
    return severity.isin(*HEADLINE)


def suppression_flags(from_surfaces: DataFrame, to_surfaces: DataFrame, from_symbols=None, to_symbols=None) -> DataFrame:
    """Per package: may removals and additions be reported, and why not.

    A truncated or empty side, or a side without declarations, cannot prove that a symbol is gone.
    """

    def side(headers, symbols, tag):
        out = headers.select("pkg", "version", "entry", F.coalesce("truncated", F.lit(False)).alias("truncated"))
        if symbols is None:
            out = out.withColumn("empty", F.lit(False))
        else:
            counts = symbols.groupBy("pkg").agg(F.count(F.lit(1)).alias("n"))
            out = (
                out.join(counts, "pkg", "left")
                .withColumn("empty", F.col("entry").isNotNull() & F.col("n").isNull())
                .drop("n")
            )
        return out.select("pkg", *[F.col(c).alias(f"{tag}_{c}") for c in ("version", "entry", "truncated", "empty")])

    both = side(from_surfaces, from_symbols, "from").join(side(to_surfaces, to_symbols, "to"), "pkg")
    unanalyzable = F.col("from_entry").isNull() | F.col("to_entry").isNull()

    def spelled(tag):
        return F.concat(F.col("pkg"), F.lit("@"), F.col(f"{tag}_version"))

    def note(tag, when, text):
        return F.when(when, F.concat(spelled(tag), F.lit(text)))

    notes = F.array_compact(
        F.array(
            note("from", F.col("from_entry").isNull(), " ships no type declarations"),
            note("to", F.col("to_entry").isNull(), " ships no type declarations"),
            note("to", F.col("to_empty"), " declares types but no symbols could be read from them; removals are not reported"),
            note("from", F.col("from_empty"), " declares types but no symbols could be read from them; additions are not reported"),
            note("to", F.col("to_truncated"), " surface was truncated; removals are not reported"),
            note("from", F.col("from_truncated"), " surface was truncated; additions are not reported"),
        )
    )
    return both.select(
        "pkg",
        "from_version",
        "to_version",
        unanalyzable.alias("unanalyzable"),
        (F.col("to_truncated") | F.col("to_empty") | unanalyzable).alias("hide_removals"),
        (F.col("from_truncated") | F.col("from_empty") | unanalyzable).alias("hide_additions"),
        notes.alias("notes"),
    )


def _sided(symbols: DataFrame, tag: str) -> DataFrame:
    return symbols.select("pkg", "path", *[F.col(c).alias(f"{tag}_{c}") for c in SIDE], F.lit(True).alias(f"in_{tag}"))


def paired(from_symbols: DataFrame, to_symbols: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Symbols of both snapshots side by side, by path.

    A path that only the older snapshot has is looked up once more through the newer snapshot's alias
    spellings (pkg, spelling, canonical); that side join reads only the aliases, not the whole snapshot.
    """
    both = _sided(from_symbols, "from").join(_sided(to_symbols, "to"), ["pkg", "path"], "full_outer")
    both = both.withColumns({f"in_{side}": F.coalesce(f"in_{side}", F.lit(False)) for side in ("from", "to")})
    if aliases is None:
        return both.withColumn("via_alias", F.lit(False))
    target = _sided(to_symbols, "alias").withColumnRenamed("path", "canonical")
    spelled = (
        aliases.select("pkg", F.col("spelling").alias("path"), "canonical").join(target, ["pkg", "canonical"]).drop("canonical")
    )
    use = F.col("in_from") & ~F.col("in_to") & F.coalesce(F.col("in_alias"), F.lit(False))
    return both.join(spelled, ["pkg", "path"], "left").select(
        "pkg",
        "path",
        "in_from",
        "in_to",
        *[f"from_{c}" for c in SIDE],
        *[F.when(use, F.col(f"alias_{c}")).otherwise(F.col(f"to_{c}")).alias(f"to_{c}") for c in SIDE],
        use.alias("via_alias"),
    )


def unique_moves(from_symbols: DataFrame, to_symbols: DataFrame) -> DataFrame:
    """(pkg, signature) -> the one new path that declares it; signatures with several new paths are left out."""
    fresh = to_symbols.filter(S.is_typeof(F.col("signature"))).join(
        from_symbols.select("pkg", "path"), ["pkg", "path"], "left_anti"
    )
    return (
        fresh.groupBy("pkg", "signature")
        .agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("moved_to"))
        .filter("n = 1")
        .drop("n")
    )


def diff_symbols(
    from_symbols: DataFrame,
    to_symbols: DataFrame,
    flags: DataFrame | None = None,
    aliases: DataFrame | None = None,
    agreed_aliases: DataFrame | None = None,
) -> DataFrame:
    """Classified changes: pkg, path, kind, symbol_kind, severity, confidence, before, after, guidance, moved_to.

    One symbol can be both deprecated and changed. Rows of kind ``moved`` are notes, not changes.
    """
    both = paired(from_symbols, to_symbols, aliases)
    if flags is not None:
        both = split_hot_join(both, flags.select("pkg", "unanalyzable", "hide_removals", "hide_additions"), ["pkg"], "left")
    else:
        both = both.select("*", *[F.lit(False).alias(c) for c in ("unanalyzable", "hide_removals", "hide_additions")])
    both = both.filter(~F.coalesce("unanalyzable", F.lit(False)))
    moves = unique_moves(from_symbols, to_symbols)
    both = both.withColumn(
        "move_key",
        F.when(
            F.col("in_from") & ~F.col("in_to") & ~F.col("via_alias") & S.names_own_declaration(F.col("from_signature"), F.col("path")),
            F.col("from_signature"),
        ),
    )
    # nearly every symbol has no move key: its path stands in for it, so that they spread and meet nothing
    spread = F.coalesce("move_key", F.concat(F.lit("\0"), F.col("path")))
    both = both.withColumn("move_key", spread).join(moves.withColumnRenamed("signature", "move_key"), ["pkg", "move_key"], "left")

    before, after = F.col("from_signature"), F.col("to_signature")
    differs = before != after
    if agreed_aliases is not None:
        both = substitute_aliases(both, agreed_aliases)
        plain = S.without_printer_suffixes
        changed = F.when(differs, plain(F.col("from_reduced")) != plain(F.col("to_reduced"))).otherwise(False)
    else:
        changed = F.when(
            differs,
            S.comparable_signature("from_signature", "from_type_params") != S.comparable_signature("to_signature", "to_type_params"),
        ).otherwise(False)
    present = F.col("in_to") | F.col("via_alias")
    # judged here once, then carried as a column: the scans over the text run only where it changed
    both = both.withColumn("reworded", F.col("in_from") & present & changed)
    gone = F.col("in_from") & ~present & ~F.coalesce("hide_removals", F.lit(False))

    def change(when, kind, severity, confidence, old, new, guidance=F.lit(None).cast("string"), moved=F.lit(None).cast("string")):
        return F.when(
            when,
            F.struct(
                F.lit(kind).alias("kind"),
                severity.alias("severity"),
                confidence.alias("confidence"),
                old.cast("string").alias("before"),
                new.cast("string").alias("after"),
                guidance.alias("guidance"),
                moved.alias("moved_to"),
            ),
        )

    none = F.lit(None)
    rows = F.array_compact(
        F.array(
            change(gone & F.col("moved_to").isNull(), "removed", F.lit("breaking"), F.lit("high"), before, none),
            change(gone & F.col("moved_to").isNotNull(), "moved", F.lit("safe"), F.lit("high"), before, before, moved=F.col("moved_to")),
            change(
                F.col("in_from") & present & F.coalesce("to_deprecated", F.lit(False)),
                "deprecated",
                F.lit("deprecation"),
                F.lit("high"),
                before,
                after,
                F.nullif(F.col("to_doc"), F.lit("")),
            ),
            change(F.col("reworded"), "signature-changed", none.cast("string"), none.cast("string"), before, after),
            change(
                ~F.col("in_from") & F.col("in_to") & ~F.coalesce("hide_additions", F.lit(False)),
                "added",
                F.lit("feature"),
                F.lit("high"),
                none,
                after,
            ),
        )
    )
    symbol_kind = F.when(F.col("in_to") & ~F.col("in_from"), F.col("to_kind"))
    out = both.select("pkg", "path", symbol_kind.alias("symbol_kind"), "from_type_params", "to_type_params", F.inline(rows))
    # graded last: a reader of neither severity nor confidence leaves it out
    ladder = F.expr(S.change_class_sql("from_type_params", "to_type_params", "`before`", "`after`"))
    graded = out.withColumn("ladder", F.when(F.col("kind") == "signature-changed", ladder))
    grades = [F.coalesce(F.col(c), F.col(f"ladder.{c}")).alias(c) for c in ("severity", "confidence")]
    return graded.select("pkg", "path", "symbol_kind", "kind", *grades, "before", "after", "guidance", "moved_to")


def consumer_impacting(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("kind").isin(*IMPACTING))


def reading_order(changes: DataFrame) -> DataFrame:
    """Severity, then path depth; path breaks the remaining ties so that the order is total."""
    return changes.select(
        "*", severity_rank(F.col("severity")).alias("rank"), F.size(F.split("path", r"\.")).alias("depth")
    ).orderBy("rank", "depth", "pkg", "path", "kind")


def capability_additions(changes: DataFrame) -> DataFrame:
    """New top-level exports a reader could use; a missing symbol kind counts as unknown."""
    return changes.filter(
        (F.col("kind") == "added")
        & ~F.col("path").contains(".")
        & F.coalesce("symbol_kind", F.lit("unknown")).isin(*CAPABILITY_KINDS)
    )


def agreed_aliases(from_aliases: DataFrame, to_aliases: DataFrame) -> DataFrame:
    """(pkg, name, expansion) of type aliases both versions define alike."""
    a = from_aliases.select("pkg", "name", "expansion")
    b = to_aliases.select("pkg", "name", F.col("expansion").alias("other"))
    reduced = S.without_printer_suffixes
    same = (F.col("expansion") == F.col("other")) | (reduced(F.col("expansion")) == reduced(F.col("other")))
    return a.join(b, ["pkg", "name"]).filter(same).drop("other")


def agreed_defaults(from_defaults: DataFrame, to_defaults: DataFrame) -> DataFrame:
    """(pkg, name) whose type parameter defaults agree on every position both versions have."""
    a = from_defaults.select("pkg", "name", F.col("defaults").alias("ours"))
    b = to_defaults.select("pkg", "name", F.col("defaults").alias("theirs"))
    shared = F.least(F.size("ours"), F.size("theirs"))

    def cut(name):
        return F.transform(F.slice(F.col(name), F.lit(1), shared), S.without_printer_suffixes)

    return a.join(b, ["pkg", "name"]).filter(cut("ours") == cut("theirs")).select("pkg", "name")


def substitute_aliases(both: DataFrame, agreed: DataFrame) -> DataFrame:
    """Adds from_reduced and to_reduced: the comparable texts with agreed aliases expanded.

    Only texts that differ are taken apart. Each word is one row, joined to the aliases by (pkg, word), and
    put together again per symbol, so no package-wide map is ever built.
    """
    differs = F.col("from_signature") != F.col("to_signature")
    texts = both.filter(differs).select(
        "pkg",
        "path",
        F.inline(
            F.array(
                F.struct(F.lit("from").alias("side"), F.expr(S.comparable_sql("from_signature", "from_type_params")).alias("text")),
                F.struct(F.lit("to").alias("side"), F.expr(S.comparable_sql("to_signature", "to_type_params")).alias("text")),
            )
        ),
    )
    words = texts.select(
        "pkg", "path", "side", F.posexplode(F.regexp_extract_all(S.without_printer_suffixes(F.col("text")), F.lit(rf"{S.IDENTIFIER}|[^A-Za-z_$]+"), F.lit(0)))
    )
    expanded = words.join(agreed.withColumnRenamed("name", "col"), ["pkg", "col"], "left").select(
        "pkg", "path", "side", "pos", F.coalesce("expansion", "col").alias("word")
    )
    back = (
        expanded.groupBy("pkg", "path")
        .agg(
            *[
                F.array_join(
                    F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "word")))), lambda x: x["word"]), ""
                ).alias(f"{s}_reduced")
                for s in ("from", "to")
            ]
        )
    )
    return both.join(back, ["pkg", "path"], "left")


def impact_headers(flags: DataFrame) -> DataFrame:
    return flags.select("pkg", "from_version", "to_version", "unanalyzable", F.array_join("notes", "; ").alias("note"))
