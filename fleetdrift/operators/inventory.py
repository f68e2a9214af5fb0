"""What a repository depends on: targets, resolution status, merged declarations, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versions as V

# Where an installed version may come from, most trusted first.
SOURCES = ("node_modules", "lockfile", "pinned", "range", "none")
TRUSTED_SOURCES = ("node_modules", "lockfile")

# The tiers a language needs for a full scan, with label and reason when missing.
TIERS = {
    "inventory": ("dependency inventory", "no adapter reads this ecosystem's dependency tree"),
    "registry": ("registry lookups", "no client resolves its package versions"),
    "surface": ("API surface extraction", "no extractor reads a package's public API"),
    "callSites": ("call-site search", "no resolver searches source for its call sites"),
}


def highest_stable(published: DataFrame) -> DataFrame:
    """Per (name, ecosystem) the highest version that is no prerelease. ``published``: name, ecosystem, version."""
    eco, version = F.col("ecosystem"), F.col("version")
    stable = ~V.is_prerelease(eco, version)
    return published.groupBy("name", "ecosystem").agg(
        F.max_by(version, F.when(stable, F.struct(V.version_key(eco, version), version))).alias("highest")
    )


def target_versions(tags: DataFrame, published: DataFrame) -> DataFrame:
    """name, ecosystem, target: the latest tag where it is published, else the highest stable version, else NULL."""
    tagged = tags.select("name", "ecosystem", F.col("latest").alias("version"))
    listed = published.select("name", "ecosystem", "version").distinct().join(tagged, ["name", "ecosystem", "version"], "left_semi")
    return (
        highest_stable(published)
        .join(listed.withColumnRenamed("version", "listed"), ["name", "ecosystem"], "left")
        .select("name", "ecosystem", F.coalesce("listed", "highest").alias("target"))
    )


def resolve_ranges(ranges: DataFrame, published: DataFrame, tags: DataFrame) -> DataFrame:
    """The best published version inside each npm range, else its floor where published, else the latest.

    Works per distinct (name, declared): the same range in a million manifests is resolved once. A caret or tilde
    range is a bucket (a major version, or a major and minor one) with a floor, so the highest version of the
    bucket answers it or nothing does; ranges never meet single versions.
    """
    known = published.select("name", "version").distinct()
    npm = known.withColumn("ecosystem", F.lit("npm"))
    latest = target_versions(tags.withColumn("ecosystem", F.lit("npm")), npm).select("name", F.col("target").alias("latest_target"))
    wanted = ranges.select("name", "declared").distinct().withColumn("parts", V.range_parts(F.col("declared")))
    stable = known.filter(~V.semver_is_prerelease(F.col("version"))).select(
        "name", "version", V.semver_key(F.col("version")).alias("key"), *V.major_minor(F.col("version"))
    )
    top = F.max(F.struct("key", "version")).alias("top")
    by_minor = stable.groupBy("name", "major", "minor").agg(top)
    by_major = stable.groupBy("name", "major").agg(top)
    ranged = wanted.filter(F.col("parts.op").isin("^", "~") & ~V.takes_latest(F.col("declared"))).select(
        "name", "declared", "parts.op", "parts.major", "parts.minor", V.semver_key(F.col("parts.floor")).alias("floor_key")
    )
    wide = (F.col("op") == "^") & (F.col("major") > 0)
    exact = (F.col("op") == "^") & (F.col("major") == 0) & (F.col("minor") == 0)
    answers = ranged.filter(wide).join(by_major, ["name", "major"]).select("name", "declared", "floor_key", "top").unionByName(
        ranged.filter(~wide & ~exact).join(by_minor, ["name", "major", "minor"]).select("name", "declared", "floor_key", "top")
    )
    best = answers.filter(F.col("top.key") >= F.col("floor_key")).select("name", "declared", F.col("top.version").alias("best"))
    floors = (
        wanted.filter(~V.takes_latest(F.col("declared")))
        .select("name", "declared", F.col("parts.floor").alias("version"))
        .join(known, ["name", "version"], "left_semi")
        .withColumnRenamed("version", "floor")
    )
    has_stable = stable.select("name").distinct().withColumn("any_stable", F.lit(True))
    resolved = (
        wanted.join(best, ["name", "declared"], "left")
        .join(floors, ["name", "declared"], "left")
        .join(latest, "name", "left")
        .join(has_stable, "name", "left")
        .select("name", "declared", F.when(F.col("any_stable"), F.coalesce("best", "floor", "latest_target")).alias("resolved"))
    )
    return ranges.join(resolved, ["name", "declared"], "left")


def eligible(dependencies: DataFrame, include_dev: bool = True, only: DataFrame | None = None) -> DataFrame:
    """Dependencies with an installed version; optionally runtime only, optionally a named list."""
    out = dependencies.filter(F.col("installed").isNotNull())
    if not include_dev:
        out = out.filter(~F.col("dev"))
    return out if only is None else out.join(only.select("name").distinct(), "name", "left_semi")


def resolution_status(dependencies: DataFrame, targets: DataFrame, pinned: DataFrame, published: DataFrame, registries: tuple[str, ...], extractors: tuple[str, ...]) -> DataFrame:
    """Adds to_version, status and note: one ordered ladder, every dependency keeps its row.

    ``targets``: name, ecosystem, target. ``pinned``: repo, name, pin (a target the user asked for).
    """
    eco = F.col("ecosystem")
    out = (
        dependencies.join(targets, ["name", "ecosystem"], "left")
        .join(pinned.select("repo", "name", "pin"), ["repo", "name"], "left")
        .join(
            published.select("name", "ecosystem", F.col("version").alias("pin"), F.lit(True).alias("pin_published")).distinct(),
            ["name", "ecosystem", "pin"],
            "left",
        )
    )
    to = F.coalesce("pin", "target")
    no_install = F.col("installed").isNull()
    no_client = ~eco.isin(*registries)
    bad_pin = F.col("pin").isNotNull() & F.col("pin_published").isNull()
    current = V.is_up_to_date(eco, F.col("installed"), to)
    ladder: list[tuple[Column, str, Column]] = [
        (no_install, "error", F.lit("no installed version could be resolved")),
        (no_client, "error", F.concat(F.lit("no registry client claims ecosystem '"), eco, F.lit("'"))),
        (bad_pin, "error", F.concat(F.lit("target "), F.col("pin"), F.lit(" was requested but the registry does not publish it"))),
        (to.isNull(), "error", F.lit("registry published no resolvable latest version")),
        (current, "up-to-date", F.concat(F.lit("installed "), F.col("installed"), F.lit(" is at or ahead of latest "), to)),
        (~eco.isin(*extractors), "unanalyzable", F.lit("no surface extractor recognises this ecosystem")),
    ]
    status, note = F, F
    for when, label, text in ladder:
        status, note = status.when(when, label), note.when(when, text)
    to_shown = F.when(no_install | no_client | bad_pin, F.lit(None)).otherwise(to)
    return out.select(
        *dependencies.columns, to_shown.alias("to_version"), status.otherwise("analyzed").alias("status"), note.otherwise(None).alias("note")
    )


def within_budget(rows: DataFrame, group: list[str], order: list[str], budget: int) -> DataFrame:
    """All rows, and whether each is among the first ``budget`` of its group: the limit the user set on one scan."""
    first = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("within", F.row_number().over(first) <= budget)


def over_budget(rows: DataFrame, group: list[str], budget: int) -> DataFrame:
    """How many rows of each group the budget leaves unchecked; counted, never silently dropped."""
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_present"),
        F.greatest(F.count(F.lit(1)) - F.lit(budget), F.lit(0)).alias("n_unchecked"),
    )


def merge_declarations(declared: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row per (repo, name) over all workspaces.

    ``declared``: repo, workspace, seq (declaration order), name, declared, dev. ``resolved``: repo, name,
    node_modules, locked. Runtime use in any workspace makes a dependency a runtime one; the first
    declaration counts; the installed version comes from the most trusted source that has one.
    """
    merged = declared.groupBy("repo", "name").agg(
        F.countDistinct("workspace").alias("n_workspaces"),
        F.bool_and("dev").alias("dev"),
        F.min_by("declared", "seq").alias("declared"),
    )
    joined = merged.join(resolved, ["repo", "name"], "left")
    pin = V.exact_pin(F.col("declared"))
    guess = V.first_version_in(F.col("declared"))
    choices = [F.col("node_modules"), F.col("locked"), pin, guess]
    source = F
    for choice, label in zip(choices, SOURCES):
        source = source.when(choice.isNotNull(), label)
    return joined.select(
        "repo", "name", "declared", "dev", "n_workspaces", F.coalesce(*choices).alias("installed"), source.otherwise(SOURCES[-1]).alias("source")
    )


def declaring_workspaces(declared: DataFrame) -> DataFrame:
    """repo, name, workspace: where each dependency is declared, one row each."""
    return declared.select("repo", "name", "workspace").distinct()


def trusted_versions(dependencies: DataFrame) -> DataFrame:
    """Versions confirmed by resolution; a declared pin or range arbitrates nothing."""
    return dependencies.filter(F.col("installed").isNotNull() & F.col("source").isin(*TRUSTED_SOURCES))


def distinct_packages(entries: DataFrame) -> DataFrame:
    return entries.select("repo", "name", "version").distinct()


def completeness(repos: DataFrame, declared: DataFrame, lockfiles: DataFrame) -> DataFrame:
    """Per repository: ``incomplete`` (declares, but has no lockfile), ``unsupported`` (unreadable lockfile), ``complete``.

    ``lockfiles``: repo, readable.
    """
    counts = declared.groupBy("repo").agg(F.count(F.lit(1)).alias("n_declared"))
    locks = lockfiles.groupBy("repo").agg(F.bool_or("readable").alias("readable"))
    n = F.coalesce("n_declared", F.lit(0))
    state = (
        F.when(F.col("readable"), "complete")
        .when(F.col("readable").isNotNull(), "unsupported")
        .when(n > 0, "incomplete")
        .otherwise("complete")
    )
    return repos.join(counts, "repo", "left").join(locks, "repo", "left").select("repo", n.alias("n_declared"), state.alias("state"))


def best_file(files: DataFrame, precedence: tuple[str, ...]) -> DataFrame:
    """The file of highest precedence per repository, readable or not: an unreadable one is reported, not passed over.

    ``files``: repo, file, readable.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in precedence]), F.col("file"))
    return (
        files.filter(rank > 0)
        .groupBy("repo")
        .agg(F.min_by(F.struct("file", "readable"), rank).alias("best"))
        .select("repo", "best.file", F.when(F.col("best.readable"), "read").otherwise("unsupported").alias("status"))
    )


def claiming_ecosystems(claims: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The first ecosystem that claims a repository, and the others by name. ``claims``: repo, ecosystem."""
    rank = F.array_position(F.array(*[F.lit(e) for e in order]), F.col("ecosystem"))
    listed = F.array_sort(F.collect_set(F.struct(rank.alias("rank"), F.col("ecosystem"))))
    return claims.filter(rank > 0).groupBy("repo").agg(listed.alias("all")).select(
        "repo",
        F.get("all", 0)["ecosystem"].alias("first"),
        F.transform(F.slice("all", F.lit(2), F.size("all")), lambda e: e["ecosystem"]).alias("skipped"),
    )


def coverage_list(analysed: Column, claimed: Column) -> Column:
    """Analysed ecosystem first, then the claimed ones not named yet."""
    return F.array_union(F.when(analysed.isNull(), F.array().cast("array<string>")).otherwise(F.array(analysed)), claimed)


def describe_coverage(ecosystems: DataFrame, capabilities: DataFrame) -> DataFrame:
    """ecosystem, n_analysed and text. ``capabilities``: ecosystem, tier, one row per tier that exists.

    The expected tiers are a fixed list, so what is missing is an array difference, not a product.
    """
    have = capabilities.groupBy("ecosystem").agg(F.collect_set("tier").alias("have"))
    names = F.array(*[F.lit(tier) for tier in TIERS])
    label = F.create_map(*[F.lit(x) for tier, (text, _) in TIERS.items() for x in (tier, text)])
    reason = F.create_map(*[F.lit(x) for tier, (_, text) in TIERS.items() for x in (tier, text)])
    missing = F.filter(names, lambda tier: ~F.array_contains(F.coalesce("have", F.array().cast("array<string>")), tier))
    gaps = F.array_join(
        F.transform(missing, lambda tier: F.concat(label[tier], F.lit(" not examined ("), reason[tier], F.lit(")"))), ", "
    )
    ran = F.lit(", ".join(text for text, _ in TIERS.values()))
    text = (
        F.when(F.size(missing) > 0, F.concat(F.col("ecosystem"), F.lit(": "), gaps, F.lit(".")))
        .when(F.col("n_analysed") == 0, F.concat(F.col("ecosystem"), F.lit(": no dependencies were analysed.")))
        .otherwise(
            F.concat(
                F.col("ecosystem"), F.lit(": examined "), F.col("n_analysed").cast("string"), F.lit(" package(s) — "), ran, F.lit(" all ran.")
            )
        )
    )
    return ecosystems.join(have, "ecosystem", "left").select("ecosystem", "n_analysed", text.alias("text"))
