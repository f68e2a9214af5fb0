"""From symbol changes to the lines that use them.

Findings and their sites are two tables joined by finding id. A finding used by a third of the fleet is
then many site rows, never one giant array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.paths import dotted_prefixes
from ..session import cut_lineage
from ..skew import split_hot_join

SITE = ("repo", "pkg", "symbol", "file", "line", "col", "via")
OWN_IMPORT = "struct<name:string,pkg:string,symbol:string>"


def distinct_sites(sites: DataFrame) -> DataFrame:
    """One row per (repo, pkg, symbol, file, line, col); an import wins over a type reference."""
    return sites.groupBy("repo", "pkg", "symbol", "file", "line", "col").agg(F.min("via").alias("via"))


def wanted_sites(sites: DataFrame, changes: DataFrame) -> DataFrame:
    """Sites of symbols that changed. Applied before sites are made distinct: most call sites use symbols that did
    not change, and need no shuffle then. ``changes``: pkg, path."""
    wanted = changes.select("pkg", F.col("path").alias("symbol")).distinct()
    return split_hot_join(sites, wanted, ["pkg", "symbol"], "left_semi")


def site_counts(sites: DataFrame) -> DataFrame:
    return sites.groupBy("repo", "pkg", "symbol").agg(F.count(F.lit(1)).alias("n_sites"))


def locate_changes(changes: DataFrame, sites: DataFrame) -> DataFrame:
    """Findings: every change a repository uses, with the number of its sites.

    Sites are counted per symbol before the join, so the shuffle carries one row per (repo, pkg, symbol).
    """
    wanted = changes.withColumnRenamed("path", "symbol")
    return split_hot_join(site_counts(sites), wanted, ["pkg", "symbol"])


def with_surface_ids(findings: DataFrame, headers: DataFrame) -> DataFrame:
    """Adds versions and the content id. ``headers``: pkg, from_version, to_version."""
    return findings.join(headers.select("pkg", "from_version", "to_version"), "pkg", "left").withColumn(
        "finding_id", ids.surface_id(F.col("pkg"), F.col("from_version"), F.col("to_version"), F.col("symbol"), F.col("kind"))
    )


def finding_sites(findings: DataFrame, sites: DataFrame) -> DataFrame:
    """The child table: one row per finding and site, with the finding's kind, so that no reader joins them again."""
    keys = ["repo", "pkg", "symbol"]
    return split_hot_join(sites, findings.select(*keys, "finding_id", "kind"), keys).select("finding_id", "kind", *SITE)


def finding_counts(findings: DataFrame) -> DataFrame:
    """repo, pkg, n_findings, n_sites."""
    return findings.groupBy("repo", "pkg").agg(F.count(F.lit(1)).alias("n_findings"), F.sum("n_sites").cast("bigint").alias("n_sites"))


def located_counts(changes: DataFrame, sites: DataFrame) -> DataFrame:
    """``finding_counts`` of the findings that ``locate_changes`` would give, straight from the call sites.

    Sites meet the number of changes of their symbol; all that follows keeps to that key, so that the one shuffle
    of the join serves the distinct sites and their counts, and neither sites nor findings are written.
    """
    changed = changes.groupBy("pkg", F.col("path").alias("symbol")).agg(F.count(F.lit(1)).alias("n_changes"))
    hashed = changed.hint("shuffle_hash")  # a merge join would sort every site
    used = split_hot_join(sites.select("repo", "pkg", "symbol", "file", "line", "col"), hashed, ["pkg", "symbol"]).distinct()
    counted = used.groupBy("repo", "pkg", "symbol", "n_changes").agg(F.count(F.lit(1)).alias("n_sites"))
    return counted.groupBy("repo", "pkg").agg(
        F.sum("n_changes").cast("bigint").alias("n_findings"), F.sum(F.col("n_changes") * F.col("n_sites")).cast("bigint").alias("n_sites")
    )


def unlocated_counts(changes: DataFrame, dependencies: DataFrame, located: DataFrame) -> DataFrame:
    """Per (repo, pkg): impacting changes, how many were located, how many were not. ``located``: as ``finding_counts``.

    Unlocated is total minus located, both counted; no (repository x change) product is formed.
    """
    totals = changes.groupBy("pkg").agg(F.count(F.lit(1)).alias("n_changes"))
    deps = dependencies.select("repo", "pkg").distinct()
    zero = F.lit(0).cast("bigint")
    return (
        deps.join(totals, "pkg", "left")
        .join(located, ["repo", "pkg"], "left")
        .select(
            "repo",
            "pkg",
            F.coalesce("n_changes", zero).alias("n_changes"),
            F.coalesce("n_findings", zero).alias("n_findings"),
            F.coalesce("n_sites", zero).alias("n_sites"),
            (F.coalesce("n_changes", zero) - F.coalesce("n_findings", zero)).alias("n_unlocated"),
        )
    )


def wanted_spellings(wanted: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """pkg, written, symbol: every way to write a wanted symbol. An alias stands for its canonical name only."""
    names = wanted.select("pkg", "symbol").distinct()
    plain = names.select("pkg", F.col("symbol").alias("written"), "symbol")
    if aliases is None:
        return plain
    spelled = aliases.select("pkg", F.col("spelling").alias("written"), F.coalesce("canonical", "spelling").alias("symbol")).distinct()
    own = plain.join(spelled, ["pkg", "written"], "left_anti")
    return own.unionByName(spelled.join(names, ["pkg", "symbol"], "left_semi"))


def binding_sites(references: DataFrame, bindings: DataFrame, wanted: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Sites of names bound by an import.

    ``references``: repo, file, line, col, local, chain ARRAY. ``bindings``: repo, file, local, pkg, export
    (``*`` for a namespace). Every dotted prefix of export + chain counts, through the alias spellings.

    Prefixes are formed and looked up once per distinct spelling of a package, of which a fleet has few, not per
    reference: bound references are written once, and take the symbols of their spelling in one join.
    """
    full = F.concat(F.when(F.col("export") == "*", F.array().cast("array<string>")).otherwise(F.array("export")), F.col("chain"))
    bound = references.join(bindings, ["repo", "file", "local"]).select("repo", "file", "line", "col", "pkg", full.alias("full"))
    bound = cut_lineage(bound, "bound")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("full")), lambda n: F.array_join(F.slice("full", F.lit(1), n), "."))
    written = bound.select("pkg", "full").distinct().withColumn("written", F.explode(prefixes)).filter("written <> ''")
    used = split_hot_join(written, wanted_spellings(wanted, aliases), ["pkg", "written"]).select("pkg", "full", "symbol").distinct()
    hits = split_hot_join(bound, cut_lineage(used, "spellings"), ["pkg", "full"]).select("pkg", "symbol", "repo", "file", "line", "col")
    return hits.withColumn("via", F.lit("import")).dropDuplicates(["repo", "pkg", "symbol", "file", "line", "col"])


def member_sites(accesses: DataFrame, type_members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sites of members reached through a value's type.

    ``accesses``: repo, file, line, col, pkg, owner_type, member. ``type_members``: pkg, owner_member, canonical.
    """
    keyed = accesses.withColumn("owner_member", F.concat_ws(".", "owner_type", "member"))
    named = type_members.select("pkg", "owner_member", F.col("canonical").alias("symbol")).join(
        wanted.select("pkg", "symbol").distinct(), ["pkg", "symbol"], "left_semi"
    )
    hits = split_hot_join(keyed.select("repo", "pkg", "owner_member", "file", "line", "col"), named, ["pkg", "owner_member"])
    return (
        hits.drop("owner_member")
        .withColumn("via", F.lit("type"))
        .dropDuplicates(["repo", "pkg", "symbol", "file", "line", "col"])
    )


def packages_of_modules(modules: DataFrame, roots: DataFrame) -> DataFrame:
    """module, pkg: the packages whose import root a module is or lies under, once per distinct module.

    Each dotted prefix of a module is looked up as a key, so this is a hash join, not a prefix comparison.
    """
    prefixes = modules.select("module").distinct().withColumn("root", F.explode(dotted_prefixes(F.col("module"))))
    return split_hot_join(prefixes, roots.select("pkg", "root").distinct(), ["root"]).select("module", "pkg").distinct()


def with_packages(modules: DataFrame, roots: DataFrame) -> DataFrame:
    """``modules`` with pkg, a row per package its module belongs to; those of no package are left out.

    Modules are few next to the rows that name them, and one may be named by most rows.
    """
    return split_hot_join(modules, packages_of_modules(modules, roots), ["module"])


def rooted(modules: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct rows whose ``module`` is a package's import root or lies under it: adds pkg."""
    found = with_packages(modules, roots)
    return found.select(*modules.columns, "pkg").distinct()


def python_sites(
    calls: DataFrame, names: DataFrame, stars: DataFrame, referenced: DataFrame, roots: DataFrame, symbols: DataFrame
) -> DataFrame:
    """Call sites in Python files.

    ``calls``: repo, file, line, col, form ('name' or 'attribute'), name, receiver_module (NULL where the
    receiver is no module). ``names``: repo, file, local, module, exported. ``stars`` and ``referenced``: repo,
    file, module. ``symbols``: pkg, symbol. A bare name resolves through its own import first, and through a
    star import only where that import is not from the package. A method counts where the file imports the
    package and the receiver is not itself a module; of several symbols with one method name the last counts.

    All that names a module is looked up once per distinct module, and what a file imports is one short row: the calls meet
    it in one join by (repo, file), and that one shuffle of each side serves the distinct sites too.
    """
    bare = symbols.filter(~F.col("symbol").contains(".")).select("pkg", F.col("symbol").alias("written"), F.lit(False).alias("method"), "symbol")
    methods = (
        symbols.filter(F.col("symbol").contains("."))
        .withColumn("written", F.expr("substring(symbol, instr(symbol, '.') + 1)"))
        .groupBy("pkg", "written")
        .agg(F.max("symbol").alias("symbol"))
        .select("pkg", "written", F.lit(True).alias("method"), "symbol")
    )
    known = cut_lineage(bare.distinct().unionByName(methods), "python-symbols")
    receivers = calls.filter("form = 'attribute' AND receiver_module IS NOT NULL").withColumnRenamed("receiver_module", "module")
    modules = [x.select("module").distinct() for x in (names, stars, referenced, receivers)]
    # written, so that its size is known and a small one is not met by shuffling all that names a module
    owners = cut_lineage(packages_of_modules(reduce(DataFrame.unionByName, modules), roots), "python-modules")

    def of_package(rows):
        return split_hot_join(rows, owners, ["module"])

    def scope(rows, **given):
        kinds = {"own": OWN_IMPORT, "star": "string", "imported": "string"}
        return rows.select("repo", "file", *[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])

    own = F.struct(F.col("local").alias("name"), F.col("pkg").alias("pkg"), F.col("exported").alias("symbol"))
    exact = known.filter("NOT method").select("pkg", "written")

    def marked(rows, column):
        """``is_<column>`` where the column spells a symbol of the package."""
        return split_hot_join(rows, exact.select("pkg", F.col("written").alias(column), F.lit(True).alias(f"is_{column}")), ["pkg", column], "left")

    # an import counts for what it binds, and for a star import of the same package that it hides
    telling = marked(marked(of_package(names), "exported"), "local").filter("is_exported OR is_local")
    scopes = (
        scope(telling, own=own)
        .unionByName(scope(of_package(stars), star=F.col("pkg")))
        .unionByName(scope(of_package(referenced), imported=F.col("pkg")))
        .groupBy("repo", "file")
        .agg(*[F.collect_set(c).alias(c) for c in ("own", "star", "imported")])
    )
    called = ("repo", "file", "line", "col", "name")
    no_package = F.lit(None).cast("string").alias("pkg")
    method_names = known.filter("method").select(F.col("written").alias("name")).distinct()
    by_method = calls.filter("form = 'attribute' AND receiver_module IS NULL").join(method_names, "name", "left_semi")
    parts = [
        calls.filter("form = 'name'").select(*called, no_package, F.lit("name").alias("form")),
        split_hot_join(of_package(receivers), exact.withColumnRenamed("written", "name"), ["pkg", "name"], "left_semi").select(*called, "pkg", F.lit("module").alias("form")),
        by_method.select(*called, no_package, F.lit("method").alias("form")),
    ]
    met = split_hot_join(reduce(DataFrame.unionByName, parts), scopes, ["repo", "file"], "left")

    def named(pkg, symbol, method=False):
        return F.struct(pkg.alias("pkg"), symbol.alias("written"), F.lit(method).alias("method"))

    name, none = F.col("name"), F.array().cast("array<struct<pkg:string,written:string,method:boolean>>")
    same = F.filter("own", lambda o: o["name"] == name)
    shadowed = F.transform(same, lambda o: o["pkg"])
    by_name = F.concat(F.transform(same, lambda o: named(o["pkg"], o["symbol"])), F.transform(F.array_except("star", shadowed), lambda p: named(p, name)))
    meant = (
        F.when(F.col("form") == "module", F.array(named(F.col("pkg"), name)))
        .when(F.col("form") == "name", F.coalesce(by_name, none))
        .otherwise(F.coalesce(F.transform("imported", lambda p: named(p, name, True)), none))
    )
    candidates = met.select("repo", "file", "line", "col", F.inline(meant))
    hits = split_hot_join(candidates, known, ["pkg", "written", "method"])
    return hits.select("repo", "pkg", "symbol", "file", "line", "col").distinct()


def impact_sites(declared: DataFrame, references: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Lines outside the changed files that use a symbol declared inside them.

    ``declared``: repo, file, symbol. ``references``: repo, file, line, symbol.
    """
    touched = declared.join(changed_files, ["repo", "file"], "left_semi").select("repo", "symbol").distinct()
    outside = references.join(changed_files, ["repo", "file"], "left_anti")
    return outside.join(touched, ["repo", "symbol"], "left_semi").select("repo", "symbol", "file", "line").distinct()


def remaining_deprecations(deprecated: DataFrame, sites: DataFrame, imports: DataFrame) -> DataFrame:
    """Deprecated symbols still imported by one of the files that used them.

    ``deprecated``: repo, pkg, symbol. ``imports``: repo, file, pkg, name. One row per file that still does.
    """
    leaf = F.element_at(F.split("symbol", r"\."), -1)
    files = deprecated.join(sites.select("repo", "pkg", "symbol", "file").distinct(), ["repo", "pkg", "symbol"])
    still = imports.select("repo", "file", "pkg", "name").distinct()
    return files.withColumn("name", leaf).join(still, ["repo", "file", "pkg", "name"], "left_semi").select(
        "repo", "pkg", "symbol", "file"
    )


def suspected_false_removals(removals: DataFrame, exported: DataFrame) -> DataFrame:
    """Per package: reported removals, those that an independent export table still resolves, and their rate."""
    found = exported.select("pkg", "path", F.lit(1).alias("hit")).distinct()
    return (
        removals.join(found, ["pkg", "path"], "left")
        .groupBy("pkg")
        .agg(F.count(F.lit(1)).alias("n_audited"), F.count("hit").alias("n_suspect"))
        .withColumn("suspect_rate", F.round(F.col("n_suspect") / F.col("n_audited"), 6))
    )
