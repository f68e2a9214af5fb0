"""Lockfiles to installed versions.

One lockfile is one row. Blocks and maps are taken apart inside that row, and "the first entry of a name counts"
is settled there too: entries are sorted by name and neighbours compared, so none is shuffled or sorted with those of
other files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import first_match, firsts, let, line_blocks, lines_of, strip, strip_left, strip_right


def split_name_version(spec: Column) -> Column:
    """name and version of ``name@version(peer)``; NULL unless the version starts with a digit."""
    base = strip(F.get(F.split(spec, r"\("), 0))
    name, version = (F.regexp_extract(base, r"(?s)^(.+)@(\d[^@]*)$", i) for i in (1, 2))
    return F.when(name != "", F.struct(name.alias("name"), version.alias("version")))


def name_of_install_path(path: Column) -> Column:
    """The package of the innermost ``node_modules`` folder of a path, else NULL."""
    return F.nullif(F.regexp_extract(path, r"(?:^|.*/)node_modules/(@[^/]+/[^/]+|[^@/][^/]*)$", 1), F.lit(""))


def top_level_name(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"^node_modules/(@[^/]+/[^/]+|[^@/][^/]*)$", 1), F.lit(""))


def _entry(name: Column, pos: Column, version: Column, line: Column) -> Column:
    return F.struct(name.alias("name"), pos.alias("pos"), version.alias("version"), line.alias("line"))


def _first_per_name(files: DataFrame, entries: Column) -> DataFrame:
    """repo, file, name, version, line of the first of each name among a file's ``entries`` (as ``_entry`` makes them)."""
    # the outer form, as for the other Spark filters by the size of the array, which reads each text twice
    rows = files.select("repo", "file", F.inline_outer(firsts(entries, "name"))).filter("name IS NOT NULL")
    return rows.select("repo", "file", "name", "version", "line")


def _npm_entries() -> Column:
    """The installed packages of a parsed lock ``l``."""

    def entry(path, name, version, dev):
        return F.struct(path.alias("install_path"), name.alias("name"), version.alias("version"), dev.alias("dev"))

    packages = F.filter(
        F.map_entries("l.packages"),
        lambda e: (e["key"] != "")
        & ~F.coalesce(e["value"]["link"], F.lit(False))
        & (F.coalesce(e["value"]["version"], F.lit("")) != "")
        & (F.coalesce(e["value"]["resolved"], F.lit("")).isin("") | e["value"]["resolved"].rlike("^https?://")),
    )
    new = F.transform(
        packages,
        lambda e: entry(
            e["key"], F.coalesce(e["value"]["name"], name_of_install_path(e["key"])), e["value"]["version"], F.coalesce(e["value"]["dev"], F.lit(False))
        ),
    )
    old = F.transform(
        F.filter(F.map_entries("l.dependencies"), lambda e: F.coalesce(e["value"]["version"], F.lit("")) != ""),
        lambda e: entry(F.concat(F.lit("node_modules/"), e["key"]), e["key"], e["value"]["version"], F.lit(False)),
    )
    kind = "array<struct<install_path:string,name:string,version:string,dev:boolean>>"
    return let(
        F.coalesce(new, F.array().cast(kind)),
        lambda n: F.when(F.exists(n, lambda e: top_level_name(e["install_path"]).isNotNull()), n).otherwise(
            F.concat(n, F.coalesce(old, F.array().cast(kind)))
        ),
    )


def npm_lock(files: DataFrame) -> DataFrame:
    """repo, install_path, name, version, dev, top_name of ``package-lock.json`` texts.

    The root, links and entries resolved from anything but the registry are left out. Where no top-level
    version is found the older ``dependencies`` layout is read instead.
    """
    parsed = files.select("repo", F.from_json("content", schemas.NPM_LOCK).alias("l"))
    return parsed.select("repo", F.inline(_npm_entries())).withColumn("top_name", top_level_name(F.col("install_path")))


def npm_versions(files: DataFrame) -> DataFrame:
    """repo, file, name, version of ``npm_lock``, each once per file though installed under several paths."""
    parsed = files.select("repo", "file", F.from_json("content", schemas.NPM_LOCK).alias("l"))
    named = F.filter(_npm_entries(), lambda e: e["name"].isNotNull())
    packages = F.transform(named, lambda e: F.struct(F.struct(e["name"].alias("name"), e["version"].alias("version")).alias("package")))
    rows = parsed.select("repo", "file", F.inline_outer(firsts(packages, "package"))).filter("package IS NOT NULL")
    return rows.select("repo", "file", "package.name", "package.version")


def npm_edges(files: DataFrame) -> DataFrame:
    """repo, src, dst of the dependency graph. A package's edges are those of its hoisted entry, else of the first nested one."""
    lock = F.from_json("content", schemas.NPM_LOCK)
    entries = files.select("repo", F.posexplode(F.map_entries(lock["packages"])).alias("pos", "e")).select(
        "repo",
        name_of_install_path(F.col("e.key")).alias("src"),
        F.when(top_level_name(F.col("e.key")).isNotNull(), -1).otherwise(F.col("pos")).alias("rank"),
        F.map_keys("e.value.dependencies").alias("deps"),
    )
    chosen = entries.filter("src IS NOT NULL").groupBy("repo", "src").agg(F.min_by(F.struct("deps"), "rank").alias("c"))
    return chosen.select("repo", "src", F.explode("c.deps").alias("dst"))


def _yarn_names(header: Column) -> Column:
    text = strip_right(header)
    specs = F.split(F.substring(text, F.lit(1), F.length(text) - 1), ",")

    def name(spec):
        bare = F.regexp_replace(strip(spec), '^"|"$', "")
        at = F.regexp_extract(bare, "(?s)^(.+)@([^@]*)$", 1)
        tail = F.regexp_extract(bare, "(?s)^(.+)@([^@]*)$", 2)
        return F.when(at == "", bare).when(tail.startswith("workspace:"), "").otherwise(at)

    return F.filter(F.transform(specs, name), lambda n: n != "")


def yarn_lock(files: DataFrame) -> DataFrame:
    """repo, file, name, version, line. A header names several specs; the first ``version`` below it answers for all."""

    def is_header(line):
        return line.rlike(r"^[^\s#]") & strip_right(line).endswith(":")

    blocks = F.filter(line_blocks(F.col("content"), is_header), lambda b: ~b["header"].startswith("__"))
    found = F.transform(
        blocks,
        lambda b: F.struct(
            _yarn_names(b["header"]).alias("names"),
            first_match(b["lines"], r'^\s+"?version"?:?\s+"?([^"\s]+)"?\s*$').alias("version"),
            b["pos"].alias("pos"),
        ),
    )
    read = F.filter(found, lambda b: b["version"].isNotNull())
    entries = F.flatten(F.transform(read, lambda b: F.transform(b["names"], lambda n: _entry(n, b["pos"], b["version"], b["pos"] + 1))))
    return _first_per_name(files, entries)


def pnpm_lock(files: DataFrame) -> DataFrame:
    """repo, file, name, version, line of the keys in the ``packages:`` section."""
    sections = F.filter(line_blocks(F.col("content"), lambda l: l.rlike("^[a-zA-Z]")), lambda b: b["header"].startswith("packages:"))

    def read(text):
        key = F.regexp_extract(text, r"""^\s{2}'?"?([^'":]+?)'?"?:\s*$""", 1)
        return let(key, lambda k: F.when(k.startswith("/"), old(k)).when(k != "", split_name_version(k)))

    def old(key):
        name, version = (F.regexp_extract(key, r"^/(.+)/([^/]*)$", i) for i in (1, 2))
        plain = F.struct(name.alias("name"), F.get(F.split(version, r"\("), 0).alias("version"))
        return F.when((name != "") & version.rlike(r"^\d"), plain)

    def entry(text, at):
        return let(read(text), lambda r: F.when(r.isNotNull(), _entry(r["name"], at, r["version"], at)))

    entries = F.flatten(F.transform(sections, lambda b: F.transform(b["lines"], lambda l, n: entry(l, b["pos"] + n + 2))))
    return _first_per_name(files, F.array_compact(entries))


def toml_lock(files: DataFrame) -> DataFrame:
    """repo, file, name, version, line of ``[[package]]`` blocks; a version belongs to the latest name above it."""
    blocks = F.filter(
        line_blocks(F.col("content"), lambda l: strip_left(l).startswith("[")), lambda b: strip(b["header"]) == "[[package]]"
    )
    state = F.struct(F.lit(None).cast("string").alias("name"), F.array().cast("array<struct<name:string,version:string>>").alias("out"))

    def step(acc, raw):
        line = strip(raw)
        name = F.regexp_extract(line, '^name = "([^"]*)"$', 1)
        version = F.regexp_extract(line, '^version = "([^"]*)"$', 1)
        is_name, is_version = line.rlike('^name = "[^"]*"$'), line.rlike('^version = "[^"]*"$')
        taken = is_version & acc["name"].isNotNull()
        return F.struct(
            F.when(is_name, name).when(is_version, F.lit(None)).otherwise(acc["name"]).alias("name"),
            F.when(taken, F.concat(acc["out"], F.array(F.struct(acc["name"].alias("name"), version.alias("version"))))).otherwise(acc["out"]).alias("out"),
        )

    def read(block):
        pairs = F.aggregate(block["lines"], state, step)["out"]
        return F.transform(pairs, lambda e, n: _entry(e["name"], F.struct(block["pos"].alias("block"), n.alias("n")), e["version"], block["pos"] + 1))

    return _first_per_name(files, F.flatten(F.transform(blocks, read)))


def bun_lock(files: DataFrame) -> DataFrame:
    """repo, file, name, version, line. Trailing commas are dropped before the JSON is read."""
    clean = F.regexp_replace("content", r",(\s*[}\]])", "$1")
    packages = F.from_json(F.get_json_object(clean, "$.packages"), "map<string,string>")

    def entry(value, pos):
        spec = F.when(value.startswith("["), F.get(F.from_json(value, "array<string>"), 0)).otherwise(value)
        return let(spec, lambda s: let(split_name_version(s), lambda r: F.when(r.isNotNull(), at(s, 1, pos, r))))

    def at(spec, side, n, read):
        return F.struct(spec.alias("spec"), F.lit(side).alias("side"), n.alias("n"), read.alias("r"))

    none = F.lit(None).cast("struct<name:string,version:string>")
    quoted = F.transform(
        lines_of(F.col("content")),
        lambda l, i: F.transform(F.array_distinct(F.regexp_extract_all(l, F.lit('"([^"]*)"'), F.lit(1))), lambda s: at(s, 0, i + 1, none)),
    )
    read = F.array_compact(F.transform(F.map_values(packages), entry))

    def located(both):
        """Both sides in the order of their specs: an entry stands behind the first line that quotes it."""

        def line(e, i):
            before = F.get(both, i - 1)
            return F.when((before["spec"] == e["spec"]) & (before["side"] == 0), before["n"])

        found = F.transform(both, lambda e, i: F.when(e["side"] == 1, _entry(e["r"]["name"], e["n"], e["r"]["version"], line(e, i))))
        return F.array_compact(found)

    sides = F.concat(firsts(F.flatten(quoted), "spec"), firsts(read, "spec"))
    return _first_per_name(files, let(F.sort_array(sides), located))


def pipfile_lock(files: DataFrame) -> DataFrame:
    """repo, file, name, version of ``==`` entries; ``default`` before ``develop``, the first wins."""
    lock = F.from_json("content", schemas.PIPFILE_LOCK)
    empty = F.create_map().cast("map<string,struct<version:string>>")

    def group(column, rank):
        return F.transform(
            F.map_entries(F.coalesce(lock[column], empty)),
            lambda e: F.struct(e["key"].alias("name"), e["value"]["version"].alias("version"), F.lit(rank).alias("pos"), F.lit(None).cast("int").alias("line")),
        )

    pinned = F.filter(F.concat(group("default", 0), group("develop", 1)), lambda e: e["version"].startswith("=="))
    bare = F.transform(pinned, lambda e: _entry(e["name"], e["pos"], F.substring(e["version"], F.lit(3), F.length(e["version"])), e["line"]))
    return _first_per_name(files, bare).drop("line")


def lockfile_status(files: DataFrame, versions: DataFrame) -> DataFrame:
    """repo, file, n_versions, status: a text that yields no version is unsupported, not empty."""
    counts = versions.groupBy("repo", "file").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    blank = strip(F.col("content")) == ""
    return files.join(counts, ["repo", "file"], "left").select(
        "repo", "file", n.alias("n_versions"), F.when((n == 0) & ~blank, "unsupported").otherwise("read").alias("status")
    )
