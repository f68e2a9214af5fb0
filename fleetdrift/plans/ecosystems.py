"""Ecosystems as bundles of readers: what a repository has installed and what it declares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import base_name
from ..session import cut_lineage
from ..sources import lockfiles, manifests, requirements

INSTALLED = ("repo", "ecosystem", "name", "version", "file")


def _answering(files: DataFrame, registry) -> DataFrame:
    """The texts that answer for each repository, written once: repo, file, content, answers_<i>, alone_<i>.

    ``answers_<i>`` tells the file an inventory reads: the first of its order a repository has, readable or not, and what
    that file may include. ``alone_<i>`` tells that no other row of the repository answers. What a repository has is
    gathered beside its rows, so that all inventories take one pass over the texts, and one shuffle of them at most.
    """
    file, whole = F.col("file"), Window.partitionBy("repo")
    ranks = [F.array_position(F.array(*[F.lit(f) for f in i.lock_order]), file) for i in registry]
    known = files.filter("repo IS NOT NULL").select("repo", "file", "content", *[F.nullif(r, F.lit(0).cast("bigint")).alias(f"rank_{k}") for k, r in enumerate(ranks)])
    if any(i.includes for i in registry):
        known = known.withColumn("targets", requirements.targets(file, F.col("content")))
    gathered = [F.collect_list(f"rank_{k}").over(whole).alias(f"ranks_{k}") for k in range(len(registry))]
    if "targets" in known.columns:
        gathered.append(F.collect_list("targets").over(whole).alias("all_targets"))
    rows, flags = known.select("*", *gathered), []
    for k, i in enumerate(registry):
        best = F.array_min(f"ranks_{k}")
        answers = F.coalesce(F.col(f"rank_{k}") == best, F.lit(False))
        if i.includes:
            # of a repository that names very many files all are kept, as looking each up would take too long
            named = (F.size("all_targets") > requirements.EDGES_INSIDE) | F.exists("all_targets", lambda t: F.array_contains(t, file))
            answers = answers | F.coalesce(named & (best == i.lock_order.index(i.includes) + 1), F.lit(False))
        flags += [answers.alias(f"answers_{k}"), (F.size(F.filter(f"ranks_{k}", lambda r: r == F.array_min(f"ranks_{k}"))) == 1).alias(f"alone_{k}")]
    answering = rows.select("repo", "file", "content", *flags).filter(" OR ".join(f"answers_{k}" for k in range(len(registry))))
    return cut_lineage(answering, "answering-files")


def _read(inventory_, texts: DataFrame, k: int) -> DataFrame:
    """Installed packages. A file's entries are distinct as they are read; only where several rows answer they are compared."""
    mine = texts.filter(f"answers_{k}")
    several = mine.filter(f"NOT alone_{k}")
    read = inventory_.parse(mine.filter(f"alone_{k}"))
    if not several.isEmpty():
        read = read.unionByName(inventory_.parse(several).distinct())
    return read.withColumn("ecosystem", F.lit(inventory_.ecosystem)).select(*INSTALLED)


class NpmInventory:
    ecosystem = "npm"
    lock_order = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock")
    includes = None

    def applies(self, files: DataFrame) -> DataFrame:
        return files.filter(base_name(F.col("file")) == "package.json").select("repo").distinct()

    def read(self, files: DataFrame) -> DataFrame:
        """Installed packages from the lockfile that answers for each repository."""
        return installed(files, (self,))

    def parse(self, texts: DataFrame) -> DataFrame:
        """repo, file, name, version of the texts that answer; one row per package of a text."""

        def of(kind):
            return texts.filter(F.col("file") == kind)

        parts = [
            lockfiles.npm_versions(of("package-lock.json")), lockfiles.pnpm_lock(of("pnpm-lock.yaml")),
            lockfiles.yarn_lock(of("yarn.lock")), lockfiles.bun_lock(of("bun.lock")),
        ]
        return _union(parts)

    def declared(self, files: DataFrame) -> DataFrame:
        """repo, workspace, name, declared, dev of every package.json."""
        own = files.filter(base_name(F.col("file")) == "package.json")
        folder = F.regexp_replace("file", r"/?package\.json$", "")
        return manifests.manifest_dependencies(own.select("repo", folder.alias("workspace"), "content"))


class PythonInventory:
    ecosystem = "PyPI"
    lock_order = ("uv.lock", "poetry.lock", "pdm.lock", "Pipfile.lock", "requirements.txt")
    includes = "requirements.txt"  # the file of its order that names others

    def applies(self, files: DataFrame) -> DataFrame:
        return files.filter(F.col("file").isin("pyproject.toml", *self.lock_order)).select("repo").distinct()

    def read(self, files: DataFrame) -> DataFrame:
        """A lockfile answers alone; requirements are read, with what they include, only where there is none."""
        return installed(files, (self,))

    def parse(self, texts: DataFrame) -> DataFrame:
        """repo, file, name, version of the texts that answer; requirements with the files they include among ``texts``."""
        toml = lockfiles.toml_lock(texts.filter(F.col("file").isin(*self.lock_order[:3])))
        pipfile = lockfiles.pipfile_lock(texts.filter("file = 'Pipfile.lock'"))
        tree = requirements.requirements_tree(texts.filter(~F.col("file").isin(*self.lock_order[:4]))).filter("version IS NOT NULL").withColumn("file", F.lit("requirements.txt"))
        return _union([toml, pipfile, tree])

    def declared(self, files: DataFrame) -> DataFrame:
        tree = requirements.requirements_tree(files)
        return tree.filter("declared IS NOT NULL").select("repo", F.lit("").alias("workspace"), "name", "declared", F.lit(False).alias("dev"))


INVENTORIES = (NpmInventory(), PythonInventory())


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select("repo", "file", "name", "version") for p in parts])


def installed(files: DataFrame, registry=INVENTORIES) -> DataFrame:
    """Installed packages of every ecosystem that claims a repository."""
    texts = _answering(files, registry)
    return reduce(lambda a, b: a.unionByName(b), [_read(i, texts, k) for k, i in enumerate(registry)])
