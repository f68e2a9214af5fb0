"""Version ordering as sortable struct columns.

Both schemes produce the same struct type, so one column can carry keys of several ecosystems. Keys
compare with ``<``, ``max_by`` and ``orderBy`` natively; materialise them in the tables that are read
often so that column statistics can prune files.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

PEP440 = (
    r"^(?:(\d+)!)?(\d+(?:\.\d+)*)(?:(a|b|rc)(\d+))?(?:\.post(\d+))?(?:\.dev(\d+))?(?:\+([a-zA-Z0-9._-]+))?$"
)
# The rank of a release phase.
PHASE_RANK = {"dev": 0, "a": 1, "b": 2, "rc": 3, "release": 4, "post": 5}
ABSENT_DEV = 9223372036854775807


def _number(text: Column) -> Column:
    """The leading integer of a text, 0 where there is none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def _key(parsed, epoch, release, phase, phase_no, post, dev, has_local, text) -> Column:
    return F.struct(
        parsed.cast("int").alias("parsed"),
        epoch.cast("bigint").alias("epoch"),
        release.cast("array<bigint>").alias("release"),
        phase.cast("int").alias("phase"),
        phase_no.cast("bigint").alias("phase_no"),
        post.cast("bigint").alias("post"),
        dev.cast("bigint").alias("dev"),
        has_local.cast("int").alias("has_local"),
        text.cast("string").alias("text"),
    )


def semver_key(version: Column) -> Column:
    """Three numeric parts, a release above its prereleases, prerelease text compared as text.

    Only the text between the first and the second dash is the prerelease, so ``rc.10 < rc.2``.
    """
    pieces = F.split(F.regexp_replace(version, "^v", ""), "-")
    parts = F.split(F.get(pieces, 0), r"\.")
    release = F.array(*[_number(F.coalesce(F.get(parts, i), F.lit(""))) for i in range(3)])
    pre = F.coalesce(F.get(pieces, 1), F.lit(""))
    zero = F.lit(0)
    return _key(F.lit(1), zero, release, (pre == "").cast("int"), zero, zero, zero, zero, pre)


def pep440_key(version: Column) -> Column:
    """Epoch, release, phase, phase number, post, dev, local; an unreadable version sorts lowest.

    Trailing zero parts are cut from the release, which orders arrays as if they were padded.
    """

    def group(i):
        return F.nullif(F.regexp_extract(version, PEP440, i), F.lit(""))

    readable = version.rlike(PEP440)
    letter, pre_no, post, dev, local = (group(i) for i in range(3, 8))
    release = F.transform(
        F.split(F.regexp_replace(F.coalesce(group(2), F.lit("0")), r"(\.0+)+$", ""), r"\."),
        lambda part: part.try_cast("bigint"),
    )
    phase = (
        F.when(letter == "a", PHASE_RANK["a"])
        .when(letter == "b", PHASE_RANK["b"])
        .when(letter == "rc", PHASE_RANK["rc"])
        .when(post.isNotNull(), PHASE_RANK["post"])
        .when(dev.isNotNull(), PHASE_RANK["dev"])
        .otherwise(PHASE_RANK["release"])
    )
    phase_no = F.when(letter.isNotNull(), pre_no).when(post.isNotNull(), post).when(dev.isNotNull(), dev)
    return F.when(
        readable,
        _key(
            F.lit(1),
            F.coalesce(group(1).try_cast("bigint"), F.lit(0)),
            release,
            phase,
            F.coalesce(phase_no.try_cast("bigint"), F.lit(0)),
            F.coalesce(post.try_cast("bigint"), F.lit(-1)),
            F.coalesce(dev.try_cast("bigint"), F.lit(ABSENT_DEV)),
            local.isNotNull().cast("int"),
            F.coalesce(local, F.lit("")),
        ),
    ).otherwise(
        _key(F.lit(0), F.lit(0), F.array(F.lit(0)), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(""))
    )


def semver_is_prerelease(version: Column) -> Column:
    return F.contains(version, F.lit("-"))


def pep440_is_prerelease(version: Column) -> Column:
    """dev, a, b and rc releases, and whatever cannot be read."""
    return (
        ~version.rlike(PEP440)
        | (F.regexp_extract(version, PEP440, 3) != "")
        | (F.regexp_extract(version, PEP440, 6) != "")
    )


class VersionScheme:
    """An ordering that claims some ecosystems. The first scheme of a registry that claims one, wins."""

    def __init__(self, scheme_id: str, ecosystems: tuple[str, ...] | None, key, is_prerelease):
        self.scheme_id = scheme_id
        self.ecosystems = ecosystems
        self.key = key
        self.is_prerelease = is_prerelease

    def claims(self, ecosystem: Column) -> Column:
        return F.lit(True) if self.ecosystems is None else ecosystem.isin(*self.ecosystems)


SCHEMES = (
    VersionScheme("pep440", ("PyPI",), pep440_key, pep440_is_prerelease),
    VersionScheme("semver", None, semver_key, semver_is_prerelease),
)


def _dispatch(ecosystem: Column, pick, registry) -> Column:
    chain = F
    for scheme in registry:
        chain = chain.when(scheme.claims(ecosystem), pick(scheme))
    problem = F.concat(F.lit("no version scheme claims ecosystem "), ecosystem)
    return chain.otherwise(F.raise_error(problem))


def version_key(ecosystem: Column, version: Column, registry=SCHEMES) -> Column:
    """The sort key under the scheme of the row's ecosystem."""
    return _dispatch(ecosystem, lambda s: s.key(version), registry)


def is_prerelease(ecosystem: Column, version: Column, registry=SCHEMES) -> Column:
    return _dispatch(ecosystem, lambda s: s.is_prerelease(version), registry)


def scheme_id(ecosystem: Column, registry=SCHEMES) -> Column:
    return _dispatch(ecosystem, lambda s: F.lit(s.scheme_id), registry)


def compare(ecosystem: Column, a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    left, right = version_key(ecosystem, a), version_key(ecosystem, b)
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def is_up_to_date(ecosystem: Column, installed: Column, target: Column) -> Column:
    return version_key(ecosystem, target) <= version_key(ecosystem, installed)


# --- versions inside declared ranges -----------------------------------------------------------------

FULL_VERSION = r"(\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?)"
RANGE = r"^([\^~]|>=|>|<=|<|=|v)?\s*(\d+)\.(\d+)\.(\d+)"


def exact_pin(declared: Column) -> Column:
    """The version where a declaration names exactly one, else NULL."""
    return F.nullif(F.regexp_extract(strip(declared), rf"^(?:=|v)?{FULL_VERSION}$", 1), F.lit(""))


def first_version_in(declared: Column) -> Column:
    return F.nullif(F.regexp_extract(declared, FULL_VERSION, 1), F.lit(""))


def pinned_by_specifier(specifier: Column) -> Column:
    """The version of an ``==`` or ``===`` specifier without wildcard or list, else NULL."""
    text = strip(F.regexp_extract(strip(specifier), r"^(?:===|==)\s*(.+)$", 1))
    return F.when((text != "") & ~text.contains("*") & ~text.contains(","), text)


def range_parts(declared: Column) -> Column:
    """Operator and floor of the first alternative of an npm range; NULL floor where it has no full version."""
    first = F.get(F.split(strip(F.get(F.split(strip(declared), r"\|\|"), 0)), r"\s+"), 0)
    parts = [F.regexp_extract(first, RANGE, i) for i in (1, 2, 3, 4)]
    major, minor, patch = (p.try_cast("bigint") for p in parts[1:])
    floor = F.when(
        parts[1] != "",
        F.concat_ws(".", major.cast("string"), minor.cast("string"), patch.cast("string")),
    )
    return F.struct(
        parts[0].alias("op"), major.alias("major"), minor.alias("minor"), patch.alias("patch"), floor.alias("floor")
    )


def takes_latest(declared: Column) -> Column:
    """Ranges that follow the latest tag: empty, wildcard, comparison operators, or unreadable."""
    spec = strip(F.coalesce(declared, F.lit("")))
    parts = range_parts(spec)
    return (
        spec.isin("", "*", "x", "latest")
        | parts["floor"].isNull()
        | parts["op"].isin(">", ">=", "<", "<=")
    )


def major_minor(version: Column) -> list[Column]:
    """The first two numeric parts as ranges read them."""
    pieces = F.split(version, r"\.")
    return [_number(F.get(pieces, 0)).alias("major"), _number(F.coalesce(F.get(pieces, 1), F.lit(""))).alias("minor")]


def in_range(version: Column, declared: Column) -> Column:
    """Caret and tilde membership with the 0.x rules."""
    parts = range_parts(declared)
    pieces = F.split(version, r"\.")
    major = _number(F.get(pieces, 0))
    minor = _number(F.coalesce(F.get(pieces, 1), F.lit("")))
    at_least = semver_key(version) >= semver_key(parts["floor"])
    member = (
        F.when(parts["op"] == "~", (major == parts["major"]) & (minor == parts["minor"]))
        .when(parts["major"] > 0, major == parts["major"])
        .when(parts["minor"] > 0, (major == 0) & (minor == parts["minor"]))
        .otherwise(version == parts["floor"])
    )
    return parts["op"].isin("^", "~") & at_least & member
