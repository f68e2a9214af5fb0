import pytest
from pyspark.sql import functions as F

from fleetdrift.functions import versions as V
from fleetdrift.operators import inventory

PAIRS = [
    ("PyPI", "1.0.post1", "1.0", 1),
    ("npm", "1.0.post1", "1.0", 0),
    ("PyPI", "1.0.dev1", "1.0a1", -1),
    ("PyPI", "1!1.0", "2.0", 1),
    ("PyPI", "1.10", "1.9", 1),
    ("PyPI", "1.0", "1.0.0", 0),
    ("PyPI", "1.0+local", "1.0", 1),
    ("PyPI", "not-a-version", "1.0", -1),
    ("PyPI", "nope", "also-nope", 0),
    ("npm", "v2.0.0", "v1.0.0", 1),
    ("npm", "v18", "v22", -1),
    ("npm", "1.0.0-rc.1", "1.0.0", -1),
    ("npm", "1.0.0-rc.10", "1.0.0-rc.2", -1),
    ("npm", "1.0.0-a-x", "1.0.0-a-y", 0),
]


def test_pairs(frame, rows):
    df = frame("eco string, a string, b string, want int", *PAIRS)
    got = rows(df, "eco", "a", "b", V.compare(F.col("eco"), F.col("a"), F.col("b")).alias("sign"))
    assert got == sorted(PAIRS, key=repr)


def test_full_pypi_order(frame):
    order = ["1.0a1.dev1", "1.0a1", "1.0a1.post1.dev1", "1.0a1.post1", "1.0a1.post2", "1.0a2", "1.0"]
    df = frame("v string", *[(v,) for v in reversed(order)])
    assert [r.v for r in df.orderBy(V.pep440_key(F.col("v"))).collect()] == order


def test_prereleases(frame, rows):
    df = frame("eco string, v string", ("PyPI", "1.0.dev1"), ("PyPI", "1.0rc1"), ("PyPI", "1.0.post1"), ("PyPI", "1.0"), ("PyPI", "x"), ("npm", "1.0.0-a"))
    got = dict(rows(df, "v", V.is_prerelease(F.col("eco"), F.col("v"))))
    assert got == {"1.0.dev1": True, "1.0rc1": True, "1.0.post1": False, "1.0": False, "x": True, "1.0.0-a": True}


def test_unclaimed_ecosystem_is_an_error(frame):
    only = (V.SCHEMES[0],)
    with pytest.raises(Exception, match="no version scheme claims ecosystem"):
        frame("eco string, v string", ("npm", "1.0")).select(V.version_key(F.col("eco"), F.col("v"), only)).collect()


def test_ranges(frame, rows):
    published = frame("name string, version string", *[("p", v) for v in ("0.1.0", "0.1.9", "0.2.0", "1.0.0", "1.4.2", "2.0.0-rc.1", "1.4.10")])
    tags = frame("name string, latest string", ("p", "1.4.2"))
    asked = {"^0.1.0": "0.1.9", "~1.4.0": "1.4.10", "^1.0.0": "1.4.10", "1.0.0": "1.0.0", "9.9.9": "1.4.2", "*": "1.4.2", ">=1": "1.4.2", "^7.0.0": "1.4.2"}
    ranges = frame("name string, declared string", *[("p", d) for d in asked])
    assert dict(rows(inventory.resolve_ranges(ranges, published, tags), "declared", "resolved")) == asked


def test_target_version(frame, rows):
    published = frame("name string, ecosystem string, version string", ("a", "npm", "1.0.0"), ("a", "npm", "2.0.0-b"), ("b", "npm", "1.0.0"), ("c", "npm", "1.0.0-x"))
    tags = frame("name string, ecosystem string, latest string", ("a", "npm", "2.0.0-b"), ("b", "npm", "9.9.9"), ("c", "npm", None))
    got = dict(rows(inventory.target_versions(tags, published), "name", "target"))
    assert got == {"a": "2.0.0-b", "b": "1.0.0", "c": None}
