import random

import pytest
from pyspark.sql import functions as F

from fleetdrift.functions import signatures as S
from fleetdrift.operators import locate, renames, snapshot

SYMBOL = "pkg string, path string, kind string, signature string, deprecated boolean, doc string, type_params array<struct<name:string,defaulted:boolean>>"
SURFACE = "pkg string, version string, entry string, truncated boolean"


@pytest.fixture
def symbols(frame):
    def make(*items):
        out = []
        for item in items:
            path, signature, extra = (*item, {})[:3]
            out.append(("demo", path, "function", signature, extra.get("deprecated", False), extra.get("doc"), extra.get("type_params")))
        return frame(SYMBOL, *out)

    return make


def kinds(df):
    return sorted((r.kind, r.path, r.severity, r.confidence) for r in df.collect())


def test_removed_and_added(symbols):
    diff = snapshot.diff_symbols(symbols(("a", "() => void")), symbols(("b", "() => void")))
    assert kinds(diff) == [("added", "b", "feature", "high"), ("removed", "a", "breaking", "high")]


def test_required_parameter(symbols):
    diff = snapshot.diff_symbols(symbols(("a", "(x: A) => void")), symbols(("a", "(x: A, y: B) => void")))
    assert kinds(diff) == [("signature-changed", "a", "breaking", "high")]


def test_renamed_parameters_are_no_change(symbols):
    before = symbols(("a", "(x: A, { p, q }: B, ...r: C[]) => void"), ("b", "(f: (x: A) => B) => C"))
    after = symbols(("a", "(y: A, { s }: B, ...t: C[]) => void"), ("b", "(g: (z: A) => B) => C"))
    assert kinds(snapshot.diff_symbols(before, after)) == []


def test_deprecated_carries_guidance_and_can_change_too(symbols):
    diff = snapshot.diff_symbols(symbols(("a", "A")), symbols(("a", "B", {"deprecated": True, "doc": "use b"})))
    assert kinds(diff) == [("deprecated", "a", "deprecation", "high"), ("signature-changed", "a", "drift", "medium")]
    assert [r.guidance for r in diff.filter("kind = 'deprecated'").collect()] == ["use b"]


def test_truncated_target_reports_no_removals(frame, symbols):
    flags = snapshot.suppression_flags(frame(SURFACE, ("demo", "1", "i", False)), frame(SURFACE, ("demo", "2", "i", True)))
    assert kinds(snapshot.diff_symbols(symbols(("a", "A")), symbols(("b", "B")), flags)) == [("added", "b", "feature", "high")]


def test_no_declarations_is_unanalyzable(frame, symbols):
    flags = snapshot.suppression_flags(frame(SURFACE, ("demo", "1", "i", False)), frame(SURFACE, ("demo", "2", None, False)))
    assert kinds(snapshot.diff_symbols(symbols(("a", "A")), symbols(("b", "B")), flags)) == []
    assert [(r.unanalyzable, r.note) for r in snapshot.impact_headers(flags).collect()] == [(True, "demo@2 ships no type declarations")]


def test_empty_surface_hides_removals(frame, symbols):
    one, two = frame(SURFACE, ("demo", "1", "i", False)), frame(SURFACE, ("demo", "2", "i", False))
    flags = snapshot.suppression_flags(one, two, symbols(("a", "A")), symbols())
    assert [(r.hide_removals, r.hide_additions) for r in flags.collect()] == [(True, False)]


def test_alias_and_move(frame, symbols):
    aliases = frame("pkg string, spelling string, canonical string", ("demo", "old", "new"))
    before = symbols(("old", "A"), ("x.Thing", "typeof Thing"), ("y.Twin", "typeof Twin"))
    after = symbols(("new", "A"), ("z.Thing", "typeof Thing"), ("z.Twin", "typeof Twin"), ("w.Twin", "typeof Twin"))
    diff = snapshot.diff_symbols(before, after, aliases=aliases).filter("kind in ('removed', 'moved')")
    assert sorted((r.kind, r.path, r.moved_to) for r in diff.collect()) == [("moved", "x.Thing", "z.Thing"), ("removed", "y.Twin", None)]


def test_defaulted_type_parameter_is_a_feature(symbols):
    t = [("T", False)]
    before = symbols(("a", "Box<T>", {"type_params": t}), ("b", "Cfg<T>", {"type_params": t}))
    after = symbols(("a", "Box<T, U>", {"type_params": t + [("U", True)]}), ("b", "Cfg<T, U>", {"type_params": t + [("U", False)]}))
    assert kinds(snapshot.diff_symbols(before, after)) == [("signature-changed", "a", "feature", "high"), ("signature-changed", "b", "breaking", "high")]


def test_identity(symbols):
    same = symbols(("a", "(x: A) => void"), ("b.c", "Box<T>"))
    assert kinds(snapshot.diff_symbols(same, same)) == []


def test_reading_order(frame):
    rows = [("demo", "a.b", "k", "drift"), ("demo", "z", "k", "breaking"), ("demo", "a.b.c", "k", "breaking"), ("demo", "q", "k", "deprecation")]
    df = snapshot.reading_order(frame("pkg string, path string, kind string, severity string", *rows))
    assert [r.path for r in df.collect()] == ["z", "a.b.c", "q", "a.b"]


ARITIES = [
    ("(a: A, b: B) => C", 2), ("(a?: A, ...b: B[]) => C", 0), ("()", 0), ("Box<T>", None), ("(a: Map<K, V>, b: { x: 1, y: 2 }) => C", 2),
    ("(cb: () => void, b: number) => C", 1), ("(a: A", None), ("typeof X", None), ("f(a: [x: A, y: B]): C", 1),
]


def test_required_arity(frame, rows):
    df = frame("s string, want int", *ARITIES)
    assert rows(df, "s", S.required_arity("s")) == sorted(ARITIES, key=repr)


POSITIONS = [
    ("(a: A, b?: B) => C", "(p0: A,p1?: B) => C"),
    ("(...rest: A[]) => C", "(...p0: A[]) => C"),
    ("({ a, b }: X, [c]: Y) => Z", "(p0: X,p1: Y) => Z"),
    ("(f: (x: A, y: B) => C, g: D) => E", "(p0: (p0: A,p1: B) => C,p1: D) => E"),
    ("{ a: A, b: B }", "{ a: A, b: B }"),
    ("Map<K, V>", "Map<K, V>"),
    ("(this: void, ...{ a }: X) => Y", "(p0: void,...p1: X) => Y"),
    ("(x: A extends B ? C : D) => E", "(p0: A extends B ? C : D) => E"),
]


def test_positional_params(frame, rows):
    df = frame("s string, want string", *POSITIONS)
    assert rows(df, "s", S.positional_params("s")) == sorted(POSITIONS, key=repr)


def test_rename_rules(frame, symbols, rows):
    removed = frame("pkg string, path string, before string", ("demo", "E.errors", "Issue[]"), ("demo", "F.old", "X"), ("demo", "G.gone", "Y"), ("demo", "H.was", "Z"))
    target = symbols(("E.issues", "$Issue[]"), ("F.a", "X"), ("F.b", "X"), ("G.dep", "Y", {"deprecated": True}), ("K.was2", "Z"))
    assert rows(renames.find_renames(removed, target)) == [("demo", "E.errors", "E.issues", 80)]


def test_suggestions_match_scoring_all_pairs(frame):
    rnd = random.Random(7)
    words = ["get", "set", "user", "name", "all", "partial"]
    paths = {f"c{rnd.randrange(3)}." + "_".join(rnd.sample(words, rnd.randrange(1, 4))) for _ in range(60)}
    pool = frame("pkg string, path string, deprecated boolean", *[("p", p, False) for p in sorted(paths)])
    asked = frame("pkg string, path string", *[("p", p) for p in ("c0.user", "c1.get_name", "c2.set_all_user", "c0.zzz")])
    every = asked.crossJoin(pool.select(F.col("path").alias("candidate")))
    scored = every.withColumn("score", renames.suggestion_score(F.col("path"), F.col("candidate")))
    parent = lambda c: F.split(c, r"\.")[0]
    leaf = lambda c: F.split(c, r"\.")[1]
    wanted = scored.filter((parent(F.col("path")) == parent(F.col("candidate"))) | (leaf(F.col("path")) == leaf(F.col("candidate"))))
    expect = sorted((r.path, r.candidate, r.score) for r in wanted.filter("score < 5").collect())
    got = sorted((r.path, r.candidate, r.score) for r in renames.related_symbols(asked, pool).collect())
    assert got == expect
    best = {}
    for r in sorted(wanted.collect(), key=lambda r: (r.score, r.candidate)):
        best.setdefault(r.path, []).append(r.candidate)
    top = {}
    for r in renames.top_suggestions(asked, pool, 5).orderBy("path", "rank").collect():
        top.setdefault(r.path, []).append(r.candidate)
    assert top == {k: v[:5] for k, v in best.items()}


def test_sites_carry_their_kind(frame, rows):
    """A finding's sites are joined with it once: the child table names the kind beside the id."""
    findings = frame("repo string, pkg string, symbol string, kind string, finding_id string", ("r", "p", "s", "removed", "1"), ("r", "p", "s", "deprecated", "2"), ("r", "p", "u", "removed", "3"))
    sites = frame("repo string, pkg string, symbol string, file string, line int, col int, via string", ("r", "p", "s", "f", 1, 2, "import"), ("q", "p", "s", "f", 1, 2, "import"))
    found = locate.finding_sites(findings, sites)
    assert rows(found, "repo", "symbol", "file", "finding_id", "kind") == [("r", "s", "f", "1", "removed"), ("r", "s", "f", "2", "deprecated")]
    assert found._jdf.queryExecution().executedPlan().toString().count("Join") == 1


def test_located_counts_are_those_of_the_findings(frame, rows):
    rnd = random.Random(7)
    changes = frame("pkg string, path string, kind string", *[(f"p{rnd.randrange(3)}", f"s{k % 9}", f"k{k}") for k in range(24)], ("p0", None, "k"))
    lines = [(f"r{rnd.randrange(4)}", f"p{rnd.randrange(4)}", f"s{rnd.randrange(14)}", rnd.choice(["f", "g", None]), rnd.choice([1, 2, None]), 1) for _ in range(300)]
    sites = frame("repo string, pkg string, symbol string, file string, line int, col int, via string", *[(*x, rnd.choice(["import", "type"])) for x in lines], ("r0", None, "s1", "f", 1, 1, "type"))
    located = locate.locate_changes(changes, locate.distinct_sites(locate.wanted_sites(sites, changes)))
    columns = ("repo", "pkg", "n_findings", "n_sites")
    got = rows(locate.located_counts(changes, sites), *columns)
    assert got and got == rows(locate.finding_counts(located), *columns)


def test_package_counts_write_neither_sites_nor_findings(spark, monkeypatch):
    from fleetdrift import catalog
    from fleetdrift.plans import scan

    catalog.load_all()
    written, write = [], scan.cut_lineage
    monkeypatch.setattr(scan, "cut_lineage", lambda df, label: written.append(label) or write(df, label))
    assert catalog.QUERIES["unlocated_changes"](spark, "/root/testdata/sf0.001").count() > 0
    assert written == ["changes"]


def test_changes_are_graded_only_where_grades_are_read(symbols):
    diff = snapshot.diff_symbols(symbols(("a", "(x: A) => void"), ("b", "B")), symbols(("a", "(x: A, y: B) => void"), ("b", "C")))

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert "drift" in plan(diff) and "drift" not in plan(snapshot.consumer_impacting(diff).select("pkg", "path"))
    assert kinds(diff) == [("signature-changed", "a", "breaking", "high"), ("signature-changed", "b", "drift", "medium")]
