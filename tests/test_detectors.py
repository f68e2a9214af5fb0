import random

from pyspark.sql import functions as F

from fleetdrift.operators import locate
from fleetdrift.plans import detectors

CALLS = "repo string, file string, line int, col int, text string, method string, resolved boolean, host string, route string, params array<string>, reason string"
DESCRIPTION = "vendor string, seq int, url string, provenance string, updated_at timestamp, body string"


class _Fails:
    detector_id = "fails"

    def detect(self, tables):
        broken = F.udf(lambda x: 1 // 0, "int")
        return tables["calls"].select("repo", broken("line").alias("line")), None


def spec(*routes):
    paths = ",".join(f'"{r}":{{"get":{{}}}}' for r in routes)
    return f'{{"openapi":"3.0.0","servers":[{{"url":"https://h.io"}}],"paths":{{{paths}}}}}'


def test_a_failing_task_takes_down_its_detector_only(frame, rows):
    call = lambda line, route: ("r", "a.ts", line, 1, "t", "GET", True, "h.io", route, [], None)
    tables = {
        "calls": frame(CALLS, call(1, "/a/b"), call(2, "/a/gone")),
        "descriptions": frame(DESCRIPTION, ("h.io", 1, "https://h.io/spec", "official-domain", None, spec("/a/b"))).withColumn("updated_at", F.to_timestamp(F.lit("2024-01-01"))),
    }
    contract = detectors.ContractDetector(F.to_timestamp(F.lit("2024-01-02")))
    run = detectors.run_detectors([_Fails(), contract], tables)
    assert [name for name, _ in run.failures] == ["fails"]
    found = rows(run.findings, "detector", "severity", "pkg", "line")
    assert found == [("http-contract", "breaking", "h.io", 2)]
    assert rows(run.notes) == []


def test_symbols_go_to_the_first_resolver_that_claims_them(frame, rows):
    class Named:
        def __init__(self, name, *ecosystems):
            self.route = detectors.Route(name, ecosystems)

        def sites(self, wanted, tables):
            return wanted.join(tables["uses"], ["pkg", "symbol"])

    wanted = frame("pkg string, symbol string, ecosystem string", ("a", "x", "npm"), ("b", "y", "PyPI"), ("c", "z", "Go"), ("d", "w", None))
    uses = frame("repo string, pkg string, symbol string, file string, line int, col int", *[("r", p, s, "f", 1, 2) for p, s in ("ax", "by", "cz", "dw")])
    sites, warnings = detectors.resolve_sites((Named("first", "npm"), Named("second", "npm", "PyPI")), wanted, {"uses": uses})
    assert rows(sites, "pkg", "symbol", "resolver") == [("a", "x", "first"), ("b", "y", "second")]
    assert rows(warnings, "ecosystem", "n") == [("Go", 1), (None, 1)]
    assert all("were not searched" in r.warning for r in warnings.collect())


def test_changes_since_the_previous_description_are_findings(frame, rows):
    call = lambda line, route: ("r", "a.ts", line, 1, "t", "GET", True, "h.io", route, [], None)
    given = frame(DESCRIPTION, ("h.io", 1, "https://h.io/spec", "official-domain", None, spec("/a/b", "/a/new")))
    tables = {
        "calls": frame(CALLS, call(1, "/a/b"), call(2, "/a/gone")),
        "descriptions": given.withColumn("updated_at", F.to_timestamp(F.lit("2024-01-01"))),
        "previous_descriptions": frame("vendor string, body string", ("h.io", spec("/a/b", "/a/gone", "/a/unused"))),
    }
    now = F.to_timestamp(F.lit("2024-01-02"))
    found, notes = detectors.ContractDetector(now).detect(tables)
    assert rows(found, "severity", "line") == [("breaking", 2)]  # the removal is reported once, as a call that is gone
    assert rows(notes) == []
    # a call that no claim covers is still reached by the change itself
    tables["calls"] = frame(CALLS, call(2, "/a/gone"))
    found, _ = detectors.ContractDetector(now).detect(tables)
    assert rows(found, "severity", "line", "pkg") == [("breaking", None, "h.io")]


def test_vulnerabilities_as_findings(spark):
    from fleetdrift import catalog

    catalog.load_all()
    found = catalog.QUERIES["vulnerability_detector"](spark, "/root/testdata/sf0.001")
    plain = catalog.QUERIES["vulnerability_report"](spark, "/root/testdata/sf0.001")
    assert found.count() == plain.count() > 0 and found.filter("guidance IS NULL").isEmpty()


def test_modules_are_looked_up_once_each(frame, rows):
    modules = frame("repo string, module string", *[(f"r{i % 50}", ("lib.a.b", "lib", "libs.a", "other.lib")[i % 4]) for i in range(1000)])
    roots = frame("pkg string, root string", ("p", "lib"), ("p", "lib.a"), ("q", "lib.a.b"))
    assert rows(locate.packages_of_modules(modules, roots)) == [("lib", "p"), ("lib.a.b", "p"), ("lib.a.b", "q")]
    assert locate.with_packages(modules, roots).count() == 750  # none twice for two roots of one package
    assert locate.rooted(modules, roots).count() == modules.filter("module <> 'other.lib' AND module <> 'libs.a'").distinct().count() + 25


def test_spellings_are_looked_up_once(spark, frame, rows):
    """Prefixes of a chain are formed per distinct spelling: references themselves are not multiplied by the length of their chain."""
    references = spark.range(400).selectExpr("'r' AS repo", "'f' AS file", "CAST(id AS INT) AS line", "1 AS col", "if(id % 2 = 0, 'n', 's') AS local", "array('A', 'b', 'c') AS chain")
    bindings = frame("repo string, file string, local string, pkg string, export string", ("r", "f", "n", "p", "E"), ("r", "f", "s", "p", "*"))
    wanted = frame("pkg string, symbol string", ("p", "E.A"), ("p", "Canon"), ("p", "A.b.c"), ("p", "E.A.b"), ("q", "A"))
    aliases = frame("pkg string, spelling string, canonical string", ("p", "A", "Canon"), ("p", "E.A.b", "gone"), ("p", "A.b", "Canon"))
    found = locate.binding_sites(references, bindings, wanted, aliases)
    want = [("A.b.c", line) for line in range(1, 400, 2)] + [("Canon", line) for line in range(1, 400, 2)] + [("E.A", line) for line in range(0, 400, 2)]
    assert rows(found, "symbol", "line") == sorted(want, key=repr)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(locate.binding_sites(references, bindings, wanted).filter("line < 2"), "symbol", "line") == [("A.b.c", 1), ("E.A", 0), ("E.A.b", 0)]


def test_python_calls_meet_their_file_once(frame, rows):
    """Random files against the rules read one by one; calls and imports are shuffled once each, by repository and file."""
    rng = random.Random(11)
    modules, locals_, files = ("lib", "lib.a", "two.x", "other", None), ("a", "b", "c", "d", None), [("r", f"{i}.py") for i in range(40)] + [(None, "n.py")]
    pick = lambda n, make: [(*rng.choice(files), *make()) for _ in range(n)]
    calls = pick(600, lambda: (rng.randrange(30), 1, rng.choice(("name", "attribute")), rng.choice(locals_), rng.choice((None, None, *modules))))
    names = pick(120, lambda: (rng.choice(locals_), rng.choice(modules), rng.choice(("a", "b", "x", None))))
    stars, referenced = pick(25, lambda: (rng.choice(modules),)), pick(60, lambda: (rng.choice(modules),))
    roots = {("p", "lib"), ("q", "two"), ("both", "lib.a")}
    symbols = {("p", "a"), ("p", "x"), ("q", "b"), ("both", "c"), ("p", "K.a"), ("p", "Z.a"), ("q", "K.d"), ("both", "K.d.e")}
    under = lambda m: {p for p, root in roots if m and (m == root or m.startswith(f"{root}."))}
    methods = {}
    for p, s in sorted(symbols):
        if "." in s:
            methods[p, s.split(".", 1)[1]] = s
    want = set()
    for repo, file, line, col, form, name, receiver in calls:
        here = lambda table: [x for x in table if repo and x[:2] == (repo, file)]
        own = [(p, x[4]) for x in here(names) if name and x[2] == name for p in under(x[3])]
        hits = set()
        if form == "name":
            hits = set(own) | {(p, name) for x in here(stars) for p in under(x[2]) if p not in {q for q, _ in own}}
        elif receiver:
            hits = {(p, name) for p in under(receiver)}
        hits = {h for h in hits if h in symbols and "." not in h[1]}
        if form == "attribute" and not receiver:
            hits = {(p, methods[p, name]) for x in here(referenced) for p in under(x[2]) if (p, name) in methods}
        want |= {(repo, p, s, file, line, col) for p, s in hits}
    file = "repo string, file string, "
    tables = [
        frame(file + "line int, col int, form string, name string, receiver_module string", *calls),
        frame(file + "local string, module string, exported string", *names),
        *(frame(file + "module string", *x) for x in (stars, referenced)),
    ]
    got = locate.python_sites(*tables, frame("pkg string, root string", *roots), frame("pkg string, symbol string", *symbols))
    assert rows(got) == sorted(want, key=repr) and len(want) > 100
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(repo#") == 2 and plan.count("Exchange hashpartitioning(") == 3  # and the names of methods
