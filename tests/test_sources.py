import random

import pytest
from pyspark.sql import functions as F

from fleetdrift.operators import pinning, quality
from fleetdrift.session import Rounds
from fleetdrift.plans import ecosystems
from fleetdrift.sources import callscan, imports, lockfiles, logs, pins, requirements, symbols
from fleetdrift.sources import files as file_source

FILE = "repo string, file string, content string"


def test_yarn_lock(frame, rows):
    text = '# c\n\n__metadata:\n  version: 6\n\n"@a/b@^1", "c@npm:2":\n  version "1.2.3"\n  version "9"\n\nc@3:\n  version 3.0.0\n\n"w@workspace:.":\n  version 0.0.0\n'
    assert rows(lockfiles.yarn_lock(frame(FILE, ("r", "yarn.lock", text))), "name", "version", "line") == [("@a/b", "1.2.3", 6), ("c", "1.2.3", 6)]


def test_pnpm_and_toml_and_bun(frame, rows):
    pnpm = "importers:\n  x@9.9.9:\npackages:\n  /left/1.0.0(p@2):\n    y: 1\n  'right@2.0.0':\n  right@3.0.0:\n  bad@latest:\n"
    assert rows(lockfiles.pnpm_lock(frame(FILE, ("r", "p", pnpm))), "name", "version", "line") == [("left", "1.0.0", 4), ("right", "2.0.0", 6)]
    toml = '[[package]]\nname = "a"\nversion = "1"\n\n[[package]]\nversion = "0"\nname = "b"\n  version = "2"\n[metadata]\nname = "c"\nversion = "3"\n'
    assert rows(lockfiles.toml_lock(frame(FILE, ("r", "uv.lock", toml))), "name", "version") == [("a", "1"), ("b", "2")]
    bun = '{\n "packages": {\n  "a": ["a@1.0.0", {},],\n  "b": "@s/b@2.0.0",\n  "c": ["c@git", ],\n },\n}'
    assert rows(lockfiles.bun_lock(frame(FILE, ("r", "bun.lock", bun))), "name", "version", "line") == [("@s/b", "2.0.0", 4), ("a", "1.0.0", 3)]


def test_npm_lock(frame, rows):
    text = """{"packages":{"":{"version":"1"},"node_modules/a":{"version":"1.0.0","dev":true},"node_modules/@s/b":{"version":"2.0.0","dependencies":{"a":"*"}},
      "node_modules/a/node_modules/c":{"version":"3.0.0"},"node_modules/l":{"version":"1","link":true},"node_modules/g":{"version":"1","resolved":"git+x"}}}"""
    got = rows(lockfiles.npm_lock(frame(FILE, ("r", "package-lock.json", text))), "name", "version", "dev", "top_name")
    assert got == [("@s/b", "2.0.0", False, "@s/b"), ("a", "1.0.0", True, "a"), ("c", "3.0.0", False, None)]
    assert rows(lockfiles.npm_edges(frame(FILE, ("r", "package-lock.json", text)))) == [("r", "@s/b", "a")]


def test_unreadable_lockfile_is_unsupported(frame, rows):
    df = frame(FILE, ("r", "yarn.lock", "<<<<<<< x"), ("s", "yarn.lock", " \n"))
    assert rows(lockfiles.lockfile_status(df, lockfiles.yarn_lock(df)), "repo", "status") == [("r", "unsupported"), ("s", "read")]


def test_lockfiles_are_read_without_a_shuffle(frame, rows):
    """The first entry of a name is found inside the file's row, also where names repeat; no entry meets those of other files."""
    yarn = 'a@^1, a@^2, b@1:\n  version "1.0.0"\n\na@^3:\n  version "2.0.0"\n'
    pnpm = "packages:\n  b@2.0.0:\n  a@1.0.0:\n  b@1.0.0:\n"
    toml = '[[package]]\nname = "a"\nversion = "2"\nname = "a"\nversion = "1"\n[[package]]\nname = "a"\nversion = "0"\n'
    bun = '{\n"packages": {\n"x": "a@1.0.0",\n"a": ["a@2.0.0"],\n"z": "a@1.0.0",\n"y": "b@1.0.0"\n}}'
    pip = '{"default": {"a": {"version": "==1"}}, "develop": {"a": {"version": "==2"}, "b": {"version": ">=3"}}}'
    texts = {lockfiles.yarn_lock: yarn, lockfiles.pnpm_lock: pnpm, lockfiles.toml_lock: toml, lockfiles.bun_lock: bun, lockfiles.pipfile_lock: pip}
    want = {
        lockfiles.yarn_lock: [("a", "1.0.0", 1), ("b", "1.0.0", 1)],
        lockfiles.pnpm_lock: [("a", "1.0.0", 3), ("b", "2.0.0", 2)],
        lockfiles.toml_lock: [("a", "2", 1)],
        lockfiles.bun_lock: [("a", "1.0.0", 3), ("b", "1.0.0", 6)],
        lockfiles.pipfile_lock: [("a", "1")],
    }
    for read, text in texts.items():
        found = read(frame(FILE, ("r", "f", text), ("s", "f", text), ("t", "f", "")))
        kept = [c for c in ("name", "version", "line") if c in found.columns]
        assert rows(found.filter("repo = 'r'"), *kept) == want[read], read.__name__
        assert found.filter("repo = 's'").count() == len(want[read]) and found.filter("repo = 't'").isEmpty()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not any(node in plan for node in ("Exchange", "Aggregate", "Sort ", "Join")), read.__name__


def test_requirements(frame, rows):
    text = "a==1.0 # c\nb[x]>=2 ; python_version<'3'\nc==1.*\nd === 4 \\\n  --hash=sha256:q\n-r more.txt\nA.b==9\na==2\n"
    got = rows(requirements.requirements(frame(FILE, ("r", "requirements.txt", text))), "name", "version", "declared")
    assert got == sorted([("a", "1.0", None), ("b", None, ">=2"), ("c", None, "==1.*"), ("d", "4", None), ("A.b", "9", None)], key=repr)


def test_include_tree_is_depth_first_and_visits_once(frame, rows):
    files = frame(
        FILE,
        ("r", "requirements.txt", "top==1\n-r a.txt\n-r sub/b.txt\n-c limits.txt\nloose\n"),
        ("r", "a.txt", "dup==1\n-r sub/b.txt\n-r ../outside.txt\n"),
        ("r", "sub/b.txt", "DUP==2\nonly-b==3\n-r ../requirements.txt\n"),
        ("r", "limits.txt", "loose==7\ntop==9\n"),
    )
    assert rows(requirements.include_tree(files), "file", "walk", "as_constraints") == sorted(
        [("requirements.txt", [], False), ("a.txt", [1], False), ("sub/b.txt", [1, 1], False), ("limits.txt", [3], True)], key=repr
    )
    got = rows(requirements.requirements_tree(files), "name", "version", "declared")
    assert got == sorted([("top", "1", None), ("dup", "1", None), ("only-b", "3", None), ("loose", "7", None)], key=repr)


def test_include_tree_in_rows_and_in_rounds(spark, frame, rows, monkeypatch):
    """Random include graphs with cycles; a long chain takes no round per file."""
    rng = random.Random(5)
    texts = []
    for repo in range(12):
        for f in ["requirements.txt", *(f"{i}.txt" for i in range(9))]:
            named = [f"{rng.choice(('-r', '-c'))} {rng.randrange(9)}.txt" for _ in range(rng.randrange(4))]
            texts.append((f"g{repo}", f, "\n".join(named)))
    texts.append(("alone", "requirements.txt", "x==1"))
    texts.append(("unrooted", "0.txt", "-r 0.txt"))
    columns = ("repo", "file", "walk", "as_constraints")
    files = frame("repo string, file string, content string", *texts)
    in_rounds = rows(requirements.include_tree(files, inside=0), *columns)
    calls = []
    monkeypatch.setattr(Rounds, "add", lambda self, df, add=Rounds.add: calls.append(1) or add(self, df))
    assert rows(requirements.include_tree(files), *columns) == in_rounds
    assert rows(requirements.include_tree(files, inside=6), *columns) == in_rounds
    calls.clear()
    chain = [("c", "requirements.txt", "".join(f"-r {i}.txt\n" for i in range(30))), *(("c", f"{i}.txt", f"-r {i + 1}.txt") for i in range(30))]
    got = requirements.include_tree(frame("repo string, file string, content string", *chain))
    assert {r.file: len(r.walk) for r in got.collect()} == {"requirements.txt": 0, **{f"{i}.txt": i + 1 for i in range(30)}}
    assert len(calls) == 0  # one round per file before


def test_targets_are_folded_once(frame, rows):
    given = [("a/b.txt", "c.txt"), ("a/b.txt", "../c.txt"), ("a/b.txt", "./d//e.txt"), ("b.txt", "../c.txt"), ("b.txt", "/c.txt"), ("b.txt", "c/"), ("b.txt", "...x"), ("a/b.txt", "../../c"), ("./b.txt", "c")]
    paths = frame("file string, target string", *given).select("file", "target", requirements.resolve_target(F.col("file"), F.col("target")).alias("path"))
    want = ["a/c.txt", "c.txt", "a/d/e.txt", None, None, "c", "...x", None, "c"]
    assert rows(paths) == sorted(((*g, w) for g, w in zip(given, want)), key=repr)
    plan = paths._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_pins(frame, rows):
    df = frame(
        FILE,
        ("r", "Dockerfile", "FROM node:18-slim\nFROM node:latest\n\n\n\nFROM mcr.io/playwright:v1.62.1-jammy"),
        ("r", ".nvmrc", "v22\n"),
        ("r", ".github/workflows/ci.yml", "    node-version: 20"),
        ("r", "package.json", '{\n "engines": {"node": ">=22"}\n}'),
        ("r", "src/a.ts", "const h = { 'stripe-version': '2023-10-16' };\nconst x = { 'api-version': 'v2' };"),
    )
    found = pins.extract_pins(df)
    assert rows(found, "line", "subject", "version", "kind") == sorted([
        (1, "node", "18", "node-version"), (6, "playwright", "1.62.1", "docker-image"), (1, "node", "22", "node-version"), (1, "node", "20", "node-version"),
        (2, "node", "22", "node-version"), (1, "stripe", "2023-10-16", "api-version"),
    ], key=repr)
    installed = frame("repo string, name string, installed string", ("r", "playwright", "1.60.0"))
    conflicts = pinning.pin_conflicts(found, installed)
    assert rows(conflicts, "subject", "expected", "version") == sorted([("playwright", "1.60.0", "1.62.1"), ("node", "22", "18"), ("node", "22", "20")], key=repr)
    assert ("mcr.io/playwright:v1.60.0-jammy",) in rows(pinning.repairs(conflicts), "replace")


def test_dated_versions(frame, rows):
    df = frame("a string, b string", ("2023-01-01", "2024-01-01.x"), ("2024-01-01", "2024-01-01"), ("v1", "2024-01-01"))
    assert rows(df, pinning.behind_current(F.col("a"), F.col("b"))) == sorted([(True,), (False,), (None,)], key=repr)


def test_diagnostics(frame, rows):
    out = "src/a.ts(1,2): error TS1: x\n  src/a.ts:1:2: error y\nb.ts:3:4: error z\nc.ts:1:1: warning\n"
    runs = frame("runner string, stdout string, stderr string, skipped boolean", ("npm", out, out, False), ("python", "m.py:3: error: q\nm.py:3:9: error: r\n", "", False), ("npm", out, "", True), ("cargo", out, "", False))
    assert rows(logs.diagnostics(runs), "runner", "skipped", "n_errors") == sorted([("npm", False, 2), ("python", False, 1), ("npm", True, None), ("cargo", False, None)], key=repr)


def test_review_findings(frame, rows):
    good = '{"severity":"size","file":"f","what":"w","why":""}'
    bad = '{"severity":"mood","file":"f","what":"w","why":""}'
    texts = [f'x {{"findings": [{good}, {bad}]}} y', f'{{"findings": [{good}]}} {{"findings": []}}', f'{{"findings": [{bad}]}}', "none", f'{{"findings": [{good}]}} {{"findings": [oops] }}']
    df = frame("k int, log string", *enumerate(texts))
    found = logs.review_findings(F.col("log"))
    assert rows(df, "k", F.when(found.isNotNull(), F.size(found))) == [(0, 1), (1, 0), (2, None), (3, None), (4, 1)]


@pytest.mark.parametrize(
    "text",
    ["const re = /'/; import y from 'z'", "<p>Don't</p>; require('z')", "<p>a ` in a tag</p>\nimport y from 'z'", "const q = a / b; import 'z'", "x = `t`; import {a} from'z'"],
)
def test_imports_after_quotes_that_open_no_string(text):
    assert [module for _, module in callscan.scan_imports(text)] == ["z"]


def test_imports(frame, rows):
    text = "import a from 'a/x';\nimport { type B as C, D } from \"@s/b\";\nconst z = require('z');\nimport './local';\nimport 'node:fs';\n"
    df = frame(FILE, ("r", "f.ts", text))
    assert rows(imports.import_sites(df), "line", "pkg") == [(1, "a"), (2, "@s/b"), (3, "z")]
    text = """// import c from 'comment';
/* const d = require("comment") */
import {
  x, // one of "them"
  type y as Y,
} from "p4/deep";
import D, * as all from 'p5'; const s = "import q from 'text'", r = require( 'p6' );
export { z } from "p7";
import type { T } from
  '@s/p8';
foo.require('p9'); import"p10"; import(`p11`);
"""
    assert sorted(rows(imports.import_sites(frame(FILE, ("r", "f.ts", text))), "line", "pkg")) == [(3, "p4"), (7, "p5"), (7, "p6"), (9, "@s/p8"), (11, "p10")]
    assert rows(imports.named_imports(df), "pkg", "name") == [("@s/b", "B"), ("@s/b", "D")]
    py = frame(FILE, ("r", "f.py", "import a.b as c, d  # x\n  from e.f import g\nfrom . import h\n"))
    assert rows(imports.python_imports(py), "line", "module") == [(1, "a.b"), (1, "d"), (2, "e.f")]


def test_module_merge_and_roots(frame, rows):
    schema = "pkg string, version string, file string, pos int, path string, kind string, signature string, exported array<string>"
    df = frame(schema, ("p", "1", "b.py", 1, "f", "function", "late", None), ("p", "1", "a.py", 9, "f", "function", "early", None), ("p", "1", "a.py", 1, "_h", "function", "x", None), ("p", "1", "c.py", 1, "_k", "function", "y", ["_k"]))
    assert rows(symbols.merge_modules(df), "path", "signature") == [("_k", "y"), ("f", "late")]
    tree = frame("pkg string, path string", ("p", "lib/__init__.py"), ("p", "lib/x/__init__.py"), ("p", "lib/x/y.py"), ("p", "src/solo.py"), ("p", "six.py"))
    assert rows(symbols.import_roots(tree), "root") == [("lib",), ("six",), ("src.solo",)]


def test_files_on_disk(spark, tmp_path, rows):
    for name, text in (("one/src/a.ts", "x"), ("one/node_modules/b.ts", "y"), ("two/c.py", "z"), ("two/readme.md", "w")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    tree = file_source.read_tree(spark, str(tmp_path))
    assert rows(file_source.source_files(tree), "repo", "file", "content") == [("one", "src/a.ts", "x"), ("two", "c.py", "z")]


def test_walked_files(frame, rows):
    kept = ["a.ts", "x/run.sh", "api.Dockerfile", "Containerfile", "env/a.py", "b/env/c.py"]
    left = ["build/a.ts", "x/.next/a.js", "venv/a.py", "c/site-packages/a.py", "a.md", "v/env/lib/a.py", "v/env/env/x.py"]
    tree = frame("repo string, file string", *[("r", f) for f in [*kept, *left, "v/env/pyvenv.cfg"]], ("q", "v/env/a.py"))
    assert sorted(rows(file_source.source_files(tree))) == sorted([*[("r", f) for f in kept], ("q", "v/env/a.py")])


def test_any_pattern_is_answered(frame):
    fires = [r"\0", r"\N{DIGIT ONE}", r"\p{Lu}+", r"foo\Z", "(?<name>f)oo", r"a{2}", "{x", r"[[]", "a&&b"]
    quiet = [r"foo\Zbar", "a{3}", "x{2,}z", "x{,3}z", r"bar\Z"]
    bad = ["(unclosed", "a{4294967296}", "*a", "(?P<n>a)", "[z-a]", r"\N{NO SUCH NAME}"]
    text = "\0 1 A xz {x [ aa a&&b\nfoo"
    checks = [("r", p, "absent", p, None, None) for p in [*fires, *quiet, *bad]]
    found = quality.resolve_checks(
        frame("repo string, check_id string, kind string, pattern string, symbol string, pkg string", *checks),
        frame("repo string, file string, content string", ("r", "f", text), ("r", "g", "foo\n")),
    )
    states = {r.check_id: r.state for r in found.collect()}
    assert states == {**dict.fromkeys(fires, "unresolved"), **dict.fromkeys(quiet, "resolved"), **dict.fromkeys(bad, "unknown")}


def test_checks_go_to_the_texts(spark, frame, rows):
    """A repository that holds most of the text is no single task: only names and counts are shuffled, never a text."""
    checks = frame("repo string, check_id string, kind string, pattern string, symbol string, pkg string", ("hot", "a", "absent", "old", None, None), ("cold", "b", "absent", "[", None, None))
    files = spark.range(5000).selectExpr("if(id % 100 = 0, 'cold', 'hot') AS repo", "'f' || id AS file", "if(id % 2 = 0, 'old', 'new') AS content")
    found = quality.resolve_checks(checks, files)
    assert rows(found, "repo", "check_id", "state", "n_files") == [("cold", "b", "unknown", 0), ("hot", "a", "unresolved", 2450)]
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # below the size of the texts
    try:
        nodes = quality.resolve_checks(checks, files)._jdf.queryExecution().explainString(mode).split("\n\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = [n for n in nodes if ") Exchange" in n and "Input" in n]
    assert shuffled and not any("content#" in n for n in shuffled)


def test_completeness_checks(frame, rows):
    schema = "repo string, check_id string, kind string, pattern string, symbol string, pkg string"
    checks = frame(schema, ("r", "hit", "absent", "old\\(", None, None), ("r", "miss", "absent", "zzz", None, None), ("r", "bad", "absent", "(", None, None), ("r", "imp", "import", None, "A", "lib"), ("none", "x", "absent", "a", None, None))
    odd = ("foo {", "a{,2}", "[&&x]y", "x{2}", "(?#c)old", "(?P<n>old)")
    checks = checks.unionByName(frame(schema, *[("r", p, "absent", p, None, None) for p in odd]))
    files = frame(FILE, ("r", "a.ts", "old(1)\nimport { A } from 'lib'; foo { &y"), ("r", "b.ts", "new()"))
    assert dict(rows(quality.resolve_checks(checks, files), "check_id", "state")) == {"hit": "unresolved", "miss": "resolved", "bad": "unknown", "imp": "unresolved", "x": "unknown",
        "foo {": "unresolved", "a{,2}": "resolved", "[&&x]y": "unresolved", "x{2}": "resolved", "(?#c)old": "unknown", "(?P<n>old)": "unknown"}


def test_long_texts_are_whole(frame, rows):
    from fleetdrift.functions import signatures

    long = "(" + "a: string, " * 1000 + "b: number) => void"
    df = frame("k int, text string", (0, long + "x"), (1, long + "y"))
    assert sorted(rows(df, signatures.normalise_signature(F.col("text")))) == [(long + "x",), (long + "y",)]
    error = "e" * 5000
    assert rows(frame("log string", (f'{{"type":"error","error":"{error}"}}',)), logs.session_error(F.col("log"))) == [(error,)]
    body = '{"openapi":"3.1.0","info":{"title":"' + "t" * (17 << 20) + '"},"paths":{}}'
    from fleetdrift.sources import apispecs

    assert rows(frame("body string", (body,)), apispecs.is_spec(F.col("body"))) == [(True,)]


def test_option_belongs_to_the_nearest_imported_constructor(frame, rows):
    text = "import Stripe from 'stripe';\nimport { Other } from './own';\nconst c = new Stripe({\n" + "  // more\n" * 30 + "  x: new Other({}), apiVersion: '2024-06-20." + "a" * 60 + "',\n});\n"
    found = pins.extract_pins(frame(FILE, ("r", "a.ts", text)))
    assert rows(found, "line", "subject", "version") == [(34, "stripe", "2024-06-20." + "a" * 60)]


def test_inventories_take_one_pass_over_the_texts(spark, frame, rows):
    """Which file answers, what requirements include, and packages installed under several paths."""
    npm = '{"packages":{"":{"version":"1"},"node_modules/a":{"version":"1.0"},"node_modules/b/node_modules/a":{"version":"1.0"},"node_modules/c/node_modules/a":{"version":"2.0"}}}'
    uv = '[[package]]\nname = "u"\nversion = "3.0"\n'
    texts = [
        ("both", "package-lock.json", npm), ("both", "yarn.lock", "y@^1:\n  version 1.1\n"), ("both", "uv.lock", uv), ("both", "requirements.txt", "r==1\n-r more.txt\n"), ("both", "more.txt", "m==1\n"),
        ("loose", "yarn.lock", "y@^1:\n  version 1.1\n"), ("loose", "requirements.txt", "r==1\nopen>=2\n -r sub/a.txt # c\n\\\n-c ./limits.txt\n"), ("loose", "sub/a.txt", "--requirement=../yarn.lock\ns==4\n"),
        ("loose", "limits.txt", "open==2.5\n"), ("loose", "unread.txt", "-r also-unread.txt\nx==1\n"), ("loose", "also-unread.txt", "z==1\n"),
        ("unreadable", "package-lock.json", "{"), ("unreadable", "yarn.lock", "y@^1:\n  version 1.1\n"), ("unreadable", "poetry.lock", "?"), ("unreadable", "requirements.txt", "r==1\n"),
        ("twice", "uv.lock", uv), ("twice", "uv.lock", uv + uv.replace('"u"', '"v"')), (None, "uv.lock", uv), ("none", "a.txt", "-r b.txt\n"), ("empty", "yarn.lock", None),
    ]
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda text: read.add(1) or text, "string").asNondeterministic()
    files = frame("repo string, file string, content string", *texts).withColumn("content", seen("content"))
    got = rows(ecosystems.installed(files), "repo", "ecosystem", "name", "version", "file")
    assert got == sorted(
        [
            ("both", "npm", "a", "1.0", "package-lock.json"), ("both", "npm", "a", "2.0", "package-lock.json"), ("both", "PyPI", "u", "3.0", "uv.lock"),
            ("loose", "npm", "y", "1.1", "yarn.lock"), ("loose", "PyPI", "r", "1", "requirements.txt"), ("loose", "PyPI", "s", "4", "requirements.txt"), ("loose", "PyPI", "open", "2.5", "requirements.txt"),
            ("twice", "PyPI", "u", "3.0", "uv.lock"), ("twice", "PyPI", "v", "3.0", "uv.lock"),
        ],
        key=repr,
    )
    assert read.value <= len(texts)  # each text was made many times before
