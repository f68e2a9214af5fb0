import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from fleetdrift.functions import urls
from fleetdrift.operators import contracts
from fleetdrift.sources import apispecs, httpcalls

CALL = "repo string, host string, method string, route string"


def same(call, spec, spans):
    """Brute force over all ways a call can run along a template."""
    templated = lambda s: re.fullmatch(r"\{.*\}", s) is not None

    def run(a, b):
        if not a or not b:
            return not a and not b
        if a[0] == "{}":
            n = len(list(itertools.takewhile(templated, b)))
            return any(run(a[1:], b[k:]) for k in range(1, n + 1))
        if templated(b[0]):
            return True if spans and len(b) == 1 else run(a[1:], b[1:])
        return a[0] == b[0] and run(a[1:], b[1:])

    return run(call.split("/"), spec.split("/"))


def test_random_routes_against_brute_force(frame):
    rnd = random.Random(11)
    route = lambda parts, n: "/" + "/".join(rnd.choice(parts) for _ in range(rnd.randrange(1, n)))
    calls = sorted({route(["a", "b", "c", "{}", "x{}"], 6) for _ in range(150)})
    specs = sorted({route(["a", "b", "{id}", "{name}"], 6) for _ in range(60)})
    spans = {s: rnd.random() < 0.5 for s in specs}
    got = contracts.match_routes(
        frame("host string, method string, route string", *[("h", "GET", c) for c in calls]),
        frame("host string, method string, route string, spans boolean", *[("h", "GET", s, spans[s]) for s in specs]),
        ["host"],
    )
    expect = {(c, s) for c in calls for s in specs if same(c, s, spans[s])}
    assert {(r.call_route, r.route) for r in got.collect()} == expect
    assert len(expect) > 50


def test_many_runtime_segments_are_walked_once(frame):
    import time

    call = "/v1" + "/{}" * 20 + "/end"
    specs = ["/v1" + "/{p}" * n + "/end" for n in range(15, 40)] + ["/v1" + "/{p}" * 30 + "/other", "/{p}" * 30]
    got = contracts.match_routes(
        frame("host string, method string, route string", ("h", "GET", call)),
        frame("host string, method string, route string, spans boolean", *[("h", "GET", s, True) for s in specs]),
        ["host"],
    )
    start = time.perf_counter()
    assert {r.route for r in got.collect()} == {s for s in specs if s.endswith("/end") and s.count("{p}") >= 20} | {"/{p}" * 30}
    assert time.perf_counter() - start < 30


def outcome(frame, operations, *routes):
    ops = frame("host string, method string, route string", *[("h", *o.split(" ")) for o in operations])
    described = contracts.described_endpoints(ops, frame("host string, base string", ("h", "")), ["host"])
    calls = frame(CALL, *[("r", "h", *c.split(" ")) for c in routes])
    return {f"{r.method} {r.route}": r.outcome for r in contracts.check_calls(calls, described).collect()}


@pytest.mark.parametrize(
    "operations, calls, expect",
    [
        (["POST /v1/charges", "GET /v1/charges/{charge}"], ["POST /v1/charges", "GET /v1/charges/{}"], ["matched", "matched"]),
        (["GET /git/ref/{ref}"], ["GET /git/ref/heads/{}", "GET /git/refs/heads"], ["matched", "gone"]),
        (["GET /o/{repo}", "GET /o/{repo}/x"], ["GET /o/a", "GET /o/a/b/c"], ["matched", "gone"]),
        (["GET /r/{owner}/{repo}/pulls"], ["GET /r/{}/pulls", "GET /r/{}/issues"], ["matched", "gone"]),
        (["GET /a/b", "GET /a/c"], ["GET /a/b", "GET /a/{}"], ["matched", "gone"]),
        (["GET /a/{x}"], ["GET /z/1"], ["not-aligned"]),
        (["GET /a/{x}"], ["GET /a/1", "GET /z/1"], ["matched", "uncovered"]),
    ],
)
def test_contract_cases(frame, operations, calls, expect):
    assert outcome(frame, operations, *calls) == dict(zip(calls, expect))


SPEC = """{"openapi":"3.0.0","paths":{"/a":{"$ref":"#/components/pathItems/A"},"/b":{"post":{"parameters":[{"name":"q","required":true},
 {"$ref":"#/components/parameters/loop"},{"$ref":"other.json#/x"}]},"summary":"no method"}},
 "components":{"pathItems":{"A":{"get":{"deprecated":true,"parameters":[{"$ref":"#/components/parameters/one"}]}}},
 "parameters":{"one":{"$ref":"#/components/parameters/t~1wo"},"t/wo":{"name":"page","in":"query","schema":{"$ref":"#/components/schemas/S"}},
 "loop":{"$ref":"#/components/parameters/loop"}},"schemas":{"S":{"type":"integer"}}}}"""


def test_spec_references_are_followed(frame, rows):
    read = apispecs.read_operations(frame("vendor string, body string", ("v", SPEC), ("w", "<html>")), ["vendor"])
    assert rows(apispecs.operations(read, ["vendor"])) == [("v", "GET", "/a", True), ("v", "POST", "/b", False)]
    assert rows(apispecs.operation_params(read, ["vendor"]), "route", "name", "location", "required", "type") == [
        ("/a", "page", "query", False, "integer"), ("/b", "q", "query", True, "unknown"),
    ]


def test_many_references_in_one_document(frame, rows):
    import json

    n = 5000
    parameters = {f"p{k}": {"$ref": f"#/components/parameters/p{k + 1}"} if k % 50 else {"name": f"n{k}", "schema": {"$ref": f"#/components/schemas/s{k}"}} for k in range(n)}
    parameters["x/y"] = {"name": "slash", "schema": {"type": "boolean"}}
    paths = {f"/r{k}": {"get": {"parameters": [{"$ref": f"#/components/parameters/p{k}"}]}} for k in range(0, n, 10)}
    paths["/deep"] = {"get": {"parameters": [{"$ref": "#/paths/~1other/post/parameters/1"}, {"$ref": "#/components/parameters/x~1y"}, {"$ref": "#/components/parameters/none"}]}}
    paths["/other"] = {"post": {"parameters": [{"name": "a"}, {"name": "b", "in": "header"}]}}
    body = {"openapi": "3.0.0", "paths": paths, "components": {"parameters": parameters, "schemas": {f"s{k}": {"type": "integer"} for k in range(0, n, 50)}}}
    read = apispecs.read_operations(frame("vendor string, body string", ("v", json.dumps(body))), ["vendor"])
    found = rows(apispecs.operation_params(read, ["vendor"]), "route", "name", "location", "type")
    chained = [(f"/r{k}", f"n{-(-k // 50) * 50}", "query", "integer") for k in range(0, n, 10) if -(-k // 50) * 50 < n]
    assert found == sorted([*chained, ("/deep", "b", "header", "unknown"), ("/deep", "slash", "query", "boolean"), ("/other", "a", "query", "unknown"), ("/other", "b", "header", "unknown")], key=repr)


OPS = "vendor string, method string, route string, deprecated boolean"
PARAMS = "vendor string, method string, route string, name string, location string, required boolean, type string"


def test_spec_diff_rules(frame, rows):
    old = frame(OPS, ("v", "GET", "/a", False), ("v", "GET", "/gone", False), ("v", "GET", "/d", True))
    new = frame(OPS, ("v", "GET", "/a", True), ("v", "GET", "/new", False), ("v", "GET", "/d", True))
    op = frame(PARAMS, ("v", "GET", "/a", "p", "query", False, "string"), ("v", "GET", "/a", "q", "query", False, "unknown"), ("v", "GET", "/gone", "z", "query", True, "string"))
    np = frame(PARAMS, ("v", "GET", "/a", "p", "query", True, "integer"), ("v", "GET", "/a", "q", "query", False, "string"), ("v", "GET", "/a", "n", "query", False, "string"))
    got = rows(contracts.diff_specs(old, new, op, np), "path", "kind", "severity")
    assert got == sorted([
        ("GET /a", "deprecated", "deprecation"), ("GET /gone", "removed", "breaking"), ("GET /new", "added", "feature"),
        ("GET /a query:p", "signature-changed", "breaking"), ("GET /a query:p", "signature-changed", "breaking"), ("GET /a query:n", "added", "feature"),
    ], key=repr)
    assert rows(contracts.diff_specs(old, old, op, op)) == []


def test_http_calls_in_source(frame):
    text = """import { ROOT as R } from './c';
const LOCAL = "https://local.dev";
fetch(`${LOCAL}/a/${id}`, { method: 'POST' });
  axios.get(`${R}//b?x=1&y=${z}`);
got(url);
request({
  method: "DELETE",
  url: "https://h.io/c",
  query: { limit: 1, cursor },
});
request({ url: "https://h.io/d", method: verb });
ky("https://h.io/e" + tail);
other("https://h.io/f");
"""
    files = frame("repo string, file string, content string", ("r", "a.ts", text), ("r", "c.ts", 'export const ROOT = "https://root.dev";'))
    calls = [(r.line, r.method, r.host, r.route, sorted(r.params), r.reason and r.reason.split(",")[0]) for r in httpcalls.http_calls(files).orderBy("line").collect()]
    assert calls == [
        (3, "POST", "local.dev", "/a/{}", [], None),
        (4, "GET", "root.dev", "/b", ["x", "y"], None),
        (5, "GET", None, None, [], "the URL is not a literal"),
        (6, "DELETE", "h.io", "/c", ["cursor", "limit"], None),
        (11, "GET", None, None, [], "the request method is decided at runtime"),
        (12, "GET", None, None, [], "the URL is not a literal"),
    ]


def test_http_calls_in_ordinary_source(frame):
    text = """// fetch("https://comment.io/a")
/* axios.get("https://comment.io/b") */
const s = 'fetch("https://string.io/c")';
fetch("https://a.com/x", { method: "POST", body: JSON.stringify({ a: 1, b: { c: [2, ")"] } }) });
fetch("https://a.com/y", { headers: { a: { b: { c: 1 } } }, method: 'PATCH' });
axios({ method: "put", url: "https://a.com/w", data: build({ k: 1 }, () => { return fetch("https://a.com/inner"); }) });
axios<Array<T>>("https://a.com/t"); axios.post<T>("https://a.com/u", { a: 1 });
const ok = /["'(]/.test(x) && got("https://a.com/v");
client.send({ url: `https://a.com/z/${ids.map((i) => `${i}`).join(",")}`, method: "DELETE", params: { "page-size": 1, q } /* } */ });
fetch(/* the address */ "https://a.com/k", // options
  { method: "HEAD" });
fetch("https://a.com/open", { method: "POST"
"""
    files = frame("repo string, file string, content string", ("r", "a.ts", text))
    calls = [(r.line, r.col, r.method, r.route, r.params, r.resolved) for r in httpcalls.http_calls(files).orderBy("line", "col").collect()]
    assert calls == [
        (4, 1, "POST", "/x", [], True),
        (5, 1, "PATCH", "/y", [], True),
        (6, 1, "PUT", "/w", [], True),
        (6, 85, "GET", "/inner", [], True),
        (7, 1, "GET", "/t", [], True),
        (7, 37, "POST", "/u", [], True),
        (8, 31, "GET", "/v", [], True),
        (9, 1, "DELETE", "/z/{}", ["page-size", "q"], True),
        (10, 1, "HEAD", "/k", [], True),
        (12, 1, None, None, [], False),
    ]


def test_http_calls_among_tags(frame):
    text = """return <div><b>hi</b><button onClick={() => fetch("https://a.com/x")}>go</button></div>
<p>Don't {fetch('https://a.com/y')} stop</p>
const e = <A x={1}/>; got("https://a.com/z"); <B/>
const half = total / 2; const n = {a: 1}; fetch("https://a.com/w"); const r = a / b;
"""
    files = frame("repo string, file string, content string", ("r", "a.tsx", text))
    found = [(r.line, r.method, r.route, r.resolved) for r in httpcalls.http_calls(files).orderBy("line").collect()]
    assert found == [(1, "GET", "/x", True), (2, "GET", "/y", True), (3, "GET", "/z", True), (4, "GET", "/w", True)]


def test_no_verb_is_invented(frame):
    at_run_time = ["opts", "{ ...base }", "{ method }", "{ method: ok ? 'POST' : 'PUT' }", "build({ method: 'PUT' })", "{ headers: h, ...base }"]
    get = ["undefined", "{ headers: { ...h } }", "{}", "(e) => done(e)", "function (e) { return e; }", "{ note: '...' }"]
    post = ["{ ...base, method: 'POST' }", "{ method: Verb.Post }"]
    lines = [f'fetch("https://a.com/x", {o});' for o in [*at_run_time, *get, *post]] + ['axios("https://a.com/x", cfg);', 'axios.post("https://a.com/x", data);']
    files = frame("repo string, file string, content string", ("r", "a.ts", "\n".join(lines)))
    found = [r.method if r.resolved else r.reason for r in httpcalls.http_calls(files).orderBy("line").collect()]
    run_time = urls.RUNTIME_METHOD
    assert found == [run_time] * len(at_run_time) + ["GET"] * len(get) + ["POST"] * len(post) + [run_time, "POST"]


def test_best_description_keeps_the_earliest_of_equals(frame, rows):
    df = frame("vendor string, seq int, provenance string", ("v", 1, "community"), ("v", 2, "curated"), ("v", 3, "curated"))
    assert rows(contracts.best_descriptions(df), "seq") == [(2,)]


def test_plan_uses_hash_joins(frame):
    plan = contracts.match_routes(
        frame("host string, method string, route string", ("h", "GET", "/a")),
        frame("host string, method string, route string, spans boolean", ("h", "GET", "/a", False)),
        ["host"],
    )._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert F is not None
