import random

from fleetdrift.operators import gating
from fleetdrift.sources import diffs

HUNK = "id string, file string, start int, end int"
POINT = "id string, file string, line int"


def alike(a, b):
    return a == b or a.endswith("/" + b) or b.endswith("/" + a)


def test_anchors_against_brute_force(frame):
    rnd = random.Random(2)
    names = ["a.ts", "src/a.ts", "lib/src/a.ts", "b.ts", "src\\b.ts"]
    hunks = sorted({("d", rnd.choice(names), s, s + rnd.choice([0, 1, 5, 63, 64, 130])) for s in (rnd.randrange(0, 900) for _ in range(60))})
    points = sorted({("d", rnd.choice(names), rnd.randrange(0, 1000)) for _ in range(25)})
    for window in (0, 3, 70):
        got = gating.hunks_with_anchor(frame(HUNK, *hunks), frame(POINT, *points), window)
        slash = lambda p: p.replace("\\", "/")
        expect = {h for h in hunks if any(alike(slash(p[1]), slash(h[1])) and h[2] - window <= p[2] <= h[3] + window for p in points)}
        assert {tuple(r) for r in got.collect()} == expect


def test_modes(frame, rows):
    hunks, none = frame(HUNK, ("d", "a.ts", 1, 2)), frame(POINT)
    point = frame(POINT, ("d", "b.ts", 1))
    assert rows(gating.classify_hunks(hunks, none, gating.REVIEWER), "evidence") == [("evidenced",)]
    assert rows(gating.classify_hunks(hunks, none, gating.LINTER), "evidence") == [("unrequested",)]
    assert rows(gating.classify_hunks(hunks, point, gating.REVIEWER), "reason") == [("nothing known about this line either way",)]
    allowed = frame("id string, file string", ("d", "src/a.ts"))
    assert rows(gating.classify_hunks(hunks, point, gating.MIGRATION, allowed), "reason") == [("a.ts is a file the migration changed",)]


DIFF = """diff --git a/src/s.ts b/src/s.ts
--- a/src/s.ts
+++ b/src/s.ts
@@ -2,3 +2,4 @@ x
 keep
+one
-two
+three
@@ -25 +26 @@
+four
diff --git a/gone.ts b/gone.ts
--- a/gone.ts
+++ /dev/null
@@ -1,2 +0,0 @@
-x
"""


def test_diff_readers(frame, rows):
    df = frame("id string, diff string", ("1", DIFF), ("2", ""))
    assert rows(diffs.hunks(df)) == [("1", "gone.ts", 0, 0), ("1", "src/s.ts", 2, 5), ("1", "src/s.ts", 26, 26)]
    assert rows(diffs.touched_lines(df)) == [("1", "src/s.ts", 26), ("1", "src/s.ts", 3), ("1", "src/s.ts", 4)]
    kept = frame("id string, file string, start int", ("1", "src/s.ts", 26))
    assert rows(diffs.keep_hunks(df, kept)) == [
        ("1", "diff --git a/src/s.ts b/src/s.ts\n--- a/src/s.ts\n+++ b/src/s.ts\n@@ -25 +26 @@\n+four\n"), ("2", ""),
    ]


def test_line_edits_from_right_to_left(frame, rows):
    files = frame("repo string, file string, content string", ("r", "f", "ab ab\nsecond"))
    edits = frame(
        "repo string, file string, edit int, line int, col int, find string, replace string",
        ("r", "f", 1, 1, 1, "ab", "longer"), ("r", "f", 2, 1, 4, "ab", "x"), ("r", "f", 3, 2, 1, "nope", "y"), ("r", "f", 4, 9, 1, "a", "b"), ("r", "g", 5, 1, 1, "a", "b"),
    )
    outcomes, texts = gating.apply_line_edits(edits, files)
    assert rows(outcomes, "edit", "ok") == [(1, True), (2, True), (3, False), (4, False), (5, False)]
    assert rows(texts, "content") == [("longer x\nsecond",)]


def test_text_edits_must_be_unique(frame):
    files = frame("repo string, file string, content string", ("r", "f", "one two one"))
    edits = frame("repo string, file string, edit int, find string, replace string", ("r", "f", 1, "one", "x"), ("r", "f", 2, "two", "one"), ("r", "f", 3, "zzz", "y"))
    row = gating.apply_text_edits(edits, files).first()
    assert row.content == "one one one"
    assert [(o.ok, o.reason) for o in row.results] == [
        (False, "text appears 2 times in f; needs more surrounding context to be unambiguous"), (True, None), (False, "text not found in f"),
    ]
