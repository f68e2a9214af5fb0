import hashlib
import itertools
import random
import zlib

from fleetdrift.llm import queries, runs


def brute_runs(words, exponent=4, least=6):
    """Every stretch of the smallest period q, found period by period, letter by letter."""
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        same = [words[i] == words[i + q] for i in range(n - q)]
        at = 0
        for equal, stretch in itertools.groupby(same):
            size = len(list(stretch))
            length = size + q
            if equal and length >= max(least, exponent * q):
                block = words[at : at + length]
                if not any(all(block[i] == block[i + r] for i in range(length - r)) for r in range(1, q)):
                    found.append((at, q, length))
            at += size
    return sorted(found)


def collapsed(words, found):
    gone = {i for start, q, length in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def check(given, out):
    want = []
    for i, text in given:
        found = brute_runs(split(text))
        want.append((i, len(split(text)), found, collapsed(split(text), found)))
    assert sorted(((r.id, r.n_words, [(x.start, x.period, x.length) for x in r.runs], r.collapsed) for r in out), key=repr) == sorted(want, key=repr)
    assert all(r.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest() for r in out)


def test_runs_equal_brute_force(docs):
    rng = random.Random(5)
    given = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(120)))) for i in range(150)]
    for i in range(60):
        block = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40))]
        before, after = ([rng.choice("abxy") for _ in range(rng.randrange(30))] for _ in range(2))
        given.append((1000 + i, " ".join([*before, *(block * 9)[: rng.randrange(1, 9 * len(block))], *after])))
    given.append((2000, " ".join(["u v w"] * 1500)))
    given.append((2001, " ".join(" ".join(f"w{k}" for k in range(331)) for _ in range(5))))
    check(given, runs.collapse_runs(docs(*given), with_text=True).collect())


def test_runs_of_odd_rows(docs, odd_rows):
    odd = [r for r in odd_rows if len(r[1] or "") < 20_000] + [(20, "x " * 7), (20, "x " * 7), (21, "x " * 5), (22, "x x " * 6)]
    check(odd, runs.collapse_runs(docs(*odd), with_text=True).collect())
    assert runs.collapse_runs(docs((1, "x")).filter("false")).count() == 0


def test_runs_over_many_tiles(docs, monkeypatch):
    monkeypatch.setattr(runs, "TILE_WORDS", 16)
    given = [(1, "a b c d e " * 400 + "z " + "a b " * 300), (2, "q " * 3000), (3, " ".join(f"w{i % 97}" for i in range(2000)))]
    out = {r.id: [(x.start, x.period, x.length) for x in r.runs] for r in runs.collapse_runs(docs(*given)).collect()}
    assert out == {1: [(0, 5, 2000), (2001, 2, 600)], 2: [(0, 1, 3000)], 3: [(0, 97, 2000)]}


def test_query_on_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert len(found) == len(texts)
    for i, text in texts:
        given = split(text)
        if len(given) > 1500:
            continue  # the brute force is cubic; longer texts are held by the tests above
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(given)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            given = given[:a] + [given[a + (k - a) % p] for k in range(a, n)]
        want = brute_runs(given)
        r = found[i]
        assert r.n_runs == len(want)
        best = min(want, key=lambda x: (-x[2], x[0], x[1]), default=None)
        assert (r.start, r.period, r.length) == (best or (None, None, None))
        assert r.exponent_milli == (best and 1000 * best[2] // best[1])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, q, m in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(given, want).encode()).hexdigest()
