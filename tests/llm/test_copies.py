import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetdrift.llm import exact, jaccard, sharding, suffixes


def bare(text):
    return re.sub("[ \t-\r]", "", text or "")


def test_exact_copies(docs, odd_rows, rows):
    given = [*odd_rows, (20, "a\tb"), (21, "ab"), (22, " a b "), (23, "a b")]
    want = []
    for i, t in given:
        group = [(-len(u or ""), j is None, j or 0, j) for j, u in given if bare(u) == bare(t)]
        keep = min(group)
        kept = i == keep[3] and -len(t or "") == keep[0]
        want.append((i, keep[3], len(group), kept, hashlib.sha256(bare(t).encode()).hexdigest()))
    found = exact.exact_dedup(docs(*given)).selectExpr("id", "keep_id", "group_size", "kept", "lower(hex(digest))")
    assert rows(found) == sorted(want, key=repr)


def test_index_grows_by_batches(docs, spark, tmp_path, rows):
    index = exact.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    first, second = docs((1, "a b"), (2, "ab"), (3, "c")), docs((4, "a  b"), (5, "d"), (6, "d "))
    assert rows(exact.exact_dedup(first, index=index, batch="one"), "id", "keep_id", "kept") == [(1, 1, True), (2, 1, False), (3, 3, True)]
    assert rows(exact.exact_dedup(second, index=index, batch="two"), "id", "keep_id", "kept") == [(4, 1, False), (5, 6, False), (6, 6, True)]
    assert index.entries().count() == 3
    exact.exact_dedup(second, index=index, batch="two")  # run again after a failure
    assert index.entries().count() == 3
    plan = index.entries().groupBy("digest").count()._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_exact_empty(docs):
    assert exact.exact_dedup(docs((1, "x")).filter("false")).count() == 0


def shingles(text, size=4):
    words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def classes(given, size, percent):
    sets = [shingles(t, size) for _, t in given]
    root = list(range(len(given)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(given)):
        for b in range(a):
            same_id = given[a][0] == given[b][0]
            if given[a][0] is None or given[b][0] is None or not sets[a] or not sets[b]:
                continue
            inter = len(sets[a] & sets[b])
            if same_id or 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                root[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(given):
        group = [given[b][0] for b in range(len(given)) if find(b) == find(a)]
        out.append((i, len(sets[a]), None if i is None else i if not sets[a] else min(group)))
    return sorted(out, key=repr)


def edited(text, rng, share):
    words = text.split()
    for _ in range(int(share * len(words))):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_jaccard_equals_brute_force(docs, odd_rows, prose, rows):
    rng = random.Random(5)
    given = [(i, t) for i, t in odd_rows if t is None or len(t) < 100_000]
    base = prose(50, 150)
    given += [(100 + k, edited(base, rng, rng.choice([0, 0.01, 0.02, 0.03, 0.05]))) for k in range(60)]
    given += [(200 + k, edited(prose(60 + k // 3, 80), rng, 0.01)) for k in range(30)]
    given += [(300 + k, "the same line of words here " + prose(400 + k, 10)) for k in range(20)]
    assert rows(jaccard.jaccard_components(docs(*given))) == classes(given, 4, 85)


def test_jaccard_settles_large_groups_in_blocks(docs, prose, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rng = random.Random(9)
    base = prose(70, 100)
    given = [(k, edited(base, rng, 0.03)) for k in range(70)]
    assert rows(jaccard.jaccard_components(docs(*given), percent=80)) == classes(given, 4, 80)


def test_cells_are_settled_one_by_one():
    rng = np.random.default_rng(2)
    rows_, want = [], set()
    for cell in range(30):  # nodes of three components; within a cell some are alike across components
        base = np.sort(rng.choice(10**6, 40, replace=False))
        for k in range(6):
            prefix = base.copy()
            if k >= 4:
                prefix = np.sort(np.append(base[:1], rng.choice(np.arange(10**6, 2 * 10**6), 39, replace=False)))
            rows_.append((cell, int(base[0]), 0, 10 * cell + k, 10 * cell + k % 3, 200, prefix.tolist()))
        want |= {(10 * cell + a, 10 * cell + b) for a in range(4) for b in range(a + 1, 4) if a % 3 != b % 3}
    names = ["cell", "token", "side", "node", "comp", "n", "prefix"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows_])
    found = [b for cut in (batch.slice(0, 70), batch.slice(70)) for b in [cut]]
    out = pa.Table.from_batches(list(jaccard._settle(85)(iter(found))))
    assert set(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)) == want


def test_jaccard_empty(docs):
    assert jaccard.jaccard_components(docs((1, "x")).filter("false")).count() == 0
    assert [tuple(r) for r in jaccard.jaccard_components(docs((1, None))).collect()] == [(1, 0, 1)]


def passages(given, window):
    texts = {}
    for i, t in given:
        if i is not None:
            texts[i] = max(texts.get(i, ""), t or "")
    first, out = {}, []
    for i in sorted(texts):
        words = re.findall("[^ \t-\r]+", texts[i])
        runs = []
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            source = first.setdefault(key, (i, s))
            if source != (i, s):
                if runs and s <= runs[-1][1] + window:
                    runs[-1][1] = s
                else:
                    runs.append([s, s, source])
        out += [(i, a, b + window, *source) for a, b, source in runs]
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2000, 1])
def test_passages_equal_brute_force(docs, odd_rows, prose, rows, hot):
    shared, other = prose(900, 60), prose(901, 55)
    given = [*odd_rows]
    given += [(100 + k, f"{prose(910 + k, 30 + k)}\n{shared if k % 2 else other} {prose(950 + k, 20)}") for k in range(12)]
    given += [(200, " ".join([prose(990, 7)] * 30)), (201, shared), (202, f"{other}  {shared}"), (203, shared.replace(" ", "\n", 20))]
    given += [(210, " ".join(shared.split()[:49])), (211, " ".join(shared.split()[:50]))]
    found = suffixes.repeated_passages(docs(*given), hot=hot)
    assert rows(found) == passages(given, 50)


def test_cut_leaves_the_first_occurrence(docs, prose, rows):
    shared = prose(800, 60)
    given = [(1, f"start {shared} end"), (2, f"other {shared} rest"), (3, shared), (4, None), (5, "short"), (None, shared)]
    found = suffixes.cut_passages(docs(*given), length_col="n")
    assert rows(found, "doc_id", "text", "n") == sorted([(1, given[0][1], 1), (2, "other rest", 10), (4, None, 1), (5, "short", 1), (None, shared, 1)], key=repr)
    assert found.columns == docs((1, "x")).columns


def test_passages_empty(docs):
    assert suffixes.repeated_passages(docs((1, "x")).filter("false")).count() == 0


def check_shards(given, found, shards):
    assert sorted((r.id, r.size) for r in found if r.id is not None) == sorted((i, len((t or "").encode()) + 16) for i, t in given if i is not None)
    slots, of_text = {}, {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
        of_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    assert set(slots) <= set(range(shards))
    return [sum(r.size for r in found if r.shard == s) for s in range(shards)]


def test_shards_are_even(docs, prose, odd_rows):
    given = [(i, prose(i, 1 + i * 13 % 90)) for i in range(900)]
    sums = check_shards(given, sharding.shard_by_bytes(docs(*given), 6).collect(), 6)
    assert max(sums) - min(sums) <= 64
    check_shards(odd_rows, sharding.shard_by_bytes(docs(*odd_rows), 4).collect(), 4)


def test_shards_by_levels_and_a_hot_group(docs, prose, monkeypatch):
    monkeypatch.setattr(sharding, "LAST", 60)
    given = [(i, prose(i, 1 + i * 13 % 90)) for i in range(900)] + [(2000 + i, "copy " * 40) for i in range(1000)]
    sums = sorted(check_shards(given, sharding.shard_by_bytes(docs(*given), 5).collect(), 5))
    assert sums[-1] == 1000 * 216 and sums[-2] - sums[0] < 0.05 * sums[0]


@pytest.mark.parametrize("count", [16_384, 16_385, 100_000])
def test_balance_does_not_fall_with_the_number_of_groups(spark, count):
    groups = spark.range(count).select(F.col("id").alias("item"), F.floor(F.exp(6 + 2 * (F.pmod(F.xxhash64("id"), F.lit(10_007)) / 10_007))).cast("long").alias("bytes"))
    placed = groups.join(sharding.shard_of_groups(groups, 40), "item")
    assert placed.count() == count
    sums = [r.bytes for r in placed.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()]
    assert len(sums) == 40 and max(sums) - min(sums) < 0.001 * min(sums)


def test_shards_empty(docs):
    assert sharding.shard_by_bytes(docs((1, "x")).filter("false")).count() == 0
