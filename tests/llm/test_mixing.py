import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from fleetdrift.llm import mixing, queries


@pytest.fixture
def corpus(spark):
    """corpus((id, text, source), ...): with further columns whose names the operator uses itself."""

    def make(*given):
        schema = "doc_id long, text string, source string, id string, number int, size string, start string, block int, chunk int, name string"
        return spark.createDataFrame([(*r, "x", 1, "2", "3", 4, 5, "n") for r in given], schema)

    return make


def count(text):
    return len((text or "").encode().split())


def brute_targets(sizes, weights):
    """Raise the common unit from one cap to the next until all words are shared out."""
    total, units = sum(sizes), sorted({Fraction(3 * s, w) for s, w in zip(sizes, weights, strict=True)})
    filled = lambda u: [min(u * w, Fraction(3 * s)) for s, w in zip(sizes, weights, strict=True)]
    low = Fraction(0)
    for unit in units:
        if sum(filled(unit)) >= total:
            slope = sum(w for s, w in zip(sizes, weights, strict=True) if Fraction(3 * s, w) > low)
            return filled(low + (total - sum(filled(low))) / slope) if slope else filled(unit)
        low = unit
    return filled(low)


def test_targets_equal_water_filling():
    rng = random.Random(4)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 5, 30, 1000, 10**6]) for _ in range(rng.randrange(1, 8))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        found = mixing.share_out(sizes, weights)
        assert sum(found) == sum(sizes) and found == brute_targets(sizes, weights)


def test_permutations():
    for size in (1, 2, 3, 4, 5, 63, 64, 65, 1000):
        for key in (0, 1, 2**63 + 5):
            found = mixing.permute(np.arange(size), np.full(size, size), np.full(size, key, np.uint64))
            assert sorted(found) == list(range(size))
            assert all(mixing.place_of(int(v), size, key) == i for i, v in list(enumerate(found))[:40])


def test_counts_per_shard_meet_the_totals():
    for slots in ([0], [], [1], [1000, 10, 0, 3], [10**6, 3 * 10**5, 7]):
        found = mixing.draw_counts(slots, 16, 3)
        assert [sum(c) for c in zip(*found, strict=True)] == slots if slots else True
        sizes = [sum(c) for c in found]
        assert len(found) == 16 and max(sizes) - min(sizes) <= 1
    shares = [c[0] / sum(c) for c in mixing.draw_counts([500_000, 500_000], 20, 1)]
    assert 0.0005 < np.std(shares) < 0.01  # as a multinomial of 50,000 draws


def check(given, mixed, repeats=3):
    sizes = defaultdict(int)
    for _, text, source in given:
        sizes[source] += count(text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, brute_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    found = mixed.taken().collect()
    assert Counter((r.id, r.size, r.source) for r in found) == Counter((i, count(t), s) for i, t, s in given)
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == float(want[r.source]) and 0 <= r.taken <= repeats * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= Fraction(1, 2) for s in names)
    return found


def test_mix_of_odd_rows(corpus, odd_rows, prose):
    given = [(i, t, ("a", "é", "B", None, "")[k % 5]) for k, (i, t) in enumerate(odd_rows)]
    given += [(100 + i, prose(i, 20 + i), ("a", "hot", "hot")[i % 3]) for i in range(60)] + [(7, None, "no words")]
    for block in (1, 7, 256):
        check(given, mixing.mix(corpus(*given), block=block, shards=5))
    assert mixing.mix(corpus((1, "x", "a")).filter("false")).taken().count() == 0
    check([(1, None, None), (2, "", None)], mixing.mix(corpus((1, None, None), (2, "", None))))


def test_spans_fill_the_shards(corpus, prose, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 10)
    monkeypatch.setattr(mixing, "RUN", 4)
    given = [(i, prose(i, 1 + i * 37 % 200), ("a", "b", "c", "c")[i % 4]) for i in range(200)]
    docs = corpus(*given)
    mixed = mixing.mix(docs, block=16, shards=6)
    check(given, mixed)
    spans = [tuple(r) for r in mixed.spans.collect()]
    assert sorted(spans) == sorted(tuple(r) for r in mixing.mix(docs.repartition(7), block=16, shards=6).spans.collect())
    texts, slots = {i: t.split() for i, t, _ in given}, defaultdict(list)
    for shard, place, at, _, i, _, first, length in spans:
        slots[shard, place].append((at, texts[i][first : first + length]))
    for key, parts in slots.items():
        parts.sort()
        assert [at for at, _ in parts] == list(np.cumsum([0, *(len(w) for _, w in parts[:-1])])) and sum(len(w) for _, w in parts) <= 16
        slots[key] = " ".join(w for _, part in parts for w in part)
    places = defaultdict(list)
    for shard, place in slots:
        places[shard].append(place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    sizes = [len(p) for p in places.values()]
    assert len(sizes) == 6 and max(sizes) - min(sizes) <= 1
    assert {(r.shard, r.place): r.text for r in mixing.block_texts(docs, mixed).collect()} == slots


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    check(given, mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    assert queries.QUERIES["op11_mixing"](spark, sf_dir).columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
