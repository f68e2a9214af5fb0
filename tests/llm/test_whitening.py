import math
from fractions import Fraction

import numpy as np
import pytest

from fleetdrift.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, id string, vector int, n int, whitened string"


@pytest.fixture
def vectors(spark):
    def make(*rows):
        return spark.createDataFrame([(i, v, "x", 1, 2, "w") for i, v in rows], SCHEMA)

    return make


def whole(vector):
    return [math.floor(1024 * c) + 100000 for c in vector]


def check(given, found, count=8):
    """Against double-precision eigenvectors of the exact integer scatter."""
    x = np.array([whole(v) for _, v in given], object)
    n, sums = len(x), x.sum(axis=0)
    matrix = n * (x.T @ x) - np.outer(sums, sums)
    values, axes = np.linalg.eigh(matrix.astype(float) / n**2)
    values, axes = values[::-1], axes[:, ::-1]
    trace = Fraction(int(np.trace(matrix)), n * n)
    centred = ((n * x - sums) / n).astype(float)
    deviation = {i: int(((n * r - sums) ** 2).sum()) for (i, _), r in zip(given, x, strict=True)}
    by_component = {}
    for r in found:
        by_component.setdefault(r.component, {})[r.id] = r
        assert r.n == n and r.deviation == deviation[r.id] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / float(trace), rel=1e-9)
    assert sorted(by_component) == list(range(1, min(count, np.linalg.matrix_rank(matrix.astype(float))) + 1))
    for k, of in by_component.items():
        want = centred @ axes[:, k - 1] / math.sqrt(values[k - 1])
        got = np.array([of[i].whitened for i, _ in given])
        assert np.abs(got * np.sign(got @ want) - want).max() < 1e-6


def test_whitening_equals_eigenvectors(vectors):
    rng = np.random.default_rng(3)
    given = [(i, rng.normal(size=12).astype(np.float32) * np.arange(1, 13, dtype=np.float32)) for i in range(200)]
    given = [(i, [float(c) for c in v]) for i, v in given]
    check(given, whitening.whiten(vectors(*given)).collect())


def test_whitening_of_low_rank(vectors):
    given = [(i, [float(i % 5), float(i % 3), float(i % 5 + i % 3), 7.0]) for i in range(45)]
    check(given, whitening.whiten(vectors(*given)).collect())


def test_equal_roots_get_orthogonal_components(vectors):
    given = [(i, [float(s * (k == at)) for at in range(6)]) for i, (k, s) in enumerate((k, s) for k in range(6) for s in (-2, 2))]
    found = whitening.whiten(vectors(*given)).collect()
    assert len(found) == 12 * 6 and max(r.identity_error for r in found) < 1e-9
    assert {r.component: r.explained for r in found} == pytest.approx(dict.fromkeys(range(1, 7), 1 / 6))


def test_odd_vectors_are_left_out(vectors):
    good = [(i, [float(i), float(i * i % 7), -1.5 * i]) for i in range(20)] + [(None, [1.0, 2.0, 3.0]), (3, [3.0, 2.0, -4.5]), (3, [3.0, 2.0, -4.5])]
    odd = [(50, None), (51, [1.0, None, 2.0]), (52, [math.nan, 1.0, 1.0]), (53, [math.inf, 1.0, 1.0]), (54, []), (55, [1.0, 2.0]), (56, [3e38, 0.0, 0.0])]
    found = whitening.whiten(vectors(*good, *odd)).collect()
    assert sorted({(r.id is None, r.id) for r in found}, key=repr) == sorted({(i is None, i) for i, _ in good}, key=repr)
    assert len(found) == 3 * len(good) and {r.n for r in found} == {len(good)} and {r.identity_error < 1e-9 for r in found} == {True}


def test_large_entries_stay_exact(vectors):
    given = [(i, [float(2**40 * (i % 4)), float(i % 7) * 2.0**41, float(i)]) for i in range(30)]
    found = whitening.whiten(vectors(*given)).collect()
    assert len(found) == 90 and {r.identity_error < 1e-9 for r in found} == {True}


def test_nothing_to_whiten(vectors):
    assert whitening.whiten(vectors((1, [1.0, 2.0]))).count() == 0
    assert whitening.whiten(vectors((1, [1.0]), (2, [1.0]))).count() == 0
    assert whitening.whiten(vectors((1, [1.0])).filter("false")).count() == 0
    assert whitening.whiten(vectors((1, None))).count() == 0


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(10**6), 10**6, (9, 9)).astype(object)
    matrix = (base @ base.T).tolist()
    found = whitening.characteristic_polynomial(spark, matrix)
    # by the traces of powers (Newton's identities), in rationals
    power, want = np.array(matrix, object), [Fraction(1)]
    sums = []
    for _ in range(9):
        sums.append(int(np.trace(power)))
        power = power @ np.array(matrix, object)
    for k in range(1, 10):
        want.append(-sum(want[k - 1 - i] * sums[i] for i in range(k)) / Fraction(k))
    assert found == [int(c) for c in reversed(want)]


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    given = [(i, v) for i, v in given if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    found = queries.QUERIES["op12_whitening"](spark, sf_dir)
    check(given, found.withColumnRenamed("vec_id", "id").collect())
