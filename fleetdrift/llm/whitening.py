"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter matrix.

Entries become integers ``y = floor(1024 * c)`` (an offset common to all, as in ``x = y + 100000``, changes neither
scatter nor deviation). What follows from them is exact until the last step:

1. *Scatter.* Tasks sum ``y`` and ``y * y'`` over their rows; floats hold whole numbers below 2^53, so blocks of rows are
   one float product each, as many rows as keep it exact. Spark adds the tasks' sums. ``M = n * sum(y y') - S S'`` is
   ``n^2`` times the covariance. ``d * (d + 1) / 2`` numbers reach the driver, whatever the number of rows.
2. *Characteristic polynomial.* Modulo a prime, ``M`` is reduced to Hessenberg form and the polynomial follows by a
   recurrence; primes are spread over tasks, and Chinese remaindering joins as many as the coefficients' bound needs.
3. *Roots.* All roots of a symmetric matrix are real, and then Descartes' sign changes of the polynomial shifted by
   ``a`` count the roots above ``a`` exactly, with multiplicity. Bisection on dyadic numbers isolates the greatest
   ones; a root alone in its interval goes on by the sign of the polynomial. The multiplicity of zero is the number
   of vanishing low coefficients.
4. *Components.* The null space of ``M - root`` by inverse iteration in decimal arithmetic; roots that stay together
   get orthogonal vectors.

Vectors that are null or hold null or non-finite entries are left out, and so are entries whose integer no long holds
(2^62 and more). Vectors of another length than the commonest (of several the longest) share no covariance and are left
out, empty ones too. Only components of positive variance exist: a single vector, equal vectors and an empty table
give no rows. Repeated rows count as often as they occur; ids may be null or repeat; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, TOO_LARGE = 1024, float(1 << 62)
LIMB = 10**18
ROOT_BITS = 120  # roots are known to 2^-ROOT_BITS, in units of the integer matrix
DIGITS = 60  # of the decimal arithmetic, beyond those of the greatest root
PRIMES_PER_TASK = 8


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``floor(1024 * c)``."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dim)


def exact_product(rows: np.ndarray) -> np.ndarray:
    """``rows' rows`` as Python integers."""
    largest = int(np.abs(rows).max(initial=0))
    fits = (1 << 53) // max(1, largest * largest)
    if not fits:
        wide = rows.astype(object)
        return wide.T @ wide
    total = np.zeros((rows.shape[1], rows.shape[1]), object)
    for at in range(0, len(rows), fits):
        part = rows[at : at + fits].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _sums(dim: int):
    upper = np.triu_indices(dim + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1), object)
        for batch in batches:
            rows = integers(batch.column(0), dim)
            total[1:, 1:] += exact_product(rows)
            total[0, 1:] += rows.astype(object).sum(axis=0) if len(rows) else 0
            total[0, 0] += len(rows)
        found = total[upper].tolist()
        high, low = ([Decimal(f(v)) for v in found] for f in (lambda v: v // LIMB, lambda v: v % LIMB))
        wide = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(high, wide), pa.array(low, wide)], ["place", "high", "low"])

    return run


def scatter(vectors: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums, and ``n * sum(y y') - S S'``, all exact."""
    parts = vectors.select("vector").mapInArrow(_sums(dim), "place int, high decimal(38,0), low decimal(38,0)")
    found = parts.groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    total = np.zeros((dim + 1, dim + 1), object)
    rows, columns = np.triu_indices(dim + 1)
    for r in found:
        i, j = rows[r["place"]], columns[r["place"]]
        total[i, j] = total[j, i] = int(r["high"]) * LIMB + int(r["low"])
    n, sums = total[0, 0], total[0, 1:]
    return int(n), sums.tolist(), (n * total[1:, 1:] - np.outer(sums, sums)).tolist()


def primes_below(limit: int) -> Iterator[int]:
    """Primes from ``limit`` downwards (Miller-Rabin with bases that are certain below 3.2 * 10^9)."""
    for p in range(limit - 1 + limit % 2, 2, -2):
        d, s = p - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        if all(any(pow(b, d << r, p) == p - 1 for r in range(s)) or pow(b, d, p) == 1 for b in (2, 3, 5, 7)):
            yield p


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of the characteristic polynomial modulo a prime below 2^31."""
    h = matrix.copy()
    d = len(h)
    for k in range(d - 2):
        nonzero = np.flatnonzero(h[k + 1 :, k])
        if not len(nonzero):
            continue
        pivot = k + 1 + int(nonzero[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :, k:] = (h[k + 2 :, k:] - factors[:, None] * h[k + 1, k:] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors % p).sum(axis=1)) % p
    found = [np.zeros(d + 1, np.int64)]
    found[0][0] = 1
    for k in range(d):
        new = np.roll(found[k], 1)
        new = (new - h[k, k] * found[k] % p) % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            new = (new - (int(h[i, k]) * below % p) * found[i] % p) % p
        found.append(new)
    return found[d]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients, constant first, of a symmetric matrix without negative eigenvalues."""
    d, trace = len(matrix), sum(row[i] for i, row in enumerate(matrix))
    # the k-th elementary symmetric function of roots that are not negative is greatest if all are equal
    bound = max(math.comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    chosen, modulus = [], 1
    for p in primes_below(1 << 31):
        if modulus > 2 * bound:
            break
        chosen.append(p)
        modulus *= p

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            primes = batch.column(0).to_pylist()
            found = [polynomial_modulo(np.array([[v % p for v in row] for row in matrix], np.int64), p).tolist() for p in primes]
            yield pa.RecordBatch.from_arrays([pa.array(primes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["prime", "residues"])

    tasks = -(-len(chosen) // PRIMES_PER_TASK)
    given = spark.createDataFrame([(p,) for p in chosen], "prime long").repartition(tasks)
    answers = {r["prime"]: r["residues"] for r in given.mapInArrow(residues, "prime long, residues array<long>").collect()}
    result = [0] * (d + 1)
    for p in chosen:
        rest = modulus // p
        factor = rest * pow(rest, -1, p)
        result = [v + a * factor for v, a in zip(result, answers[p], strict=True)]
    result = [v % modulus for v in result]
    return [v - modulus if 2 * v > modulus else v for v in result]


def scaled(polynomial: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are ``2^bits`` times as great."""
    d = len(polynomial) - 1
    return [c << bits * (d - k) for k, c in enumerate(polynomial)]


def roots_above(polynomial: list[int], a: int) -> int:
    """The number of roots greater than ``a``, with multiplicity, if all roots are real."""
    shifted = polynomial[::-1]
    for stop in range(len(shifted), 1, -1):
        for k in range(1, stop):
            shifted[k] += a * shifted[k - 1]
    signs = [c > 0 for c in shifted if c]
    return sum(x != y for x, y in itertools.pairwise(signs))


def value(polynomial: list[int], a: int) -> int:
    total = 0
    for c in reversed(polynomial):
        total = total * a + c
    return total


def greatest_roots(polynomial: list[int], count: int, trace: int) -> list[int]:
    """The ``count`` greatest roots that are not zero, falling, times ``2^ROOT_BITS`` and rounded up."""
    zeros = next(k for k, c in enumerate(polynomial) if c)
    polynomial = polynomial[zeros:]
    found: list[int] = []
    for k in range(1, min(count, len(polynomial) - 1) + 1):
        bits, low, high, above_low, above_high = 0, 0, trace + 1, len(polynomial) - 1, 0
        here = polynomial
        while True:
            if high - low == 1:
                if bits == ROOT_BITS:
                    break
                step = min(8, ROOT_BITS - bits)
                bits, low, high = bits + step, low << step, high << step
                here = scaled(polynomial, bits)
            if above_low - above_high == 1:  # alone: the sign tells the side
                here, low, high, bits = scaled(polynomial, ROOT_BITS), low << ROOT_BITS - bits, high << ROOT_BITS - bits, ROOT_BITS
                positive_above = above_high % 2 == 0  # the polynomial's sign between this root and the next one
                while high - low > 1:
                    middle = (low + high) // 2
                    at = value(here, middle)
                    if at == 0 or (at > 0) == positive_above:
                        high = middle
                    else:
                        low = middle
                break
            middle = (low + high) // 2
            above = roots_above(here, middle)
            if above >= k:
                low, above_low = middle, above
            else:
                high, above_high = middle, above
        found.append(high)
    return found


def null_vectors(matrix: list[list[int]], roots: list[int]) -> list[list[float]]:
    """A unit vector for each root; the entry of greatest magnitude is positive."""
    out: list[list[Decimal]] = []
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS + len(str(max(roots)))
        given = np.array([[Decimal(v) for v in row] for row in matrix], object)
        tiny = Decimal(2) ** -(ROOT_BITS + 20)
        for at, root in enumerate(roots):
            shifted = given.copy()
            for i in range(d):
                shifted[i, i] -= Decimal(root) / Decimal(2) ** ROOT_BITS
            together = [v for v, r in zip(out, roots, strict=False) if abs(r - root) <= 1]
            vector = np.array([Decimal((i * i + (at + 3) * i + 7 * at) % 31 + 1) for i in range(d)], object)
            order = _eliminate(shifted, tiny)
            for _ in range(3):
                vector = _orthogonal(_solve(shifted, order, vector), together)
            if max(vector) < -min(vector):
                vector = -vector
            out.append(vector)
        return [[float(v) for v in vector] for vector in out]


def _orthogonal(vector: np.ndarray, others: list) -> np.ndarray:
    for other in others:
        vector = vector - other * (vector @ other)
    return vector / (vector @ vector).sqrt()


def _eliminate(a: np.ndarray, tiny: Decimal) -> list[int]:
    """Triangular factors in place, rows swapped for the greatest pivot; returns the row taken at each step."""
    order = []
    for k in range(len(a)):
        pivot = max(range(k, len(a)), key=lambda i: abs(a[i, k]))
        order.append(pivot)
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny  # singular: any small pivot leads into the null space
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return order


def _solve(a: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    x = b.copy()
    for k, pivot in enumerate(order):
        x[[k, pivot]] = x[[pivot, k]]
    for k in range(len(a)):
        x[k + 1 :] -= a[k + 1 :, k] * x[k]
    for k in reversed(range(len(a))):
        x[k] /= a[k, k]
        x[:k] -= a[:k, k] * x[k]
    return x


def _project(dim: int, n: int, sums: list[int], axes: np.ndarray):
    whole = [s // n for s in sums]
    part = np.array([(s - n * w) / n for s, w in zip(sums, whole, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = integers(batch.column("vector"), dim)
            largest = n * int(np.abs(rows).max(initial=0)) + max(map(abs, sums))
            wide = object if largest * largest * dim >= 1 << 63 or max(map(abs, whole)) >= 1 << 62 else np.int64
            apart = rows.astype(wide) * n - np.array(sums, wide)
            square = (apart * apart).sum(axis=1)
            deviation = pa.array([Decimal(v) if v < 10**38 else None for v in square.tolist()], pa.decimal128(38, 0))
            centred = (rows.astype(wide) - np.array(whole, wide)).astype(np.float64) - part
            shown = np.ascontiguousarray(centred @ axes.T)
            index = np.arange(0, shown.size + 1, len(axes), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), deviation, pa.ListArray.from_arrays(pa.array(index), pa.array(shown.ravel()))], ["id", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, count: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: ``id``, ``component`` (from 1, by falling variance), ``n``, ``deviation``
    (decimal: sum of ``(n * x - S)^2``; null beyond 38 digits), ``whitened``, ``explained``, ``identity_error``."""
    spark = vectors.sparkSession
    common.prepare(spark)
    schema = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    given = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    good = given.filter(F.forall("vector", lambda c: F.coalesce(F.abs(c) < TOO_LARGE / SCALE, F.lit(False))))
    lengths = good.groupBy(F.size("vector").alias("dim")).count().filter("dim > 0").orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["dim"]
    good = good.filter(F.size("vector") == dim)
    n, sums, matrix = scatter(good, dim)
    trace = sum(matrix[i][i] for i in range(dim))
    if not trace:
        return spark.createDataFrame([], schema)
    roots = greatest_roots(characteristic_polynomial(spark, matrix), count, trace)
    deviations = np.array([math.sqrt(r / (1 << ROOT_BITS) / n / n) for r in roots])
    axes = np.array(null_vectors(matrix, roots)) / deviations[:, None]
    rows = common.stage(good.mapInArrow(_project(dim, n, sums, axes), "id long, deviation decimal(38,0), whitened array<double>"), "whitened")
    pairs = [(i, j) for i in range(len(roots)) for j in range(i, len(roots))]
    covariance = rows.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(covariance[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = F.array(*[F.lit(r / (trace << ROOT_BITS)) for r in roots])
    shown = rows.select("id", F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return shown.select("id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
