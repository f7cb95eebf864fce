"""Whitening against double-precision eigenvectors, exact arithmetic and awkward rows."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tests.conftest import SF
from vellum.llm import queries, whitening


def exact(rows):
    """n, deviations and n * n * V in whole numbers."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    m = [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]
    return n, [sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x], m, x, s


def holds(rows, got, ids, top=32):
    n, deviation, m, x, s = exact(rows)
    values, vectors = np.linalg.eigh(np.array(m, dtype=float))
    rank = sum(values > values.max() * 1e-11)
    k = min(rank, top)
    assert len(got) == len(rows) * k
    trace = sum(m[i][i] for i in range(len(m)))
    by = {(r.vec_id, r.component): r for r in got}
    w = np.array([[by[i, c + 1].whitened for c in range(k)] for i in ids])
    for i, dev in zip(ids, deviation, strict=True):
        for c in range(k):
            r = by[i, c + 1]
            assert (r.n, r.deviation) == (n, dev)
            assert r.explained == pytest.approx(values[-1 - c] / trace, rel=1e-6)
            assert r.identity_error < 1e-9
    assert np.abs((w - w.mean(0)).T @ (w - w.mean(0)) / n - np.eye(k)).max() < 1e-9
    centred = np.array([[c - Fraction(t, n) for c, t in zip(r, s, strict=True)] for r in x], dtype=float)
    for c in range(k):
        gaps = np.abs(np.delete(values, len(values) - 1 - c) - values[-1 - c]).min(initial=np.inf)
        if gaps > values.max() * 1e-6:
            want = centred @ vectors[:, -1 - c] / np.sqrt(values[-1 - c]) * n
            assert min(np.abs(w[:, c] - want).max(), np.abs(w[:, c] + want).max()) < 1e-6


def table(spark, rows, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(rows)), [[*map(float, r)] for r in rows], strict=True)), "vec_id long, embedding array<double>").repartition(3)


def test_characteristic_polynomial_is_exact():
    rng = random.Random(2)
    for n in (1, 2, 3, 6, 9):
        a = [[rng.randint(-9, 9) if rng.random() < 0.7 else 0 for _ in range(n)] for _ in range(n)]
        # Faddeev-LeVerrier in fractions.
        c, m = [Fraction(1)], [[Fraction(0)] * n for _ in range(n)]
        for k in range(1, n + 1):
            m = [[sum(a[i][q] * m[q][j] for q in range(n)) + (c[-1] if i == j else 0) for j in range(n)] for i in range(n)]
            c.append(-sum(sum(a[i][q] * m[q][i] for q in range(n)) for i in range(n)) / k)
        p = 2_147_483_647
        assert whitening.charpoly_mod(np.array(a, np.int64), p).tolist() == [int(v) % p for v in reversed(c)]


def test_roots_are_isolated_and_counted():
    roots = [0, 0, 3, 3, 5, 17, 18, 1000]
    poly = [1]
    for r in roots:
        poly = [(poly[k - 1] if k else 0) - (r * poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    found = whitening.isolate(poly, 8, 1046)
    assert [f[0] for f in found] == [1, 1, 1, 1, 2]
    for (count, low, size, scale), want in zip(found, (1000, 18, 17, 5, 3), strict=True):
        low, scale = whitening.refine(poly, low, size, scale, 50) if count == 1 else (low, scale)
        assert Fraction(low, 1 << scale) < want <= Fraction(low + 1, 1 << scale)
    assert sum(f[0] for f in whitening.isolate(poly, 2, 1046)) == 2


def test_gram_of_large_numbers_is_exact():
    rng = random.Random(4)
    y = [[rng.choice([-1, 1]) * rng.randrange(1 << rng.choice([3, 21, 45, 60])) for _ in range(4)] for _ in range(50)]
    want = [[sum(r[i] * r[j] for r in y) for j in range(4)] for i in range(4)]
    assert whitening.gram(np.array(y, np.int64)).tolist() == want


def test_random_vectors(spark):
    rng = random.Random(6)
    rows = [[rng.gauss(0, 1 + j) for j in range(5)] for _ in range(60)]
    holds(rows, whitening.whiten(table(spark, rows)).collect(), range(60))
    holds(rows, whitening.whiten(table(spark, rows), top=2).collect(), range(60), 2)


def test_equal_eigenvalues_and_dependent_dimensions(spark):
    square = [[a, b, c, a + b, 5.0] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]
    holds(square, whitening.whiten(table(spark, square)).collect(), range(8))
    few = [[1.0, 2, 3, 4], [2.0, 0, 1, 5], [0.5, 0, 0, 0]]
    got = whitening.whiten(table(spark, few)).collect()
    assert len(got) == 3 * 2
    holds(few, got, range(3))
    units = [[float(i == j) * s for j in range(20)] for i in range(20) for s in (-1, 1)]
    got = whitening.whiten(table(spark, units), top=20).collect()
    holds(units, got, range(40), 20)


def test_awkward_rows(spark):
    rng = random.Random(8)
    good = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(20)]
    rows = [(i, v, 1) for i, v in enumerate(good)]
    rows += [(50, None, 1), (51, [], 1), (52, [1.0, None, 2.0], 1), (53, [1.0, float("nan"), 2.0], 1), (54, [float("inf"), 0.0, 0.0], 1), (55, [1.0, 2.0], 1), (56, [1e300, 0.0, 0.0], 1), (None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, k long")
    holds(good, whitening.whiten(df).collect(), range(20))
    twice = spark.createDataFrame([*rows, *rows[:20], (None, good[0], 1)], df.schema)
    got = whitening.whiten(twice).collect()
    assert len(got) == 41 * 3 and {r.n for r in got} == {41}
    assert sorted(r.component for r in got if r.vec_id is None) == [1, 2, 3]
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 3")).count() == 0
    assert whitening.whiten(df.filter("vec_id IN (50, 51)")).count() == 0
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 4)).count() == 0


def test_numbers_of_very_different_size(spark):
    rng = random.Random(9)
    rows = [[rng.gauss(0, 1), rng.gauss(0, 1e6), rng.gauss(0, 1e11)] for _ in range(15)]
    got = whitening.whiten(table(spark, rows)).collect()
    deviation = exact(rows)[1]
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == 45 and all(r.identity_error < 1e-4 for r in got)
    assert all(by[i, 1].deviation == (d if d < 1 << 63 else None) for i, d in enumerate(deviation))


def test_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    holds([v for _, v in rows], queries.op12_embedding_whitening(spark, SF).collect(), [i for i, _ in rows])
