"""Whitening of embeddings by the exact characteristic polynomial of their whole-number scatter matrix."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Contract: a component c counts as the whole number floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Whole numbers beyond this don't fit the arithmetic: such a vector takes no part.
MOST = 1 << 61
#: Sums travel as whole numbers in limbs of so many bits; numbers are multiplied in parts of so many.
LIMB, PART = 40, 20
BATCH_ROWS = 8_192
#: Bits by which an eigenvalue is known beyond its isolation; below that width, eigenvalues that stay together are one.
BEYOND, SPLIT = 96, 192


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null, non-finite or all too large components."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(MOST // SCALE)))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def shifted(column: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * c) as whole numbers: x without OFFSET, by which no covariance changes."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.floor(c * SCALE).astype(np.int64)


def gram(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns, as Python's whole numbers: products of parts are exact in doubles for BATCH_ROWS rows."""
    out = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for at in range(0, len(y), BATCH_ROWS):
        rest, parts = y[at : at + BATCH_ROWS], []
        while np.abs(rest).max(initial=0) >> PART:
            parts.append((rest & ((1 << PART) - 1)).astype(np.float64))
            rest = rest >> PART
        parts.append(rest.astype(np.float64))
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                out += (a.T @ b).astype(np.int64).astype(object) << (PART * (i + j))
    return out


def _limbs(entries: dict[tuple[int, int], int]) -> pa.RecordBatch:
    """Rows (i, j, limb, value): each whole number as sum of value << (LIMB * limb); the last limb has its sign."""
    rows = []
    for (i, j), v in entries.items():
        n = max(1, -(-int(v).bit_length() // LIMB))
        rows += [(i, j, k, (v >> (LIMB * k)) & ((1 << LIMB) - 1) if k < n - 1 else v >> (LIMB * k)) for k in range(n)]
    return pa.RecordBatch.from_arrays([pa.array([int(r[c]) for r in rows], pa.int32() if c < 3 else pa.int64()) for c in range(4)], ["i", "j", "limb", "value"])


def _totals(partial: DataFrame) -> dict[tuple[int, int], int]:
    """Exact totals of _limbs' rows. Their number depends on the dimension only."""
    out: dict[tuple[int, int], int] = {}
    for r in partial.groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect():
        out[r.i, r.j] = out.get((r.i, r.j), 0) + (r.value << (LIMB * r.limb))
    return out


def primes(least_product: int) -> list[int]:
    """The largest primes below 2**31 until their product passes least_product."""
    out, product, candidate = [], 1, (1 << 31) - 1

    def prime(n: int) -> bool:  # Miller-Rabin with bases that decide all numbers below 2**32
        d, s = n - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        for a in (2, 7, 61):
            x = pow(a, d, n)
            if x in (1, n - 1):
                continue
            for _ in range(s - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
        return True

    while product <= least_product:
        if prime(candidate):
            out.append(candidate)
            product *= candidate
        candidate -= 2
    return out


def charpoly_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant term first, of det(x I - matrix) modulo p: reduction to Hessenberg form, then its recurrence."""
    a, n = matrix % p, len(matrix)
    for k in range(n - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        i = k + 1 + int(below[0])
        if i != k + 1:
            a[[i, k + 1]] = a[[k + 1, i]]
            a[:, [i, k + 1]] = a[:, [k + 1, i]]
        factor = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factor[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factor % p).sum(1)) % p
    poly = np.zeros((n + 1, n + 1), np.int64)
    poly[0, 0] = 1
    for k in range(n):
        poly[k + 1, 1:] = poly[k, :-1]
        poly[k + 1] = (poly[k + 1] - a[k, k] * poly[k] % p) % p
        down = 1
        for i in range(k - 1, -1, -1):
            down = down * int(a[i + 1, i]) % p
            if not down:
                break
            poly[k + 1] = (poly[k + 1] - int(a[i, k]) * down % p * poly[i] % p) % p
    return poly[n]


def variations(poly: list[int], at: int, scale: int) -> int:
    """How many roots lie above at / 2**scale, each as often as it counts. Sign changes of the shifted polynomial tell exactly, as all roots are real."""
    n = len(poly) - 1
    c = [v << (scale * (n - k)) for k, v in enumerate(poly)]
    for i in range(n if at else 0):
        for k in range(n - 1, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def isolate(poly: list[int], top: int, most: int) -> list[tuple[int, int, int, int]]:
    """(count, low, size, scale) of the `top` largest roots above 0, from the largest down: the root is in (low, low + 2**size] / 2**scale.

    Intervals are halved until each holds one root, or roots that no 2**-SPLIT of the whole parts; these count together.
    `most` is above all roots.
    """
    out: list[tuple[int, int, int, int]] = []
    width = most.bit_length()
    # From the largest down: (low, scale, log of width in units of 2**-scale, roots above low, roots above the upper end).
    stack = [(0, 0, width, variations(poly, 0, 0), 0)]
    while stack:
        low, scale, size, above, before = stack.pop()
        if above == before or before >= top:
            continue
        if above - before == 1 or size == 0 and scale >= SPLIT:
            out.append((above - before, low, size, scale))
            continue
        if size == 0:
            low, scale, size = low * 2, scale + 1, 1
        middle = low + (1 << (size - 1))
        there = variations(poly, middle, scale)
        stack += [(low, scale, size - 1, above, there), (middle, scale, size - 1, there, before)]
    return out


def refine(poly: list[int], low: int, size: int, scale: int, bits: int) -> tuple[int, int]:
    """(low, scale) of a single root in (low, low + 1] / 2**scale: its interval halved by the polynomial's sign, to 2**-bits of a whole part of the scale."""
    n = len(poly) - 1

    def sign(at: int, s: int) -> int:
        v = poly[n]
        for k in range(n - 1, -1, -1):
            v = v * at + (poly[k] << (s * (n - k)))
        return (v > 0) - (v < 0)

    low, size, scale = low << bits, size + bits, scale + bits
    upper = sign(low + (1 << size), scale)
    if not upper:
        return low + (1 << size) - 1, scale
    while size:
        size -= 1
        if sign(low + (1 << size), scale) == -upper:
            low += 1 << size
    return low, scale


def null_space(matrix: list[list[int]], count: int, numerator: int, scale: int) -> np.ndarray:
    """`count` unit vectors that span the null space of matrix - root I: inverse iteration with the root at high precision."""
    n = len(matrix)
    size = max(1, max(abs(v) for row in matrix for v in row))
    with localcontext() as ctx:
        ctx.prec = 60 + (size.bit_length() + scale) * 3 // 10
        root = Decimal(2 * numerator + 1) / Decimal(2 << scale)
        a = [[Decimal(v) - (root if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
        tiny = Decimal(size).scaleb(-ctx.prec)
        order = list(range(n))
        for k in range(n):
            p = max(range(k, n), key=lambda i: abs(a[i][k]))
            a[k], a[p], order[k], order[p] = a[p], a[k], order[p], order[k]
            if not a[k][k]:
                a[k][k] = tiny
            for i in range(k + 1, n):
                if a[i][k]:
                    f = a[i][k] / a[k][k]
                    a[i] = a[i][:k] + [f] + [x - f * y for x, y in zip(a[i][k + 1 :], a[k][k + 1 :], strict=True)]
        rng = random.Random(7)
        basis: list[list[Decimal]] = [[Decimal(rng.randint(1, 1 << 30)) for _ in range(n)] for _ in range(count)]
        for _ in range(3):
            done: list[list[Decimal]] = []
            for v in basis:
                x = [v[i] for i in order]
                for i in range(n):
                    x[i] -= sum((a[i][k] * x[k] for k in range(i)), Decimal(0))
                for i in reversed(range(n)):
                    x[i] = (x[i] - sum((a[i][k] * x[k] for k in range(i + 1, n)), Decimal(0))) / a[i][i]
                for _ in range(2):
                    top = max(abs(c) for c in x)
                    x = [c / top for c in x]
                    for d in done:
                        dot = sum((p * q for p, q in zip(x, d, strict=True)), Decimal(0))
                        x = [p - dot * q for p, q in zip(x, d, strict=True)]
                norm = sum((c * c for c in x), Decimal(0)).sqrt()
                done.append([c / norm for c in x])
            basis = done
        out = np.array([[float(c) for c in v] for v in basis])
    # Either sign would do; the largest entry is positive.
    return out * np.sign(out[np.arange(count), np.abs(out).argmax(1)])[:, None]


class Fit:
    """What the fit list says: its size, sums per dimension, components, and eigenvalues of n * n * V as fractions."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, roots: list[Fraction], trace: int):
        self.n, self.sums, self.vectors, self.trace = n, sums, vectors, trace
        self.root = [math.sqrt(r) for r in roots]
        self.explained = [float(r / trace) for r in roots]

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * x - S of each row; whole numbers of any size if they pass 64 bits."""
        if self.n * (int(np.abs(y).max(initial=0)) + 1) + max(map(abs, self.sums)) < 1 << 62:
            return y * self.n - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(np.float64) @ self.vectors.T / np.array(self.root)

    def deviation(self, centred: np.ndarray) -> pa.Array:
        if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < 1 << 63:
            return pa.array((centred**2).sum(1))
        exact = [sum(int(v) ** 2 for v in row) for row in centred]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def characteristic(matrix: list[list[int]], spark, trace: int) -> list[int]:
    """Coefficients of det(x I - matrix) for a positive semidefinite matrix: modulo many primes in tasks, then by Chinese remainders."""
    n = len(matrix)
    bound = max(math.comb(n, k) * (trace**k // n**k + 1) for k in range(n + 1))  # elementary symmetric functions of roots that are not negative
    chosen = primes(2 * bound)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(matrix, dtype=object)
        for b in batches:
            for p in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([charpoly_mod((exact % p).astype(np.int64), p).tolist()], pa.list_(pa.int64()))], ["p", "c"])

    parts = max(1, min(len(chosen), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    table = spark.createDataFrame([(p,) for p in chosen], "p long").repartition(parts, "p")
    found = {r.p: r.c for r in table.mapInArrow(reduce, "p long, c array<long>").collect()}
    product = math.prod(found)
    total = [0] * (n + 1)
    for p, c in found.items():
        rest = product // p
        unit = rest * pow(rest, -1, p)
        total = [(t + unit * v) % product for t, v in zip(total, c, strict=True)]
    return [t - product if 2 * t > product else t for t in total]


def _rows(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    rows = vectors.select(vectors[key].alias("k"), vectors[vector].cast("array<double>").alias("v")).filter(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0].d if sizes else 0
    return rows.filter(F.size("v") == dim), dim


def fit(rows: DataFrame, dim: int, top: int) -> Fit | None:
    """Fit on all rows (k, v). Nothing but sums by dimension, primes' remainders and components comes to the driver."""
    spark = rows.sparkSession

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, n = np.zeros((dim, dim), dtype=object), np.zeros(dim, dtype=object), 0
        for b in batches:
            y = shifted(b.column(0), dim)
            total += gram(y)
            first += y.astype(object).sum(0) if np.abs(y).max(initial=0) >> 40 else y.sum(0).astype(object)
            n += len(y)
        entries = {(i, j): total[i, j] for i in range(dim) for j in range(i, dim)} | {(-1, i): first[i] for i in range(dim)}
        yield _limbs({at: int(v) for at, v in (entries | {(-1, -1): n}).items()})

    total = _totals(rows.select("v").mapInArrow(sums, "i int, j int, limb int, value long"))
    n, s = total.get((-1, -1), 0), [total.get((-1, i), 0) for i in range(dim)]
    matrix = [[n * total[min(i, j), max(i, j)] - s[i] * s[j] for j in range(dim)] for i in range(dim)]
    trace = sum(matrix[i][i] for i in range(dim))
    if not trace:
        return None
    poly = characteristic(matrix, spark, trace)
    found = isolate(poly, top, trace)
    known = [(count, *(refine(poly, low, size, scale, BEYOND) if count == 1 else (low, scale))) for count, low, size, scale in found]

    def components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, count, low, scale in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([null_space(matrix, count, int(low), scale).ravel().tolist()], pa.list_(pa.float64()))], ["place", "c"])

    parts = max(1, min(len(known), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    table = spark.createDataFrame([(i, c, str(low), scale) for i, (c, low, scale) in enumerate(known)], "place int, n int, low string, scale int").repartition(parts, "place")
    made = {r.place: r.c for r in table.mapInArrow(components, "place int, c array<double>").collect()}
    vectors = np.concatenate([np.array(made[i]).reshape(-1, dim) for i in range(len(known))])[:top]
    roots = [Fraction(2 * low + 1, 2 << scale) for c, low, scale in known for _ in range(c)][:top]
    return Fit(n, s, vectors, roots, trace)


def whiten(vectors: DataFrame, top: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each usable vector and component.

    A component c of a vector counts as x = floor(64 c) + 1000000. The scatter matrix of all usable vectors, n * n times
    their covariance, is summed exactly; its characteristic polynomial comes from Hessenberg forms modulo primes, put
    together by Chinese remainders. Its largest roots are isolated by exact counts of sign changes and narrowed by
    halving; inverse iteration with them in high precision gives the components, numbered from the largest root down.
    whitened: (x - mean) along a component over the root of its eigenvalue; explained: the eigenvalue's part of the
    trace; deviation: sum over dimensions of (n x - S)**2, null if it passes a long; identity_error: the largest entry
    of the whitened vectors' covariance less the identity, measured over all of them.

    Vectors that are null or empty, or hold null, non-finite or too large numbers (x beyond 61 bits), have no rows, nor
    those of another length than most have (of equally many, the shorter ones stay). Components with an eigenvalue of 0 have no
    whitened values and no rows: fewer vectors than dimensions, or dimensions that depend on each other, give fewer
    components; a single vector, equal vectors or none give no rows. Equal eigenvalues share an orthonormal basis. Repeated
    rows and null ids are rows like others. Other columns are not read. The driver's work depends on the dimension alone.
    """
    rows, dim = _rows(vectors, key, vector)
    kind = rows.schema["k"].dataType.simpleString()
    out = f"k {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    known = fit(rows, dim, top) if dim else None
    if known is None:
        return rows.sparkSession.createDataFrame([], out).withColumnRenamed("k", key)
    m = len(known.root)
    unit = 1 << 80

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((m, m)), np.zeros(m)
        for b in batches:
            w = known.whitened(known.centred(shifted(b.column(0), dim)))
            total += w.T @ w
            first += w.sum(0)
        # As whole numbers, so that their total doesn't depend on the order of tasks.
        exact = {(i, j): int(Fraction(total[i, j]) * unit) for i in range(m) for j in range(i, m)} | {(-1, i): int(Fraction(first[i]) * unit) for i in range(m)}
        yield _limbs(exact)

    total = _totals(rows.select("v").mapInArrow(moments, "i int, j int, limb int, value long"))
    mean = [Fraction(total[-1, i], unit * known.n) for i in range(m)]
    error = float(max(abs(Fraction(total[i, j], unit * known.n) - mean[i] * mean[j] - (i == j)) for i in range(m) for j in range(i, m)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                b = big.slice(at, 2048)
                d = known.centred(shifted(b.column(1), dim))
                row = np.repeat(np.arange(len(d)), m)
                cols = [b.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(d))), pa.array(np.full(len(row), known.n)), known.deviation(d).take(pa.array(row))]
                cols += [pa.array(known.whitened(d).ravel()), pa.array(np.tile(known.explained, len(d))), pa.array(np.full(len(row), error))]
                yield pa.RecordBatch.from_arrays(cols, ["k", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, out).withColumnRenamed("k", key)
