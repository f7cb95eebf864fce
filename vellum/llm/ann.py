"""Approximate nearest neighbours by inner product: balanced posting lists behind a graph of centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that share a list part at most, roughly; and the most lists, so that centroids stay small.
PART_ROWS = 8_192
MOST_LISTS = 4_096
MOST_COPIES = 4


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not all zeros."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Arrow list column of equal lengths as a float64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))


def lift(x: np.ndarray, radius: float) -> np.ndarray:
    """One more coordinate brings every vector to the norm `radius`: the nearest is then the largest inner product."""
    return np.hstack((x, np.sqrt(np.maximum(radius**2 - (x**2).sum(1), 0))[:, None]))


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of lists of about equal size: a full list's centroid counts as farther away."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    price = np.zeros(k)
    for _ in range(rounds):
        d = distances(x, c) ** 2
        own = np.argmin(d + price, 1)
        n = np.bincount(own, minlength=k)
        price += 0.1 * d.min(1).mean() * (n * k / len(x) - 1)
        price = np.clip(price, 0, None)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


@dataclass
class Index:
    """What tasks need to place a vector and to find a query's lists: centroids, their graph, two ratios."""

    dim: int
    radius: float
    centroids: np.ndarray
    links: np.ndarray
    copy_ratio: float
    list_ratio: float
    parts: np.ndarray

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every posting: a vector goes to its nearest list, and if it lies at a boundary to the others that are nearly as near."""
        d = distances(lift(x, self.radius), self.centroids)
        near = np.argsort(d, 1, kind="stable")[:, :MOST_COPIES]
        dn = np.take_along_axis(d, near, 1)
        keep = dn <= (1 + self.copy_ratio) * dn[:, :1]
        keep[:, 0] = True
        row, place = np.nonzero(keep)
        return row, near[row, place]

    def lists(self, q: np.ndarray) -> list[np.ndarray]:
        """The lists to read for each query: best-first walk on the centroid graph, pruned by distance ratio."""
        q = np.hstack((q * (self.radius / np.linalg.norm(q, axis=1))[:, None], np.zeros((len(q), 1))))
        k, n = len(self.centroids), len(q)
        rows = np.arange(n)
        d = np.full((n, k), np.inf)
        open_ = np.zeros((n, k), bool)
        start = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(int))
        d[:, start] = distances(q, self.centroids[start])
        open_[:, start] = True
        active = np.ones(n, bool)
        steps = 0
        while active.any():
            best = np.where(open_, d, np.inf)
            pick = best.argmin(1)
            value = best[rows, pick]
            # A few steps beyond the ratio let the walk leave a local minimum.
            active &= np.isfinite(value) & ((value <= (1 + self.list_ratio) * d.min(1)) | (steps < 24))
            r = rows[active]
            if not len(r):
                break
            open_[r, pick[active]] = False
            near = self.links[pick[active]]
            new = ~np.isfinite(d[r[:, None], near])
            gap = np.sqrt(((q[r][:, None, :] - self.centroids[near]) ** 2).sum(2))
            rr, cc = np.nonzero(new)
            d[r[rr], near[rr, cc]] = gap[rr, cc]
            open_[r[rr], near[rr, cc]] = True
            steps += 1
        return [np.flatnonzero(row <= (1 + self.list_ratio) * row.min()) for row in d]


def fit(x: np.ndarray, total: int, radius: float, copy_ratios: tuple[float, ...] = (0.005, 0.01, 0.02, 0.05), recall: float = 0.97, top: int = 20) -> Index:
    """Fit on a sample x of `total` vectors. The ratios are calibrated on the sample: for each copy ratio the smallest
    list ratio with which the sample's own queries find the wanted part of their true neighbours within the sample, and of
    these pairs the one with which they read the fewest vectors."""
    k = int(np.clip(np.sqrt(total) / 2, 1, min(MOST_LISTS, max(1, len(x) // 16))))
    y = lift(x, radius)
    c = balanced_kmeans(y, k)
    d = distances(c, c)
    np.fill_diagonal(d, np.inf)
    degree = min(k - 1, 16)
    links = np.argsort(d, 1, kind="stable")[:, :degree] if k > 1 else np.zeros((1, 1), int)
    if k > 1:  # a ring and a few long links keep the graph connected
        ring = np.stack([(np.arange(k) + s) % k for s in (1, k // 2, k // 3 + 1)], 1)
        links = np.hstack((links, ring))
    q = x[: min(len(x), 300)]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    t = min(top, len(x) - 1)
    true = np.argpartition(-s, t - 1, 1)[:, :t] if t > 0 else np.zeros((len(q), 0), int)
    dq = distances(np.hstack((q * (radius / np.linalg.norm(q, axis=1))[:, None], np.zeros((len(q), 1)))), c)
    best = None
    for copy_ratio in copy_ratios:
        index = Index(x.shape[1], radius, c, links, copy_ratio, 0.0, np.ones(k, int))
        row, home = index.homes(x)
        size = np.bincount(home, minlength=k)
        index.parts = np.maximum(1, -(-size * total // (len(x) * PART_ROWS)))
        if t > 0:
            homes = np.full((len(x), MOST_COPIES), -1)
            first = np.searchsorted(row, np.arange(len(x)))
            homes[row, np.arange(len(row)) - first[row]] = home
            reach = np.where(homes[true] >= 0, np.take_along_axis(dq, homes[true].reshape(len(q), -1), 1).reshape(homes[true].shape), np.inf).min(2)
            index.list_ratio = float(np.quantile(reach / dq.min(1)[:, None], recall)) - 1 + 1e-9
        work = ((dq <= (1 + index.list_ratio) * dq.min(1)[:, None]) * size).sum()
        if best is None or work < best[0]:
            best = (work, index)
    return best[1]


def top_by_score(q: np.ndarray, qtag: np.ndarray, x: np.ndarray, xtag: np.ndarray, xid: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in x, score) of the best of x for each query, ties to smaller ids; a query never finds its own row.

    Products in single precision choose, with a margin for their rounding; those that are left are scored exactly.
    """
    s = q.astype(np.float32) @ x.T.astype(np.float32)
    own = np.searchsorted(xtag, qtag)
    own[own == len(xtag)] = 0
    mine = np.flatnonzero(xtag[own] == qtag)
    s[mine, own[mine]] = -np.inf
    if len(x) > top:
        bound = np.partition(s, len(x) - top, axis=1)[:, len(x) - top]
        margin = 1e-5 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        i, j = np.nonzero(s >= (bound - margin)[:, None])
    else:
        i, j = np.nonzero(np.isfinite(s))
    # Overflow in single precision would hide rows: the margin is not a number then, so all are scored.
    if not np.isfinite(s).sum() == s.size - len(mine):
        i, j = np.nonzero(np.ones(s.shape, bool))
        stay = xtag[j] != qtag[i]
        i, j = i[stay], j[stay]
    exact = np.zeros(len(i))  # products added in order of components: equal vectors give equal scores
    for c in range(q.shape[1]):
        exact += q[i, c] * x[j, c]
    order = np.lexsort((xid[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    stay = np.arange(len(i)) - np.searchsorted(i, i) < top
    return i[stay], j[stay], exact[stay]


def nearest(vectors: DataFrame, queries: Column, top: int = 20, sample_rows: int = 20_000, recall: float = 0.97, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest found of each row for which `queries` holds.

    Nearness is the inner product in double precision; ties go to the smaller id; a row isn't its own
    neighbour. Every usable vector is indexed; centroids, graph and ratio are fitted on at most
    sample_rows of them (those with the smallest hashes). Unusable vectors (null, empty, zero, with null
    or non-finite components, or of another length than most), and rows with a null id, take no part.
    Of rows that repeat an id, each is a candidate, and a query of its own if it asks. Other columns are not read.
    Placing a vector measures all centroids, which are MOST_LISTS at most; beyond that, lists are split in parts.
    """
    rows = vectors.filter(queries.isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("ask"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("tag", F.monotonically_increasing_id())
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], out)
    dim, total = sizes[0]["n"], sizes[0]["count"]
    rows = rows.filter(F.size("v") == dim)
    radius = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()
    index = fit(matrix(sample.column("v").combine_chunks(), dim), total, radius, recall=recall, top=top)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                b = big.slice(at, 1024)
                ids, ask, tag = b.column(0), b.column(2).to_numpy(zero_copy_only=False), b.column(3)
                x = matrix(b.column(1), dim)
                row, home = index.homes(x)
                part = tag.to_numpy()[row] % index.parts[home]
                found = [(row, home, part, np.zeros(len(row), np.int8))]
                asking = np.flatnonzero(ask)
                for r, lists in zip(asking, index.lists(x[asking]) if len(asking) else [], strict=True):
                    n = index.parts[lists]
                    to = np.repeat(lists, n)
                    found.append((np.full(len(to), r), to, np.arange(len(to)) - np.repeat(np.cumsum(n) - n, n), np.ones(len(to), np.int8)))
                row, home, part, kind = (np.concatenate(c) for c in zip(*found, strict=True))
                # Vectors that single precision holds exactly are sent so.
                small = x.astype(np.float32)
                same = (small == x).all(1)
                raw = pa.array([small[r].tobytes() if same[r] else x[r].tobytes() for r in range(len(x))], pa.binary()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(kind), ids.take(pa.array(row)), raw, tag.take(pa.array(row))], ["list", "part", "kind", "id", "raw", "tag"])

    def unpack(raw: list[bytes]) -> np.ndarray:
        if all(len(r) == 4 * dim for r in raw):
            return np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim).astype(np.float64)
        return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64).astype(np.float64) for r in raw])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, body = None, [], None
        for big in batches:
            place = np.stack([big.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1), big.num_rows]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                b = big.slice(i, j - i)
                if at != tuple(place[i, :2]):
                    at, held, body = tuple(place[i, :2]), [], None
                v, ids, tag = unpack(b.column(4).to_pylist()), b.column(3).to_numpy(), b.column(5).to_numpy()
                if not place[i, 2]:
                    held.append((v, ids, tag))
                    continue
                if not held:
                    continue
                if body is None:
                    body = [np.concatenate(c) for c in zip(*held, strict=True)]
                    order = np.argsort(body[2])
                    body = [c[order] for c in body]
                x, xid, xtag = body
                for q in range(0, len(v), 512):
                    who, what, score = top_by_score(v[q : q + 512], tag[q : q + 512], x, xtag, xid, top)
                    cut = np.searchsorted(who, np.arange(len(v[q : q + 512]) + 1))
                    packed = [pa.array([c[a:z].tobytes() for a, z in zip(cut, cut[1:], strict=False)], pa.binary()) for c in (xid[what], xtag[what], score)]
                    yield pa.RecordBatch.from_arrays([b.column(5).slice(q, 512), b.column(3).slice(q, 512), *packed], ["tag", "query_id", "ids", "tags", "scores"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for q, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids, tags = (np.frombuffer(b"".join(f[c] for f in found), np.int64) for c in ("ids", "tags"))
                scores = np.frombuffer(b"".join(f["scores"] for f in found), np.float64)
                _, first = np.unique(tags, return_index=True)  # copies of one row are in several lists
                first = first[np.lexsort((ids[first], -scores[first]))][:top]
                rows.append((np.full(len(first), q), np.arange(1, len(first) + 1, dtype=np.int32), ids[first], scores[first]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["query_id", "rank", "vec_id", "score"])

    n = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    dealt = rows.mapInArrow(deal, "list int, part int, kind byte, id long, raw binary, tag long")
    met = dealt.repartition(n, "list", "part").sortWithinPartitions("list", "part", "kind")
    found = met.mapInArrow(search, "tag long, query_id long, ids binary, tags binary, scores binary")
    return found.groupBy("tag", "query_id").agg(F.collect_list(F.struct("ids", "tags", "scores")).alias("found")).mapInArrow(merge, out)
