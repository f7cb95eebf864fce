"""Approximate search of the points table by random-projection buckets, for point sets beyond an exact scan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators.index import STRIP, best, dot
from vellum.sources.shared import settle

#: Points that are measured to choose the buckets; and limits of the choice.
SAMPLE_ROWS = 2_000
SAMPLE_QUERIES = 200
MOST_TABLES = 64
MOST_DEPTH = 12
#: Points of a bucket that meet its queries at once.
BLOCK_ROWS = 32_768


@dataclass
class Buckets:
    """How points are put into buckets: `tables` times, each by `depth` random projections cut into stretches of `width`."""

    width: float
    depth: int
    tables: int
    recall: float
    share: float


def meet(distance: np.ndarray, width: float, dim: int) -> np.ndarray:
    """Chance that one projection on a random unit vector puts two points of a distance into one stretch."""
    s = np.maximum(distance / np.sqrt(dim + 1), 1e-12)  # one more coordinate, as in shifted()
    t = width / s
    # The standard normal distribution at -t, by a rational formula with an error below 1e-7.
    k = 1 / (1 + 0.2316419 * t)
    tail = np.exp(-(t**2) / 2) / np.sqrt(2 * np.pi) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return np.clip(1 - 2 * tail - 2 / (np.sqrt(2 * np.pi) * t) * (1 - np.exp(-(t**2) / 2)), 0, 1)


def choose(sample: np.ndarray, total: int, k: int, recall: float) -> Buckets:
    """The buckets that let the fewest points be read among those that find `recall` of the k nearest of `total` unit vectors, by a sample of them.

    The sample's neighbours at the same quantile stand for those in the whole table; where the sample is a part of the table, its neighbours
    are no nearer than the real ones, so the choice errs to the side of recall.
    """
    n, dim = sample.shape
    q = sample[:SAMPLE_QUERIES]
    d = np.sqrt(np.maximum(2 - 2 * q @ sample.T, 0))
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    d.sort(axis=1)
    if n < 2:
        return Buckets(1.0, 1, 1, 1.0, 1.0)
    even = (np.arange(400) + 0.5) / 400  # quantiles stand for all distances
    near, every = np.quantile(d[:, : min(k, n - 1)], even), np.quantile(d[:, : n - 1], even)
    best = None
    for width in np.array([0.5, 1, 2, 4, 8]) * max(float(np.median(near)), 1e-6) / np.sqrt(dim):
        p, r = meet(near, width, dim), meet(every, width, dim)
        for depth in range(1, MOST_DEPTH + 1):
            for tables in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, MOST_TABLES):
                found = float((1 - (1 - p**depth) ** tables).mean())
                share = float((1 - (1 - r**depth) ** tables).mean())
                if found >= recall:
                    # Each table costs a row for each point, each candidate a product.
                    cost = share + tables / max(total, 1)
                    if best is None or cost < best[0]:
                        best = (cost, Buckets(float(width), depth, tables, found, share))
                    break
    # Single wide stretches find nearly all; if even these don't, the widest choice stands.
    return best[1] if best else Buckets(float(16 * np.median(near) / np.sqrt(dim)), 1, MOST_TABLES, 0.0, 1.0)


def shifted(vector: Column, width: float, dim: int) -> Column:
    """The vector with one more coordinate, the same for all, by which each projection's stretches begin at a place of their own."""
    return array_to_vector(F.concat(vector, F.array(F.lit(20 * width * float(np.sqrt(dim + 1))))))


class LshIndex:
    """Unit vectors in random-projection buckets: `model` draws the projections, `buckets` says how they are put together."""

    def __init__(self, model: BucketedRandomProjectionLSHModel, buckets: Buckets, dim: int):
        self.model, self.buckets, self.dim = model, buckets, dim

    def keys(self, rows: DataFrame, columns: list[str], vector: str) -> DataFrame:
        """A row (columns, table, bucket) for each table."""
        b = self.buckets
        hashed = self.model.transform(rows.withColumn("_features", shifted(F.col(vector), b.width, self.dim)))
        values = F.transform("_hashes", lambda h: vector_to_array(h)[0].cast("long"))
        table = F.transform(F.sequence(F.lit(0), F.lit(b.tables - 1)), lambda t: F.struct(t.alias("table"), F.xxhash64(F.slice(F.col("_values"), t * b.depth + 1, b.depth)).alias("bucket")))
        return hashed.withColumn("_values", values).select(*columns, F.explode(table).alias("_t")).select(*columns, "_t.table", "_t.bucket")


def unit(points: DataFrame, key: str, vector: str, *others: str) -> DataFrame:
    """(id, u, others): vectors of norm 1 in double precision; those of norm 0, and null, empty or non-finite ones, go."""
    rows = points.select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), *others)
    # A struct in an array holds the norm, so that it is worked out once for a vector and not for each of its numbers.
    once = F.array(F.struct(F.col("v").alias("v"), F.sqrt(dot(F.col("v"), F.col("v"))).alias("norm")))
    made = F.transform(once, lambda s: F.when((s["norm"] > 0) & (s["norm"] < float("inf")), F.transform(s["v"], lambda x: x / s["norm"])))[0]
    return rows.select("id", made.alias("u"), *others).filter("u IS NOT NULL")


def lsh_fit(points: DataFrame, k: int, recall: float = 0.97, seed: int = 7) -> LshIndex | None:
    """Buckets for unit vectors (id, u), chosen by at most SAMPLE_ROWS of them; None if there are none."""
    sizes = points.groupBy(F.size("u").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return None
    dim, total = sizes[0]["d"], sizes[0]["count"]
    some = points.filter(F.size("u") == dim).orderBy(F.xxhash64("id", "u")).limit(SAMPLE_ROWS)
    buckets = choose(np.array([r.u for r in some.select("u").collect()]), total, k, recall)
    lsh = BucketedRandomProjectionLSH(inputCol="_features", outputCol="_hashes", bucketLength=buckets.width, numHashTables=buckets.tables * buckets.depth, seed=seed)
    return LshIndex(lsh.fit(some.limit(1).select(shifted(F.col("u"), buckets.width, dim).alias("_features"))), buckets, dim)


def _held(found: DataFrame, k: int) -> DataFrame:
    """(head, u, ids): each different unit vector of (id, u) once, with its k smallest ids and the smallest of them."""
    first = Window.partitionBy("u").orderBy("id")
    return found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k).groupBy("u").agg(F.min("id").alias("head"), F.sort_array(F.collect_set("id")).alias("ids"))


def _met(index: LshIndex, held: DataFrame, places: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank) of queries (query_id, q), from points that share a bucket with them.

    No pairs are shuffled: a bucket's points, in blocks of about BLOCK_ROWS, stand before the queries that have the bucket, which are
    scored in matrix products as they pass; each block gives k points for each query. The points of different tables that agree are one.
    """
    place = ["table", "bucket"]
    blocks = places.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    spare = {f.name: F.lit(None).cast(f.dataType) for f in (held.schema["head"], queries.schema["query_id"])}
    stored = places.join(blocks.hint("merge"), place).join(held.select("head", F.col("u").alias("v")).hint("merge"), "head")
    stored = stored.select(*place, F.pmod(F.xxhash64("head"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "head", spare["query_id"].alias("query_id"), "v")
    asked = index.keys(queries, ["query_id"], "q").join(blocks.hint("merge"), place).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.join(queries.hint("merge"), "query_id").select(*place, "block", F.lit(1).alias("side"), spare["head"].alias("head"), "query_id", F.col("q").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads, vectors = None, [], []
        for b in batches:
            key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(3)], 1)
            side, v = b.column(3).to_numpy(), b.column(6).flatten().to_numpy().reshape(b.num_rows, -1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True):
                if at != tuple(key[lo]):
                    at, heads, vectors = tuple(key[lo]), [], []
                if side[lo] == 0:
                    heads.append(b.column(4).slice(lo, hi - lo))
                    vectors.append(v[lo:hi])
                elif heads:
                    if len(heads) > 1:
                        heads, vectors = [pa.concat_arrays(heads)], [np.concatenate(vectors)]
                    for q in range(lo, hi, STRIP):
                        who, near, score = best(v[q : min(q + STRIP, hi)] @ vectors[0].T, k)
                        yield pa.RecordBatch.from_arrays([b.column(5).take(pa.array(who + q)), heads[0].take(pa.array(near)), pa.array(score)], ["query_id", "head", "score"])

    order = [*place, "block", "side", "head"]
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored.unionByName(asked).repartition(parts, *place, "block").sortWithinPartitions(*order)
    kinds = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n, df in (("query_id", queries), ("head", held)))
    met = rows.mapInArrow(run, f"{kinds}, score double").groupBy("query_id", "head").agg(F.max("score").alias("score"))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "head")
    near = met.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k)
    scored = near.join(held.select("head", "ids").hint("merge"), "head").select("query_id", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def cosine_topk_lsh(points: DataFrame, asks: Column, k: int = 10, recall: float = 0.97, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): about the k nearest points by cosine of each row of points for which `asks` holds, itself included; ties to smaller ids.

    Points and queries meet by (table, bucket), hashes of random projections, and are scored exactly there. Buckets are chosen so that a sample's neighbours are found with a chance of `recall`.
    Equal vectors are one point with its k smallest ids, so that copies do not fill buckets; rows without a
    direction (null, empty, zero or non-finite vectors), of another length than most, or without an id take no part.
    """
    rows = points.filter(F.col(key).isNotNull()).withColumn("_asks", F.coalesce(asks, F.lit(False)))
    found = settle(unit(rows, key, vector, "_asks"), "unit")
    index = lsh_fit(found, k, recall)
    if index is None:
        return points.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    found = found.filter(F.size("u") == index.dim)
    held = settle(_held(found, k), "points")
    return _met(index, held, index.keys(held, ["head"], "u"), found.filter("_asks").select(F.col("id").alias("query_id"), F.col("u").alias("q")), k)


class LshStore:
    """Points in their buckets on disk, made once and searched with any queries: points (head, u, ids), places (table, bucket, head), the projections, and what was chosen."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        a = spark.read.parquet(f"{path}/about").first()
        self.k = a.k
        self.index = LshIndex(BucketedRandomProjectionLSHModel.load(f"{path}/projections"), Buckets(a.width, a.depth, a.tables, a.recall, a.share), a.dim)

    @classmethod
    def build(cls, points: DataFrame, path: str, k: int = 10, recall: float = 0.97, key: str = "vec_id", vector: str = "embedding") -> LshStore:
        """Index the points as cosine_topk_lsh() would, for searches of k neighbours at most. Without any usable point there is nothing to build, an error."""
        spark = points.sparkSession
        found = settle(unit(points.filter(F.col(key).isNotNull()), key, vector), "unit")
        index = lsh_fit(found, k, recall)
        if index is None:
            raise ValueError("no points to index")
        b = index.buckets
        _held(found.filter(F.size("u") == index.dim), k).write.parquet(f"{path}/points")
        places = index.keys(spark.read.parquet(f"{path}/points"), ["head"], "u")
        # In order of the join's keys, so that files hold ranges of buckets.
        places.repartitionByRange("table", "bucket").sortWithinPartitions("table", "bucket").write.parquet(f"{path}/places")
        index.model.save(f"{path}/projections")
        spark.createDataFrame([(index.dim, k, b.width, b.depth, b.tables, b.recall, b.share)], "dim int, k int, width double, depth int, tables int, recall double, share double").write.parquet(f"{path}/about")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int | None = None, key: str = "query_id", vector: str = "embedding") -> DataFrame:
        """(query_id, vec_id, score, rank) of queries (key, vector), any vectors of the points' length; those without a direction find nothing."""
        k = self.k if k is None else k
        if k > self.k:
            raise ValueError(f"the index was built for {self.k} neighbours")
        asked = settle(unit(queries.filter(F.col(key).isNotNull()), key, vector).filter(F.size("u") == self.index.dim).select(F.col("id").alias("query_id"), F.col("u").alias("q")), "queries")
        read = lambda name: self.spark.read.parquet(f"{self.path}/{name}")
        return _met(self.index, read("points"), read("places"), asked, k)
