"""The table of vector points: payloads, upserts, search and inspection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.sources.shared import settle

#: A query side of at most so many rows is broadcast in cosine_topk.
BROADCAST_ROWS = 10_000
#: Rows and numbers of a pack of vectors at most, and queries that meet a pack at once.
PACK_ROWS, PACK_NUMBERS, STRIP = 16_384, 1 << 20, 256


def payload(chunks: DataFrame) -> DataFrame:
    """Chunks as (chunk_id, source, page, type, text, doc_hash); type text if missing."""
    return chunks.select("chunk_id", "source", F.col("page_number").alias("page"), F.coalesce("type", F.lit("text")).alias("type"), F.col("clean_text").alias("text"), "doc_hash")


def upsert_points(stored: DataFrame, batch: DataFrame, key: str = "chunk_id") -> DataFrame:
    """stored with the rows of batch inserted or put in place of those with their key. The last of equal keys in a table stays by order of all its columns."""
    # Whole rows in one column, so that no name of theirs can clash. The last row of a key is a maximum, so that tasks send one row for each key.
    rest = [c for c in stored.columns if c != key]
    rows = lambda df, n: df.select(df[key].alias("key"), F.struct(F.lit(n).alias("batch"), F.struct(*(df[c] for c in rest)).alias("row")).alias("last"))
    met = rows(stored, 0).union(rows(batch, 1)).groupBy("key").agg(F.max("last").alias("last"))
    return met.select(*(F.col("key").alias(c) if c == key else F.col("last.row")[c].alias(c) for c in stored.columns))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null if one is all zeros."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k largest of each row by score to 9 digits, ties to smaller columns; NaN is largest, as in Spark."""
    scores[np.isnan(scores)] = np.inf
    n, m = scores.shape
    if m <= k:
        row, column = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    else:
        least = np.partition(scores, m - k, axis=1)[:, m - k]
        row, column = np.nonzero(scores >= (least - 2e-9)[:, None])
    score = np.round(scores[row, column], 9)
    order = np.lexsort((column, -score, row))
    first = np.searchsorted(row[order], np.arange(n))
    order = order[np.arange(len(order)) - first[row[order]] < k]
    return row[order], column[order], np.where(np.isposinf(score[order]), np.nan, score[order])


def _packed(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows (id, v, norm) as packs of at most PACK_ROWS and about PACK_NUMBERS numbers: ids (in order), numbers and norms as bytes of doubles, and the vectors' size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                some = b.filter(pa.array(sizes == dim))
                step = max(1, min(PACK_ROWS, PACK_NUMBERS // max(1, int(dim))))
                for lo in range(0, some.num_rows, step):
                    part = some.slice(lo, step)
                    part = part.take(pc.sort_indices(part.column(0), null_placement="at_start"))
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                    numbers, norms = (c.to_numpy(zero_copy_only=False).astype(np.float64).tobytes() for c in (part.column(1).flatten(), part.column(2)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([numbers], pa.binary()), pa.array([norms], pa.binary()), pa.array([dim], pa.int32())], [prefix + c for c in ("ids", "numbers", "norms", "dim")])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "v", "norm").mapInArrow(run, f"{prefix}ids array<{kind}>, {prefix}numbers binary, {prefix}norms binary, {prefix}dim int")


def cosine_topk(points: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest points of each query, best first, ties to smaller ids.

    A stated query set against all points, exact: points are dealt out and packed, and each pack meets the queries in matrix
    products, of which it keeps k for each query. Queries are broadcast in packs, at most BROADCAST_ROWS of them for one pass over the points.
    """
    shaped = lambda df: df.select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v")))).filter("norm > 0")
    spark, q = points.sparkSession, shaped(queries)
    p = settle(_packed(shaped(points).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "p_"), "packs")
    n = q.count()
    blocks = max(1, -(-n // BROADCAST_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                pids, qids = b.column(0)[i].values, b.column(4)[i].values
                x, pn, y, qn = (np.frombuffer(b.column(c)[i].as_buffer()) for c in (1, 2, 5, 6))
                if b.column(3)[i] != b.column(7)[i]:  # vectors of another size have no score, and come last
                    m = min(k, len(pids))
                    at, near = np.repeat(np.arange(len(qids)), m), np.tile(np.arange(m), len(qids))
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(at)), pids.take(pa.array(near)), pa.nulls(len(at), pa.float64())], ["query_id", key, "score"])
                    continue
                x, y = x.reshape(len(pids), -1), y.reshape(len(qids), -1)
                for lo in range(0, len(y), STRIP):
                    with np.errstate(all="ignore"):
                        at, near, score = best(y[lo : lo + STRIP] @ x.T / (qn[lo : lo + STRIP, None] * pn), k)
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(at + lo)), pids.take(pa.array(near)), pa.array(score)], ["query_id", key, "score"])

    id_type, query_type = points.schema[key].dataType.simpleString(), queries.schema[key].dataType.simpleString()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    out = None
    for i in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)
        met = p.crossJoin(F.broadcast(_packed(part.coalesce(1), "q_"))).mapInArrow(run, f"query_id {query_type}, `{key}` {id_type}, score double")
        top = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out = top if out is None else out.unionByName(top)
    return out


def vector_guard(points: DataFrame, dim: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(points whose vector has dim numbers, the others with a reason)."""
    good = F.coalesce(F.size(vector) == dim, F.lit(False))
    reason = F.when(F.col(vector).isNull(), "no vector").otherwise(F.concat(F.lit("size "), F.size(vector).cast("string")))
    return points.filter(good), points.filter(~good).withColumn("reason", reason)


def batch_embed(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(chunks with their vector from a keyed table, chunks without one)."""
    return chunks.join(vectors, key), chunks.join(vectors.select(key), key, "left_anti")


def hashed_vectors(chunks: DataFrame, dim: int = 384, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, embedding): unit term-frequency vectors over hashed words, for use without a model."""
    words = Tokenizer(inputCol=text, outputCol="_w").transform(chunks.select(key, F.coalesce(text, F.lit("")).alias(text)))
    tf = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim).transform(words)
    return Normalizer(inputCol="_tf", outputCol="_v").transform(tf).select(key, vector_to_array("_v", "float32").alias("embedding"))


def payload_scroll(points: DataFrame, n: int, **equal) -> DataFrame:
    """The first n points by id that equal the given payload values, without vectors."""
    for column, value in equal.items():
        points = points.filter(F.col(column) == value)
    return points.drop("embedding").orderBy("chunk_id").limit(n)


def list_sources(points: DataFrame) -> DataFrame:
    """Distinct sources, sorted."""
    return points.select("source").filter("source IS NOT NULL").distinct().orderBy("source")


def payload_preview(points: DataFrame, most: int = 2000) -> DataFrame:
    """(chunk_id, kind, preview, truncated, metadata): text cut to `most` characters, the other fields as JSON."""
    text = F.coalesce("text", F.lit(""))
    rest = [c for c in points.columns if c not in ("text", "embedding", "ocr_evidence", "html")]
    return points.select("chunk_id", F.upper(F.coalesce("type", F.lit("unknown"))).alias("kind"), F.substring(text, 1, most).alias("preview"), (F.length(text) > most).alias("truncated"), F.to_json(F.struct(*rest)).alias("metadata"))
