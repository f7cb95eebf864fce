"""A table kept on disk as snapshots of hashed buckets: an update writes only the buckets that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "bucket int, written long"


class Snapshots:
    """Rows in `buckets` buckets by a hash of `key`, in a shared folder.

    data/version=N/bucket=B holds the rows of a bucket as update N wrote them; snapshots/version=N, written last as one file,
    lists the version of each bucket's data. So a snapshot is there whole or not at all, older ones stay readable, and a
    failed update is written over by the next. One writer at a time: of two, the one that publishes a version last fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.schema = spark.read.parquet(f"{path}/schema").schema
        about = spark.read.parquet(f"{path}/about").first()
        self.key, self.buckets = about["key"], about["buckets"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64) -> Snapshots:
        """An empty store, version 0."""
        spark.createDataFrame([], schema).write.parquet(f"{path}/schema")
        spark.createDataFrame([(key, buckets)], "key string, buckets int").coalesce(1).write.parquet(f"{path}/about")
        spark.createDataFrame([], MANIFEST).write.parquet(f"{path}/snapshots/version=0")
        return cls(spark, path)

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema(f"{MANIFEST}, version long").parquet(f"{self.path}/snapshots")

    def version(self) -> int:
        """The newest whole snapshot."""
        return self._manifests().agg(F.max("version")).first()[0] or 0

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Bucket -> the version that wrote its rows; buckets without rows are left out."""
        version = self.version() if version is None else version
        return {r.bucket: r.written for r in self._manifests().filter(F.col("version") == version).collect()}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a snapshot, the newest if none is named."""
        return self._read(self.manifest(version))

    def _read(self, manifest: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/version={written}/bucket={bucket}" for bucket, written in sorted(manifest.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def update(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Put merge(rows of the touched buckets, batch) in place of these rows, and publish; gives the new version.

        The touched buckets are those of the batch's keys; merge returns rows with keys of these only. An empty batch changes nothing.
        """
        touched = sorted(r.b for r in batch.select(self.bucket_of(F.col(self.key)).alias("b")).distinct().collect())
        version = self.version()
        if not touched:
            return version
        old, new = self.manifest(version), version + 1
        rows = merge(self._read({b: w for b, w in old.items() if b in set(touched)}), batch).select(*self.schema.names)
        target = f"{self.path}/data/version={new}"
        # A bucket with very many rows is several files: Spark splits large partitions of a rebalance.
        rows.withColumn("bucket", self.bucket_of(F.col(self.key))).hint("rebalance", "bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(target)
        written = [r.bucket for r in self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(target).select("bucket").distinct().collect()]
        if set(written) - set(touched):
            raise ValueError("merge gave rows of other buckets than the batch's")
        kept = {b: w for b, w in old.items() if b not in set(touched)} | dict.fromkeys(written, new)
        self.spark.createDataFrame(sorted(kept.items()), MANIFEST).coalesce(1).write.parquet(f"{self.path}/snapshots/version={new}")
        return new
