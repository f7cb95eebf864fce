"""A points table sorted by id on disk, read page by page from where the last page ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Scroll:
    """points/part=K holds the rows of the K-th range of ids, sorted; bounds has the least and largest id and the count of each part."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id"):
        self.spark, self.path, self.key = spark, path, key
        self.schema = spark.read.parquet(f"{path}/schema").schema
        self.bounds = [(r.part, r.low, r.high) for r in spark.read.parquet(f"{path}/bounds").orderBy("part").collect()]

    @classmethod
    def write(cls, points: DataFrame, path: str, key: str = "chunk_id", parts: int = 32) -> Scroll:
        """Sort points (without vectors; rows without an id go) into at most `parts` ranges of ids."""
        rows = points.drop("embedding").filter(F.col(key).isNotNull())
        cut = rows.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()).sortWithinPartitions(key)
        points.sparkSession.createDataFrame([], cut.schema).write.parquet(f"{path}/schema")
        cut.write.partitionBy("part").parquet(f"{path}/points")
        found = points.sparkSession.read.schema(cut.schema).parquet(f"{path}/points")
        found.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/bounds")
        return cls(points.sparkSession, path, key)

    def page(self, n: int, after=None, **equal) -> DataFrame:
        """The first n rows by id with an id above `after` that equal the given payload values.

        Ids need to be unique, as the next page begins above the last id of this one. Parts that end at or before `after` aren't
        read; of the others, twice as many each time until n rows are found.
        """
        left = [part for part, _, high in self.bounds if after is None or high > after]
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/points")
        for column, value in equal.items():
            rows = rows.filter(F.col(column) == value)
        if after is not None:
            rows = rows.filter(F.col(self.key) > after)
        take = 1
        while True:
            some = rows.filter(F.col("part").isin(left[:take])) if take < len(left) else rows.filter(F.col("part").isin(left))
            if take >= len(left) or some.limit(n).count() >= n:
                return some.drop("part").orderBy(self.key).limit(n)
            take *= 2
