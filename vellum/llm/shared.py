"""Folders that the driver and all executors share, and small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a table that come to the driver for range bounds, at most about; and ranges.
SAMPLE_KEYS = 1_000_000
MOST_RANGES = 50_000
#: Tasks of a step over a table that needs fewer.
LEAST_TASKS = 12


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's spark.checkpoint.dir. Only a local master may do without it, with a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vellum-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: the lineage ends there."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fewer(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """df in no more tasks than `rows` rows need, LEAST_TASKS at least: short steps that are made again and again don't each deal their rows to all partitions."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // per_task)))


def range_bounds(df: DataFrame, key: str, rows: int = 20_000) -> np.ndarray:
    """Ascending bounds that cut the whole-number key into ranges of about `rows` rows; range k is searchsorted(bounds, key).

    The bounds are quantiles of a sample of the keys, SAMPLE_KEYS at most, so the driver's work is bounded; so
    is their number, by MOST_RANGES (ranges of larger tables have more rows).
    """
    total = df.count()
    n = min(MOST_RANGES, -(-total // rows))
    if n < 2:
        return np.zeros(0, np.int64)
    share = min(1.0, SAMPLE_KEYS / 2 / total)
    some = df.select(F.col(key).alias("k")).filter(F.col("k").isNotNull())
    if share < 1:
        some = some.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30)))
    keys = np.sort(some.limit(SAMPLE_KEYS).toArrow().column("k").to_numpy())
    return np.unique(keys[(np.arange(1, n) * len(keys)) // n]) if len(keys) else keys
