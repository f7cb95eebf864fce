"""The store of bucketed snapshots."""

import os

import pytest
from pyspark.sql import functions as F

from vellum.operators.index import upsert_points
from vellum.sources.snapshots import Snapshots

SCHEMA = "chunk_id string, page long, text string"


def rows(spark, values):
    return spark.createDataFrame(values, SCHEMA)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(path, bucket):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") if d.endswith(f"bucket={bucket}") for f in names if f.endswith(".parquet")}


def test_updates_touch_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    store = Snapshots.create(spark, path, rows(spark, []).schema, "chunk_id", buckets=8)
    assert store.version() == 0 and store.read().count() == 0
    first = [(f"c{i}", i, "old") for i in range(60)]
    assert store.update(rows(spark, first), upsert_points) == 1
    assert listed(store.read()) == listed(rows(spark, first))
    before = store.manifest()
    batch = rows(spark, [("c3", 100, "new"), ("c900", 1, None)])
    touched = {r.b for r in batch.select(store.bucket_of(F.col("chunk_id")).alias("b")).collect()}
    kept = {b: files(path, b) for b in before if b not in touched}
    assert store.update(batch, upsert_points) == 2
    after = store.manifest()
    assert {b for b in after if after[b] == 2} == touched and all(after[b] == before[b] for b in kept)
    assert all(files(path, b) == f for b, f in kept.items())
    want = [r for r in first if r[0] != "c3"] + [("c3", 100, "new"), ("c900", 1, None)]
    assert listed(store.read()) == listed(rows(spark, want))
    assert listed(store.read(1)) == listed(rows(spark, first))  # older snapshots stay
    store.update(batch, upsert_points)
    assert listed(Snapshots(spark, path).read()) == listed(rows(spark, want))


def test_empty_batch_and_null_key(spark, tmp_path):
    store = Snapshots.create(spark, str(tmp_path / "store"), rows(spark, []).schema, "chunk_id", buckets=4)
    assert store.update(rows(spark, []), upsert_points) == 0
    store.update(rows(spark, [(None, 1, "a"), ("x", None, None), ("x", 2, "b")]), upsert_points)
    store.update(rows(spark, [(None, 2, "c")]), upsert_points)
    assert listed(store.read()) == listed(rows(spark, [(None, 2, "c"), ("x", 2, "b")]))


def test_failed_update_leaves_the_snapshot(spark, tmp_path):
    store = Snapshots.create(spark, str(tmp_path / "store"), rows(spark, []).schema, "chunk_id", buckets=4)
    store.update(rows(spark, [("a", 1, "x")]), upsert_points)
    bad = lambda old, new: upsert_points(old, new).withColumn("page", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        store.update(rows(spark, [("a", 2, "y")]), bad)
    with pytest.raises(ValueError, match="other buckets"):
        store.update(rows(spark, [("a", 2, "y")]), lambda old, new: rows(spark, [(f"k{i}", 1, "") for i in range(50)]))
    assert listed(store.read()) == [("a", 1, "x")]
    assert store.update(rows(spark, [("a", 2, "y")]), upsert_points) == 2
    assert listed(store.read()) == [("a", 2, "y")]
