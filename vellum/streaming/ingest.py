"""Streaming ingestion: files that arrive in a drop zone go to the ledger and the points table once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators.chunks import native_text_chunks
from vellum.sources.files import drop_zone_stream

LEDGER = "doc_hash string, filename string, is_superseded boolean, superseded_by_hash string, processing_cost double, status string"
#: Keeps large state on the executors' disks, with its changes in the checkpoint folder.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def started(spark: SparkSession, start) -> StreamingQuery:
    """Start a query whose state is kept by STATE_STORE; the session's own setting comes back at once, as a query keeps what it began with."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        return start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_ingest(spark: SparkSession, zone: str, ledger_path: str, points_path: str, checkpoint: str, known: DataFrame | None = None) -> StreamingQuery:
    """Handle the files that are new in zone and stop: chunks of unseen text files are added to points_path, their hashes to ledger_path.

    Hashes that came before are state of the stream, kept in checkpoint by hash: a batch reads neither ledger nor points, and a
    restart goes on where the last one ended. Of files with one content in a batch, one counts. `known`: a ledger
    (doc_hash) from before the stream's first start, whose documents are not new. Each batch has a folder of its own in both tables,
    written over if the batch is tried again; the ledger's rows are made of the chunks as written.
    """
    chunks = native_text_chunks(drop_zone_stream(spark, zone).withColumn("content", F.col("content").cast("string")))
    if known is not None:
        chunks = chunks.join(known.select("doc_hash").distinct(), "doc_hash", "left_anti")
    fresh = chunks.dropDuplicates(["doc_hash"])

    def handle(batch: DataFrame, number: int) -> None:
        path = f"{points_path}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        entered = batch.sparkSession.read.schema(batch.schema).parquet(path).select(
            "doc_hash", F.col("source").alias("filename"), F.lit(False).alias("is_superseded"), F.lit(None).cast("string").alias("superseded_by_hash"), F.lit(0.0).alias("processing_cost"), F.lit("completed").alias("status")
        )
        entered.write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")

    return started(spark, lambda: fresh.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
