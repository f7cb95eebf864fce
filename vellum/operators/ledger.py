"""The ledger of ingested documents, reports of a run and supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vellum.operators.ordered import GROUP_ROWS, followed


def ledger_append(ledger: DataFrame, files: DataFrame, order: str = "seq") -> DataFrame:
    """Rows to append: files (doc_hash, filename, order) whose hash the ledger lacks; the first file of a hash counts."""
    first = files.groupBy("doc_hash").agg(F.min(F.struct(order, "filename")).alias("f"))
    new = first.join(ledger.select("doc_hash"), "doc_hash", "left_anti")
    return new.select("doc_hash", F.col("f.filename").alias("filename"), F.lit(False).alias("is_superseded"), F.lit(None).cast("string").alias("superseded_by_hash"), F.lit(0.0).alias("processing_cost"), F.lit("completed").alias("status"))


def ingest_report(routed: DataFrame, chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per routed file (file_name, route, reason): what became of it.

    chunks: (file_name, seq, page_number, doc_hash); errors: (file_name, error_msg). A file with an error or
    without chunks has failed. total_pages is the page of the last chunk; max_page the largest.
    """
    made = chunks.groupBy("file_name").agg(F.count("*").alias("n"), F.max_by("page_number", "seq").alias("total_pages"), F.max("page_number").alias("max_page"), F.min_by("doc_hash", "seq").alias("doc_hash"))
    met = routed.join(made, "file_name", "left").join(errors.groupBy("file_name").agg(F.min("error_msg").alias("error_msg")), "file_name", "left")
    skipped, failed = F.col("route") == "unsupported", F.col("error_msg").isNotNull() | F.col("n").isNull()
    ok = ~skipped & ~failed
    return met.select(
        "file_name", F.when(skipped, "skipped").when(failed, "failed").otherwise("success").alias("status"), F.when(skipped, "N/A").when(failed, "error").otherwise(F.col("doc_hash")).alias("doc_hash"),
        F.when(ok, F.col("n")).otherwise(0).cast("long").alias("total_chunks"), F.when(ok, F.col("total_pages")).otherwise(0).cast("long").alias("total_pages"), F.when(ok, F.col("max_page")).otherwise(0).cast("long").alias("max_page"),
        F.when(skipped, F.col("reason")).when(failed, F.coalesce("error_msg", F.lit("no chunks"))).alias("error_msg"), F.lit(0.0).alias("cost_estimate_usd"),
    )


def split_rejects(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows for which reason is null, the others with it): one bad row doesn't stop a batch."""
    x = rows.withColumn("reason", reason)
    return x.filter("reason IS NULL").drop("reason"), x.filter("reason IS NOT NULL")


def run_summary(report: DataFrame) -> DataFrame:
    """(status, n_files, n_chunks) of a run."""
    return report.groupBy("status").agg(F.count("*").alias("n_files"), F.sum("total_chunks").alias("n_chunks"))


#: What can become of a file.
STATUSES = ("success", "failed", "skipped")


def written_report(report: DataFrame, path: str) -> DataFrame:
    """Write the report to path; (status, n_files, n_chunks) of it, counted by the tasks as they write, so that nothing is read again."""
    seen = Observation("report")
    of = lambda s: F.col("status") == s
    counts = [x for s in STATUSES for x in (F.count_if(of(s)).alias(f"{s}_files"), F.sum(F.when(of(s), F.col("total_chunks")).otherwise(0)).alias(f"{s}_chunks"))]
    report.observe(seen, *counts).write.parquet(path)
    found = seen.get
    rows = [(s, found[f"{s}_files"], found[f"{s}_chunks"]) for s in STATUSES if found.get(f"{s}_files")]
    return report.sparkSession.createDataFrame(rows, "status string, n_files long, n_chunks long")


def written_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """Write chunks (type, page_number, token_count, ...) to path; one row of their totals, counted while they are written."""
    seen = Observation("chunks")
    totals = {"n_chunks": F.count(F.lit(1)), "n_tokens": F.coalesce(F.sum(F.col("token_count").cast("long")), F.lit(0)), "n_visual": F.count_if(F.col("type") == "visual"), "n_blank": F.count_if(F.coalesce("token_count", F.lit(0)) == 0), "max_page": F.max(F.col("page_number").cast("long"))}
    chunks.observe(seen, *(v.alias(k) for k, v in totals.items())).write.parquet(path)
    found = seen.get
    return chunks.sparkSession.createDataFrame([tuple(found.get(k) for k in totals)], ", ".join(f"{k} long" for k in totals))


def run_lines(report: DataFrame) -> DataFrame:
    """(file_name, line): one line of text per file, hashes cut to eight characters."""
    tail = F.when(F.col("status") == "success", F.concat(F.col("total_chunks").cast("string"), F.lit(" chunks, "), F.substring("doc_hash", 1, 8))).otherwise(F.coalesce("error_msg", F.lit("")))
    return report.select("file_name", F.concat_ws(": ", "file_name", "status", tail).alias("line"))


def supersession(versions: DataFrame, most: int = GROUP_ROWS) -> DataFrame:
    """versions (filename, version, doc_hash) with superseded_by_hash, the hash of the name's next version, and is_superseded.

    Of equal versions of a name the one with the smaller hash comes first. A name with more than `most` versions is cut into ranges by rank.
    """
    out = followed(versions, ["filename"], ["version", "doc_hash"], "doc_hash", "superseded_by_hash", most)
    return out.withColumn("is_superseded", F.col("superseded_by_hash").isNotNull())


def supersede(ledger: DataFrame, batch: DataFrame, most: int = GROUP_ROWS) -> DataFrame:
    """ledger (supersession's columns) with the versions of batch: only names of the batch are looked at again.

    A version that is in the ledger, or in the batch twice, counts once; so a batch may come again.
    """
    names = batch.select(F.col("filename").alias("name")).distinct()
    same = F.col("filename").eqNullSafe(F.col("name"))
    columns = ["filename", "version", "doc_hash"]
    known = ledger.join(names, same, "left_semi").select(*columns)
    again = supersession(known.union(batch.select(*columns)).distinct(), most)
    return ledger.join(names, same, "left_anti").unionByName(again.select(*ledger.columns))


def current_documents(versions: DataFrame) -> DataFrame:
    """The newest version of each name; by aggregation, so that a name with very many versions isn't sorted in one task."""
    return versions.groupBy("filename").agg(F.max(F.struct("version", "doc_hash")).alias("m")).select("filename", "m.version", "m.doc_hash")
