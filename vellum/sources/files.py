"""Drop zones, routing of files, shadow plans, blobs and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The supported suffixes and the route of each.
VISUAL = (".pdf", ".png", ".jpg", ".jpeg")
NATIVE = (".xlsx", ".xls", ".xlsm", ".docx", ".pptx", ".md", ".txt")
SHEETS = (".xlsx", ".xls", ".xlsm")
#: Folders of artifacts.
FOLDERS = ("layouts", "definitions", "tables")

BINARY_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def _named(files: DataFrame) -> DataFrame:
    return files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))


def drop_zone_scan(spark: SparkSession, path: str) -> DataFrame:
    """Files directly in a folder (path, modificationTime, length, content, file_name).

    Names that begin with a dot or an underscore are hidden; an empty folder gives no rows.
    """
    return _named(spark.read.format("binaryFile").schema(BINARY_FILE).load(path))


def drop_zone_stream(spark: SparkSession, path: str) -> DataFrame:
    """drop_zone_scan as a stream: each trigger has the files that came since the last."""
    return _named(spark.readStream.format("binaryFile").schema(BINARY_FILE).load(path))


def suffix(name: Column) -> Column:
    """Lower-case suffix with its dot, '' if there is none."""
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def route_files(requested: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """requested (file_name, ...) with route and reason; names not in present (file_name) do not exist."""
    ext = suffix(F.col("file_name"))
    route = F.when(ext.isin(*VISUAL), "visual_stream").when(ext.isin(*NATIVE), "native_stream").otherwise("unsupported")
    reason = F.when(route == "unsupported", F.concat(F.lit("Extension "), ext, F.lit(" not supported"))).otherwise("Extension match")
    if present is None:
        return requested.withColumns({"route": route, "reason": reason})
    there = present.select("file_name", F.lit(True).alias("_there")).distinct()
    met = requested.join(there, "file_name", "left")
    gone = F.col("_there").isNull()
    return met.withColumns({"route": F.when(gone, "unsupported").otherwise(route), "reason": F.when(gone, "File does not exist").otherwise(reason)}).drop("_there")


def shadow_plan(files: DataFrame, rendered: DataFrame) -> DataFrame:
    """(file_name, shadow_path) of spreadsheets whose shadow isn't among rendered (file_name)."""
    name = F.concat(F.regexp_replace("file_name", r"\.[^.]+$", ""), F.lit("_shadow.pdf"))
    plan = files.filter(suffix(F.col("file_name")).isin(*SHEETS)).select("file_name", name.alias("shadow"))
    missing = plan.join(rendered.select(F.col("file_name").alias("r")), F.col("shadow") == F.col("r"), "left_anti")
    return missing.select("file_name", F.concat(F.lit("shadow_cache/"), "shadow").alias("shadow_path"))


def blob_path(folder: Column, name: Column, kind: str = "json") -> Column:
    """folder/name; a folder that may not hold the kind is an error when the row is read."""
    allowed = FOLDERS if kind == "json" else ("tables",)
    return F.when(folder.isin(*allowed), F.concat(folder, F.lit("/"), name)).otherwise(F.raise_error(F.concat(F.lit("Invalid blob folder: "), folder)))


def write_blobs(blobs: DataFrame, path: str, kind: str = "json") -> None:
    """Add (folder, file_name, body) of a kind, json or md, to the Parquet store at path, a part for each folder; checked by blob_path."""
    good = blobs.withColumns({"blob_path": blob_path(F.col("folder"), F.col("file_name"), kind), "kind": F.lit(kind)})
    good.write.mode("append").option("compression", "zstd").partitionBy("folder").parquet(path)


def load_blobs(chunks: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with the body of their table_blob_path, chunks whose blob is missing)."""
    stored = blobs.select(F.col("blob_path").alias("table_blob_path"), "body")
    return chunks.join(stored, "table_blob_path"), chunks.filter("table_blob_path IS NOT NULL").join(stored, "table_blob_path", "left_anti")


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(origin, x, y, r, g, b) of decoded images; the source stores rows of BGR bytes."""
    return decoded_pixels(spark.read.format("image").load(path).select("image.*"))


def image_lines(images: DataFrame) -> DataFrame:
    """(origin, width, channels, y, line) of images (origin, height, width, nChannels, data) as Spark's image source gives them: the bytes of each line."""
    stride = F.col("width") * F.col("nChannels")
    lines = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.substring(F.col("data"), y * stride + 1, stride))
    return images.filter("nChannels >= 3 AND height > 0 AND width > 0").select("origin", "width", F.col("nChannels").alias("channels"), F.posexplode(lines).alias("y", "line"))


def bgr_at(line: Column, x: Column, channels: Column) -> dict[str, Column]:
    """r, g, b of pixel x (from 0) of a line of bytes that was decoded as Latin-1, a character for each byte."""
    return {c: F.ascii(F.substring(line, x * channels + k + 1, F.lit(1))) for k, c in ((2, "r"), (1, "g"), (0, "b"))}


def latin(line: Column) -> Column:
    return F.decode(line, "ISO-8859-1")


def strip_lines(images: DataFrame, strips: DataFrame) -> DataFrame:
    """(columns of strips, y, channels, line): for strips (origin, x0, x1, y0, y1; ends exclusive) the bytes of just their stretch of each image line.

    Strips and image lines meet by image and line, so an image with very many strips is dealt out by its lines, and no pixel is made
    here. Strips end at the image's edges; those outside have no rows.
    """
    rows = F.sequence(F.greatest(F.lit(0), F.col("y0")).cast("int"), F.col("y1").cast("int") - 1)
    asked = strips.filter("y1 > greatest(y0, 0) AND x1 > greatest(x0, 0)").withColumn("y", F.explode(rows))
    met = image_lines(images).join(asked, ["origin", "y"])
    left, right = F.greatest(F.col("x0"), F.lit(0)).cast("int"), F.least(F.col("x1"), F.col("width")).cast("int")
    part = F.substring("line", left * F.col("channels") + 1, (right - left) * F.col("channels"))
    return met.filter(left < right).select(*strips.columns, "y", "channels", part.alias("line"))


def strip_pixels(images: DataFrame, strips: DataFrame) -> DataFrame:
    """(columns of strips, x, y, r, g, b): the pixels of strips, and no others."""
    found = strip_lines(images, strips).withColumn("line", latin(F.col("line")))
    last = F.floor(F.length("line") / F.col("channels")).cast("int") - 1
    px = found.withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    return px.select(*strips.columns, (F.greatest(F.col("x0"), F.lit(0)) + F.col("at")).cast("long").alias("x"), F.col("y").cast("long").alias("y"), *(v.alias(c) for c, v in bgr_at(F.col("line"), F.col("at"), F.col("channels")).items()))


def decoded_pixels(images: DataFrame) -> DataFrame:
    """(origin, x, y, r, g, b) of images (origin, height, width, nChannels, data) as Spark's image source gives them; those of under three channels have none."""
    lines = image_lines(images).select("origin", "y", "channels", "width", latin(F.col("line")).alias("line"))
    px = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return px.select("origin", "x", "y", *(v.alias(c) for c, v in bgr_at(F.col("line"), F.col("x"), F.col("channels")).items()))
