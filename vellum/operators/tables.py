"""Sheet cells and tables to text, Markdown segments and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.ordered import GROUP_ROWS, numbered


def _joined(order: str, value: str, sep: str):
    """Values of a group in order, nulls left out, joined."""
    pairs = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    return F.array_join(F.transform(pairs, lambda p: p[value]), sep)


def cells_to_text(cells: DataFrame) -> DataFrame:
    """(doc, text): each sheet's heading, then its rows of values joined by ' | '; empty rows go."""
    rows = cells.groupBy("doc", "sheet_no", "sheet", "row_no").agg(_joined("col_no", "value", " | ").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("line") != "", F.struct("row_no", "line")))), lambda x: x["line"])
    heading = F.array(F.concat(F.lit("### Sheet: "), "sheet"))
    sheets = rows.groupBy("doc", "sheet_no", "sheet").agg(F.array_join(F.concat(heading, lines), "\n").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("sheet_no", "text")))
    return sheets.groupBy("doc").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def primary_or_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """(doc, text, method) from two (doc, text) tables: the primary text unless missing or blank."""
    p, f = primary.select("doc", F.col("text").alias("p")), fallback.select("doc", F.col("text").alias("f"))
    good = F.coalesce(F.length(T.strip(F.col("p"))) > 0, F.lit(False))
    return f.join(p, "doc", "full").select("doc", F.when(good, F.col("p")).otherwise(F.col("f")).alias("text"), F.when(good, "markitdown").otherwise("openpyxl_fallback").alias("method"))


def header_md(names: Column) -> Column:
    """Markdown header of a table with these column names (an array). Its marks."""
    return F.concat(F.lit("| "), F.array_join(names, " | "), F.lit(" |\n|"), F.repeat(F.lit("---|"), F.size(names)))


def _rows(cells: DataFrame, join) -> DataFrame:
    """(doc, row_no, body): one joined text per row; nulls show as empty."""
    shown = cells.select("doc", "sheet_no", "row_no", "col_no", F.coalesce("value", F.lit("")).alias("value"))
    return shown.groupBy("doc", "sheet_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "value"))).alias("c")).select("doc", "sheet_no", "row_no", join(F.transform("c", lambda x: x["value"])).alias("body"))


def table_segments(cells: DataFrame, columns: list[str], rows_per_chunk: int = 10, most: int = GROUP_ROWS) -> DataFrame:
    """Markdown chunks of rows_per_chunk rows with the table's header, per doc; bounds count from 0, the end is exclusive. A doc of more than `most` rows is numbered by ranges."""
    body = _rows(cells, lambda v: F.concat(F.lit("| "), F.array_join(v, " | "), F.lit(" |")))
    body = numbered(body, ["doc"], [F.col("sheet_no"), F.col("row_no")], "n", most, cells).withColumn("n", F.col("n") - 1).withColumn("segment", F.floor(F.col("n") / rows_per_chunk))
    found = body.groupBy("doc", "segment").agg(F.array_sort(F.collect_list(F.struct("n", "body"))).alias("r"), F.min("n").alias("lo"), (F.max("n") + 1).alias("hi"))
    span = F.concat(F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"))
    text = F.concat(F.lit("Context (Headers):\n"), header_md(F.array(*map(F.lit, columns))), F.lit("\n\nSegment ("), span, F.lit("):\n"), F.array_join(F.transform("r", lambda x: x["body"]), "\n"))
    return found.select("doc", "segment", span.alias("rows"), text.alias("text"), T.token_count(text).alias("token_count"), F.lit("table").alias("type"))


def table_html(cells: DataFrame, columns: list[str]) -> DataFrame:
    """(doc, html): header row and body rows, values escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = _rows(cells, lambda v: F.concat(F.lit("<tr>"), F.array_join(F.transform(v, lambda x: F.concat(F.lit("<td>"), safe(x), F.lit("</td>"))), ""), F.lit("</tr>")))
    head = "<table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_no", "row_no", "body"))), lambda x: x["body"]), "")
    return rows.groupBy("doc").agg(F.concat(F.lit(head), body, F.lit("</table>")).alias("html"))


def html_blobs(html: DataFrame) -> DataFrame:
    """(doc, folder, file_name, body): the one blob of each table of (doc, html)."""
    return html.select("doc", F.lit("tables").alias("folder"), F.concat(F.col("doc").cast("string"), F.lit(".json")).alias("file_name"), F.to_json(F.struct("html")).alias("body"))


def table_blob_link(segments: DataFrame, blobs: DataFrame) -> DataFrame:
    """Segments with table_blob_path, the path of their table's blob among blobs (blob_path, ...); null if it isn't stored."""
    path = F.concat(F.lit("tables/"), segments["doc"].cast("string"), F.lit(".json"))
    return segments.join(blobs.select(F.col("blob_path").alias("table_blob_path")).distinct(), path == F.col("table_blob_path"), "left")
