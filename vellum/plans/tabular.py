"""Queries on sheet cells and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import tables as T
from vellum.plans.fixtures import ctes, load
from vellum.plans.registry import query
from vellum.sources import files as S

COLUMNS = ["partkey", "quantity", "price", "returnflag"]

_TEXT = """texts AS (SELECT doc, string_agg(line, chr(10) ORDER BY sheet_no, row_no) AS text FROM (
    SELECT doc, sheet_no, row_no, string_agg(value, ' | ' ORDER BY col_no) AS line FROM cells GROUP BY doc, sheet_no, row_no HAVING count(value) > 0
    UNION ALL SELECT DISTINCT doc, sheet_no, 0, '### Sheet: ' || sheet FROM cells) GROUP BY doc)"""
BODY = "body AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc ORDER BY sheet_no, row_no) - 1 AS n FROM (SELECT doc, sheet_no, row_no, '| ' || string_agg(coalesce(value, ''), ' | ' ORDER BY col_no) || ' |' AS line FROM cells GROUP BY doc, sheet_no, row_no))"
SEGMENTS = """segs AS (SELECT doc, n // 10 AS segment, min(n) || '-' || (max(n) + 1) AS rows, 'Context (Headers):' || chr(10) || '| partkey | quantity | price | returnflag |' || chr(10) || '|---|---|---|---|' || chr(10) || chr(10) || 'Segment (' || min(n) || '-' || (max(n) + 1) || '):' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS text FROM body GROUP BY doc, n // 10)"""


@query("a5_cells_to_text", ctes("cells").rstrip() + f", {_TEXT} SELECT doc, text FROM texts")
def a5(spark, d):
    return T.cells_to_text(load(spark, d, "cells"))


@query("a6_primary_or_fallback", ctes("cells").rstrip() + f", {_TEXT} SELECT doc, CASE WHEN doc % 4 IN (0, 1) THEN 'converted ' || doc ELSE text END AS text, CASE WHEN doc % 4 IN (0, 1) THEN 'markitdown' ELSE 'openpyxl_fallback' END AS method FROM texts")
def a6(spark, d):
    cells = load(spark, d, "cells")
    good = F.concat(F.lit("converted "), F.col("doc").cast("string"))
    primary = cells.select("doc").distinct().filter("doc % 4 <> 3").select("doc", F.when(F.col("doc") % 4 < 2, good).otherwise(" \n").alias("text"))
    return T.primary_or_fallback(primary, T.cells_to_text(cells))


HTML = """SELECT doc, '<table><tr><th>partkey</th><th>quantity</th><th>price</th><th>returnflag</th></tr>' || string_agg(line, '' ORDER BY sheet_no, row_no) || '</table>' AS html FROM (
        SELECT doc, sheet_no, row_no, '<tr>' || string_agg('<td>' || replace(replace(replace(coalesce(value, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td>', '' ORDER BY col_no) || '</tr>' AS line FROM cells GROUP BY doc, sheet_no, row_no) GROUP BY doc"""


@query("a8_table_html", ctes("cells") + HTML)
def a8(spark, d):
    return T.table_html(load(spark, d, "cells"), COLUMNS)


@query("c1_table_header_md", "SELECT o_orderkey, '| orderkey | ' || lower(o_orderpriority) || ' |' || chr(10) || '|---|---|' AS header FROM orders")
def c1(spark, d):
    names = F.array(F.lit("orderkey"), F.lower("o_orderpriority"))
    return load(spark, d, "orders").select("o_orderkey", T.header_md(names).alias("header"))


@query("c2_table_segments", ctes("cells").rstrip() + rf", {BODY}, {SEGMENTS} SELECT doc, segment, rows, text, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS token_count, 'table' AS type FROM segs")
def c2(spark, d):
    return T.table_segments(load(spark, d, "cells"), COLUMNS)


@query("c3_table_blob_link", ctes("cells").rstrip() + f", {BODY}, {SEGMENTS}, html AS ({HTML}) SELECT doc, segment, CASE WHEN doc % 5 <> 0 THEN 'tables/' || doc || '.json' END AS table_blob_path, CASE WHEN doc % 5 <> 0 THEN html END AS html FROM segs JOIN html USING (doc)")
def c3(spark, d):
    """Tables whose number is a multiple of 5 haven't been stored; the others' segments get the HTML back by their link."""
    cells = load(spark, d, "cells")
    blobs = T.html_blobs(T.table_html(cells, COLUMNS).filter("doc % 5 <> 0")).withColumn("blob_path", S.blob_path(F.col("folder"), F.col("file_name"))).select("blob_path", "body")
    linked = T.table_blob_link(T.table_segments(cells, COLUMNS), blobs)
    met, _ = S.load_blobs(linked, blobs)
    none = linked.filter("table_blob_path IS NULL").withColumn("body", F.lit(None).cast("string"))
    return met.unionByName(none).select("doc", "segment", "table_blob_path", F.get_json_object("body", "$.html").alias("html"))
