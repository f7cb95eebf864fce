"""Layout items and files to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators.ordered import GROUP_ROWS, numbered

#: Labels of page furniture, of tables and of visuals.
FURNITURE = ("page_header", "page_footer")
VISUALS = ("picture", "figure", "chart")


def drop_furniture(items: DataFrame) -> DataFrame:
    """Items other than page headers and footers."""
    return items.filter(~F.col("label").isin(*FURNITURE))


def item_kind(items: DataFrame) -> DataFrame:
    """Items with kind table, visual or text. Blank text items go, and items without a page, but tables without one are on page 1."""
    kind = F.when(F.col("label") == "table", "table").when(F.col("label").isin(*VISUALS), "visual").when(F.length(T.strip(F.col("text"))) > 0, "text")
    page = F.coalesce("page_no", F.when(F.col("kind") == "table", 1))
    return drop_furniture(items).withColumn("kind", kind).withColumn("page_no", page).filter("kind IS NOT NULL AND page_no IS NOT NULL")


def reading_order(items: DataFrame, most: int = GROUP_ROWS) -> DataFrame:
    """item_kind with chunk_no: per document, tables and visuals in order, then text. A document of more than `most` items is numbered by ranges."""
    return numbered(item_kind(items), ["doc_id"], [F.when(F.col("kind") == "text", 1).otherwise(0), F.col("item_no")], "chunk_no", most, items)


def chunk_id(*parts: Column) -> Column:
    """A deterministic id: hash of the parts that identify a chunk."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def text_chunks(items: DataFrame, flip_y: bool = False) -> DataFrame:
    """Chunks of text items: stripped and raw text, page, tokens, box in parts of the page."""
    low, high = F.least("t", "b"), F.greatest("t", "b")
    y = (F.col("page_h") - high if flip_y else low) / F.col("page_h")
    left = F.least("l", "r")
    return item_kind(items).filter("kind = 'text'").select(
        "doc_id", "item_no", F.col("page_no").alias("page_number"), T.strip(F.col("text")).alias("clean_text"), F.col("text").alias("raw_text"), T.token_count(F.col("text")).alias("token_count"),
        (left / F.col("page_w")).alias("x"), y.alias("y"), ((F.greatest("l", "r") - left) / F.col("page_w")).alias("width"), ((high - low) / F.col("page_h")).alias("height"), F.lit("text").alias("type"),
    )


def boxes(items: DataFrame) -> DataFrame:
    """Sanitised boxes of items, from l, b, r, t that may be turned over."""
    w, h = F.col("page_w"), F.col("page_h")
    made = G.sanitise(F.col("l") / w, F.col("b") / h, (F.col("r") - F.col("l")) / w, (F.col("t") - F.col("b")) / h)
    return items.select("doc_id", "item_no", *(c.alias(k) for k, c in made.items()))


def item_probe(items: DataFrame, phrase: str, page: int = 1) -> DataFrame:
    """One page's items for inspection: upper-case label, 50 characters of text, box, and whether the phrase is there."""
    shown = F.translate(F.substring("text", 1, 50), "\n", " ")
    return items.filter(F.col("page_no") == page).select("doc_id", "item_no", F.upper("label").alias("label"), shown.alias("shown"), "l", "t", "r", "b", F.col("text").contains(phrase).alias("has_phrase"))


def native_text_chunks(files: DataFrame, suffixes: tuple[str, ...] = (".md", ".txt")) -> DataFrame:
    """One chunk for each plain-text file (columns file_name, content)."""
    ext = F.lower(F.regexp_extract("file_name", r"\.[^.]+$", 0))
    t = F.col("content").cast("string")
    return files.filter(ext.isin(*suffixes)).select(
        F.col("file_name").alias("source"), F.sha2(t.cast("binary"), 256).alias("doc_hash"), T.strip(t).alias("clean_text"), t.alias("raw_text"), F.lit(1).alias("page_number"),
        T.token_count(t).alias("token_count"), F.lit("native").alias("type"), F.lit("standard").alias("method"),
    )
