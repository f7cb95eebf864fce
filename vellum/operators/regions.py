"""Scores of page regions from their text and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T


def region_text(items: DataFrame, keys: list[str], order: str = "item_no") -> DataFrame:
    """(keys, n_items, text): each region's texts in order, joined by blanks."""
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    return items.groupBy(*keys).agg(F.count("*").alias("n_items"), F.array_join(F.transform(parts, lambda x: F.coalesce(x["text"], F.lit(""))), " ").alias("text"))


def grid_score(items: DataFrame, keys: list[str], order: str = "item_no") -> DataFrame:
    """(keys, v3): 1 for three columns of starts or more; 0.85 or 0.2 for two, by the right half's text; else 0.

    Starts l closer than max(15, 2 % of their span) are one cluster; a cluster with over a tenth of the
    items is a column; regions of five items or fewer score 0.
    """
    all_ = Window.partitionBy(*keys)
    x = items.withColumns({"n": F.count("*").over(all_), "lo": F.min("l").over(all_), "hi": F.max("l").over(all_)})
    by_x = Window.partitionBy(*keys).orderBy("l", order)
    gap = F.coalesce(F.col("l") - F.lag("l").over(by_x), F.lit(0.0))
    x = x.withColumn("starts", (gap >= F.greatest(F.lit(15.0), (F.col("hi") - F.col("lo")) * 0.02)).cast("int"))
    x = x.withColumn("cluster", F.sum("starts").over(by_x.rowsBetween(Window.unboundedPreceding, 0)))
    size = x.groupBy(*keys, "cluster").agg(F.count("*").alias("size"), F.first("n").alias("n"))
    columns = size.groupBy(*keys).agg(F.count(F.when(F.col("size") > F.col("n") * F.lit(0.1), 1)).alias("columns"), F.first("n").alias("n"))
    right = F.col("l") > (F.col("lo") + F.col("hi")) / 2
    half = x.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(right, F.struct(order, "text")))).alias("p"))
    half = half.select(*keys, F.array_join(F.transform("p", lambda p: F.coalesce(p["text"], F.lit(""))), " ").alias("right_text"))
    words = T.tokens(F.col("right_text"))
    digits = F.regexp_count("right_text", F.lit(r"\p{Nd}")) / F.greatest(F.length("right_text"), F.lit(1))
    titles = F.size(F.filter(words, lambda w: w.rlike(T.TITLE_WORD) | w.rlike(T.UPPER_WORD))) / F.greatest(F.size(words), F.lit(1))
    v3 = F.when(F.col("n") <= 5, 0.0).when(F.col("columns") >= 3, 1.0).when(F.col("columns") == 2, F.when((digits > F.lit(0.4)) | (titles > F.lit(0.25)), 0.85).otherwise(0.2)).otherwise(0.0)
    return columns.join(half, keys).select(*keys, v3.alias("v3"))


def region_verdict(items: DataFrame, keys: list[str], order: str = "item_no") -> DataFrame:
    """(keys, n_items, v1, v2, v3, v4, score, decision, layout_structure, risk_flag) of each region with items."""
    t = region_text(items, keys, order).join(grid_score(items, keys, order), keys)
    t = t.withColumns({"v1": T.alpha_ratio(F.col("text")), "v2": T.entity_density(F.col("text")), "v4": T.risk_penalty(F.col("text"))})
    score = (F.col("v1") * 0.35 + F.col("v3") * 0.30 + F.col("v2") * 0.35) * (F.lit(1.0) - F.col("v4"))
    return t.select(
        *keys, "n_items", "v1", "v2", "v3", "v4", F.round(score, 3).alias("score"), F.when(score > 0.50, "chart").otherwise("general").alias("decision"),
        F.when(F.col("v3") == 1.0, "Grid").when(F.col("v3") == 0.85, "KV").otherwise("Freeform").alias("layout_structure"), F.when(F.col("v4") > 0.5, "TOC/Legal").otherwise("None").alias("risk_flag"),
    )
