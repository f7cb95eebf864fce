"""Arithmetic on extracted figures. Rules that are only declared, or stated in prose, have own semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratios(metrics: DataFrame, top: str, bottom: str) -> DataFrame:
    """(entity, ratio) from rows (entity, metric, value): top / bottom, null where bottom is 0 or missing."""
    wide = metrics.groupBy("entity").agg(*(F.sum(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in (top, bottom)))
    return wide.select("entity", F.try_divide(F.col(top), F.col(bottom)).alias("ratio"))


def cost_rollup(chunks: DataFrame, prices: DataFrame) -> DataFrame:
    """(doc_hash, tokens, cost) from chunks (doc_hash, type, token_count) and prices (type, per_token)."""
    met = chunks.join(prices, "type", "left").withColumn("cost", F.col("token_count") * F.coalesce("per_token", F.lit(0.0)))
    return met.groupBy("doc_hash").agg(F.sum("token_count").alias("tokens"), F.sum("cost").alias("cost"))


def summation_audit(segments: DataFrame, totals: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(key, segment_sum, total, gap, verdict): a gap is an unlabelled rest, an excess a double count."""
    s = segments.groupBy("key").agg(F.sum("value").alias("segment_sum"))
    gap = F.col("total") - F.coalesce("segment_sum", F.lit(0).cast("decimal(18,4)"))
    verdict = F.when(gap > tolerance, "Other/Unlabeled").when(gap < -tolerance, "double count").otherwise("balanced")
    return totals.join(s, "key", "left").select("key", F.coalesce("segment_sum", F.lit(0).cast("decimal(18,4)")).alias("segment_sum"), "total", gap.alias("gap"), verdict.alias("verdict"))


def bridge_audit(steps: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(key, n_steps, start, last, off, holds): does each stated level equal the one before plus the delta?

    steps: (key, step, delta, level); off is the number of steps at which it doesn't.
    """
    order = Window.partitionBy("key").orderBy("step")
    x = steps.withColumn("before", F.lag("level").over(order))
    wrong = F.abs(F.col("before") + F.col("delta") - F.col("level")) > tolerance
    out = x.groupBy("key").agg(F.count("*").alias("n_steps"), F.min_by("level", "step").alias("start"), F.max_by("level", "step").alias("last"), F.count(F.when(wrong, 1)).alias("off"))
    return out.withColumn("holds", F.col("off") == 0)


def period_tag(label: Column, title: Column) -> dict[str, Column]:
    """Year, spelled-out label and kind of a period label such as '24, FY2025E or LTM."""
    short = F.regexp_extract(label, r"(?:'|FY|Q[1-4] ?)(\d{2})(?!\d)", 1)
    long = F.regexp_extract(label, r"((?:19|20)\d{2})", 1)
    year = F.when(long != "", long).when(short != "", F.concat(F.lit("20"), short)).cast("int")
    shown = F.regexp_replace(F.regexp_replace(label, r"'(\d{2})(?!\d)", "20$1"), r"\bLTM\b", "Last Twelve Months")
    projected = label.rlike(r"\d(?:E|P|F|B)\b") | F.lower(title).rlike("outlook|guidance|projection")
    return {"year": year, "shown": shown, "kind": F.when(projected, "Projected").otherwise("Actual")}


def magnitude_check(blocks: DataFrame) -> DataFrame:
    """(key, largest_block, largest_value, agrees) from blocks (key, block, area, value): the largest block should carry the largest number; ties to the larger block id."""
    by = lambda c: F.max(F.struct(c, "block"))["block"]
    x = blocks.groupBy("key").agg(by("area").alias("largest_block"), by("value").alias("largest_value"))
    return x.withColumn("agrees", F.col("largest_block") == F.col("largest_value"))
