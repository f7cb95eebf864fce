"""Row numbers and next values within groups of any size, by two passes over ranges of the order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.sources.shared import settle

#: Groups of more rows than this are cut into ranges; smaller ones are one window each.
GROUP_ROWS = 4_000_000


def _same(a: DataFrame, b: DataFrame, keys: list[str], to: dict[str, str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[to[k]]) for k in keys))


def by_size(rows: DataFrame, keys: list[str], most: int = GROUP_ROWS, at_most: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups of up to `most` rows, rows of the others or None). Large groups are few: at most one for every `most` rows.

    at_most: a table whose groups are at least as large, to be counted instead of rows that are costly to make.
    """
    counted = rows if at_most is None else at_most
    # Spark's own estimate, 16 bytes for each key: a table this small needs no count. Either way gives the same rows.
    if counted.select(*keys)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= 16 * most:
        return rows, None
    large = counted.groupBy(*keys).count().filter(F.col("count") > most).select(*(F.col(k).alias(f"_{k}") for k in keys))
    if large.isEmpty():
        return rows, None
    large = settle(large, "large")
    here = _same(rows, large, keys, {k: f"_{k}" for k in keys})
    return rows.join(F.broadcast(large), here, "left_anti"), rows.join(F.broadcast(large), here, "left_semi")


def ranged(rows: DataFrame, keys: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """rows with _range: the table is dealt out by rank of (keys, order), and range k stands before range k + 1. Written once, so that both passes see the same ranges."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(rows.repartitionByRange(parts, *map(F.col, keys), *order).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str, most: int = GROUP_ROWS, at_most: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """rows with `name`: their number, from 1, within their group (equal keys; nulls are equal) by `order`.

    A group of more than `most` rows isn't sorted in one task: its rows are dealt out by rank, each range is numbered by
    itself, and then moved by the counts of the ranges before. at_most: as in by_size().
    """
    small, large = by_size(rows, keys, most, at_most)
    out = small.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    if large is None:
        return out
    cut = ranged(large, keys, order, parts)
    counts = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each range, and one more for each large group at most.
    moved = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_at"), before.alias("_before"))
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    met = local.join(F.broadcast(moved), _same(local, moved, keys, {k: f"_{k}" for k in keys}) & (local["_range"] == moved["_at"]))
    return out.unionByName(met.select(*(local[c] for c in rows.columns), (F.col("_local") + F.col("_before")).alias(name)))


def followed(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, most: int = GROUP_ROWS, parts: int | None = None) -> DataFrame:
    """rows with `name`: the `value` of the next row of their group by the columns `order`; null for the last. Large groups go by ranges as in numbered()."""
    small, large = by_size(rows, keys, most)
    out = small.withColumn(name, F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)))
    if large is None:
        return out
    cut = ranged(large, keys, [F.col(c) for c in order], parts)
    heads = cut.groupBy(*keys, "_range").agg(F.min(F.struct(*order, F.col(value).alias("_value")))["_value"].alias("_head"))
    after = F.lead("_head").over(Window.partitionBy(*keys).orderBy("_range"))
    heads = heads.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_at"), after.alias("_after"))
    inner = Window.partitionBy(*keys, "_range").orderBy(*order)
    local = cut.withColumn("_next", F.lead(value).over(inner)).withColumn("_is_last", F.lead(F.lit(True)).over(inner).isNull())
    met = local.join(F.broadcast(heads), _same(local, heads, keys, {k: f"_{k}" for k in keys}) & (local["_range"] == heads["_at"]))
    return out.unionByName(met.select(*(local[c] for c in rows.columns), F.when(F.col("_is_last"), F.col("_after")).otherwise(F.col("_next")).alias(name)))
