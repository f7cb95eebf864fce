"""Connected components of a table of edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import fewer, settle

#: Edges of one task, about.
TASK_EDGES = 50_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), both long: root is the component's smallest node.

    Each turn hangs every node's larger neighbours, then its smaller ones, on the smallest neighbour.
    Neighbourhoods are only ever reduced to their minimum, so a hub costs no more than its edges; the
    number of turns grows with the logarithm of the size. Each turn is written to the shared folder.
    """
    n = edges.count()
    few = lambda df: fewer(df, n, TASK_EDGES)
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, pairs = None, settle(few(pairs), "edges")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        met = few(both.filter("v > u").join(low, F.col("u") == F.col("x")))
        big = few(met.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = big.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        met = few(big.join(low, F.col("u") == F.col("x")))
        star = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        pairs = settle(few(star.filter("u <> v").distinct()), "edges")
        new = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if new == state:
            break
        state = new
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return few(nodes.join(pairs.select(F.col("u").alias("node"), "v"), "node", "left")).select("node", F.coalesce("v", "node").alias("root"))
