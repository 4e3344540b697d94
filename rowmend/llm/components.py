"""Connected components by alternating large and small stars, in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowmend.llm import tables

MOST_ROUNDS = 60


def _star(edges: DataFrame) -> DataFrame:
    """``(u, v, low)``: every edge from its node ``u``, with the smallest node near ``u``."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("low"))
    return edges.join(lowest, "u").select("u", "v", F.least("u", "low").alias("low"))


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of all nodes in ``links(a, b)``; the label is the smallest node reachable.

    Edges point from the larger to the smaller node. The large star ties all larger
    neighbours of a node to its smallest one, the small star ties the smaller ones. Both
    keep what is connected; when nothing changes, every node points to its label. No
    node's neighbours are gathered: the stars are a minimum and a join. Each round ends
    in a written table, and only a count and a checksum reach the driver.
    """
    edges = tables.written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(),
        "components-edges",
    )
    seen = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        small = _star(large)
        tied = small.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            small.select("u", F.col("low").alias("v"))
        )
        edges = tables.written(tied.filter("u > v").distinct(), "components-edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    pointed = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return pointed.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
